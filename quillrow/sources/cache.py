"""The result cache: append-only Parquet, one folder per step and generation, cut into buckets of keys.

Rows are appended by the driver's plan after a level is stored, never by
workers; the newest entry of a key counts.  A lookup reads the buckets that the
keys asked for fall into, and no others; large appends have more buckets.
Compaction writes the live entries as the next generation, if asked in buckets
so small that lookups of a given size leave some out; a generation counts from
its success marker on, so a job lost on the way leaves the one before in place.
"""

from __future__ import annotations

import math
import time
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import Files, shared_root

SCHEMA = "key string, value string, created_at double, expires_at double"
#: Folders that a step's entries are dealt to by their keys, at least; larger appends have twice, four times, ... as many.
BUCKETS = 64
#: Entries of an append that share a bucket, about, at most.
ENTRIES = 65_536
#: Buckets that a lookup is expected to leave out after a compaction made for lookups like it.
LEFT_OUT = 8


def bucket_of(key: Column, size: int = BUCKETS) -> Column:
    """The bucket of a key among ``size`` of them; buckets of all sizes are numbered through, the 64 of the least size first."""
    return (F.crc32(key.cast("binary")) % size + (size - BUCKETS)).cast("int")


def size_for(entries: int, asked: int = 0) -> int:
    """Buckets for so many entries, a power of two; so many that a lookup of ``asked`` keys is expected to leave some out."""
    size = BUCKETS
    while size * ENTRIES < entries or size * math.exp(-asked / size) < LEFT_OUT:
        size *= 2
    return size


class CacheManager:
    """A cache in ``cache_dir``, by default below the folder that all executors share; ``ttl`` seconds, 0 for no expiry."""

    def __init__(self, spark: SparkSession, cache_dir: str | None = None, ttl: int = 3600):
        self.spark, self.root, self.ttl = spark, (cache_dir or f"{shared_root(spark)}/quillrow-cache").rstrip("/"), ttl
        self.files = Files(spark)

    def _path(self, step: str) -> str:
        return f"{self.root}/step={step}"

    def _generations(self, step: str) -> list[int]:
        """Finished generations, the newest last."""
        found = [int(n.removeprefix("gen-")) for n in self.files.names(self._path(step)) if n.startswith("gen-")]
        return sorted(g for g in found if self.files.exists(f"{self._path(step)}/gen-{g}/_SUCCESS"))

    def table(self, step: str, buckets: list[int] | None = None) -> DataFrame | None:
        """All entries of a step as they were written, or only those in some buckets; None if there are none."""
        if not (found := self._generations(step)):
            return None
        stored = self.spark.read.schema(SCHEMA + ", bucket int").parquet(f"{self._path(step)}/gen-{found[-1]}")
        if buckets is None:
            return stored
        return stored.where(f"bucket IN ({', '.join(map(str, buckets))})" if buckets else "false")

    def _sizes(self, step: str, generation: int) -> list[int]:
        """The numbers of buckets that appends to a generation had, ascending."""
        return sorted({BUCKETS, *map(int, self.files.names(f"{self._path(step)}/gen-{generation}/_sizes"))})

    def buckets(self, keys: DataFrame, step: str | None = None) -> list[int]:
        """The buckets that some keys (one column) fall into: those that a step has, or of the least size."""
        found = self._generations(step) if step else []
        sizes = self._sizes(step, found[-1]) if found else [BUCKETS]
        most = sizes[-1]  # a key's place among the most buckets says where it is among fewer
        places = keys.select((F.crc32(F.col(keys.columns[0]).cast("binary")) % most).cast("int").alias("place")).where("place is not null")
        # a large batch's first keys mostly fall into all buckets; then the others need no pass of their own
        enough = int(most * (math.log(most) + 8))
        first = places.take(enough)
        fallen = {r[0] for r in first}
        if len(first) == enough and len(fallen) < most:
            fallen = {r[0] for r in places.distinct().collect()}
        return sorted({place % size + size - BUCKETS for place in fallen for size in sizes})

    def entries(self, step: str, now: float | None = None, keys: DataFrame | None = None) -> DataFrame:
        """key, value of the live entries of a step, one a key; of those only that ``keys`` (one column) may need, if given."""
        buckets = self.buckets(keys, step) if keys is not None and self._generations(step) else None
        stored = self.table(step, buckets)
        if stored is None:
            return self.spark.createDataFrame([], "key string, value string")
        now = time.time() if now is None else now
        live = stored.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
        return live.groupBy("key").agg(F.max_by("value", "created_at").alias("value"))

    def append(self, step: str, rows: DataFrame, now: float | None = None, count: int | None = None) -> None:
        """Add rows of (key, value); equal keys are written once.  The rows are counted first unless their number is given."""
        now = time.time() if now is None else now
        count = rows.count() if count is None else count
        if not count:
            return
        until = F.lit(now + self.ttl if self.ttl else None).cast("double")
        one = rows.groupBy("key").agg(F.min("value").alias("value"))
        self._write(step, (self._generations(step) or [0])[-1], one.select("key", "value", F.lit(now).alias("created_at"), until.alias("expires_at")), size_for(count))

    def _write(self, step: str, generation: int, rows: DataFrame, size: int) -> None:
        # a task writes whole buckets, so that a bucket gets one file an append; keys are hashes, so buckets are even
        path = f"{self._path(step)}/gen-{generation}"
        if size > BUCKETS:
            self.files.write_json(f"{path}/_sizes/{size}", {})  # before the entries, so that none is overlooked
        dealt = rows.withColumn("bucket", bucket_of(F.col("key"), size)).repartition(max(BUCKETS, size // BUCKETS), "bucket").sortWithinPartitions("bucket", "key")
        # tasks put their own files in place: what a lost one leaves are entries like others
        dealt.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("bucket").parquet(path)

    def get(self, step: str, key: str) -> str | None:
        if not (found := self._generations(step)):
            return None
        stored = self.table(step, [zlib.crc32(key.encode()) % size + size - BUCKETS for size in self._sizes(step, found[-1])])
        live = stored.where((F.col("key") == key) & (F.col("expires_at").isNull() | (F.col("expires_at") >= time.time())))
        return live.agg(F.max_by("value", "created_at")).first()[0]

    def set(self, step: str, key: str, value: str) -> None:
        self.append(step, self.spark.createDataFrame([(key, value)], "key string, value string"))

    def delete_step(self, step: str) -> int:
        """Number of keys deleted."""
        stored = self.table(step)
        count = stored.select("key").distinct().count() if stored is not None else 0
        self.files.delete(self._path(step))
        return count

    def steps(self) -> list[str]:
        return [n.removeprefix("step=") for n in self.files.names(self.root) if n.startswith("step=")]

    def delete_all(self) -> int:
        return sum(self.delete_step(s) for s in self.steps())

    def cleanup_expired(self, now: float | None = None) -> int:
        """Compacts the steps that hold expired entries; number of entries that had expired."""
        now = time.time() if now is None else now
        removed = 0
        for step in self.steps():
            stored = self.table(step)
            expired = stored.where(F.col("expires_at") < now).count() if stored is not None else 0
            if expired:
                self.compact(step, now)
                removed += expired
        return removed

    def compact(self, step: str, now: float | None = None, lookups: DataFrame | None = None) -> None:
        """Writes the newest live entry of each key as the next generation, in few files; older generations go after.

        With ``lookups`` (one column, keys as a lookup asks for) the files are
        so many that a lookup of as many keys needn't read all of them.  Keys
        are hashes, so for a hundredth of the entries these are small files.
        """
        now = time.time() if now is None else now
        found = self._generations(step)
        if not found:
            return
        live = self.table(step).where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
        newest = live.groupBy("key").agg(F.max_by(F.struct("value", "created_at", "expires_at"), "created_at").alias("e")).select("key", "e.*")
        self.files.delete(f"{self._path(step)}/gen-{found[-1] + 1}")  # of a job that never ended
        self._write(step, found[-1] + 1, newest, size_for(live.count(), lookups.distinct().count() if lookups is not None else 0))
        for g in found:
            self.files.delete(f"{self._path(step)}/gen-{g}")
