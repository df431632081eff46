"""Stored frames in a folder that all executors share."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, a cluster its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        folder = tempfile.mkdtemp(prefix="quillrow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return (base or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


class Files:
    """The few file operations that Spark has no reader or writer for, on any Hadoop file system."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        place, system = self._at(path)
        return system.exists(place)

    def delete(self, path: str) -> bool:
        place, system = self._at(path)
        return system.delete(place, True)

    def delete_on_exit(self, path: str) -> None:
        """Has the driver's JVM delete a folder when it ends."""
        place, system = self._at(path)
        system.deleteOnExit(place)

    def names(self, path: str) -> list[str]:
        place, system = self._at(path)
        return sorted(x.getPath().getName() for x in system.listStatus(place)) if system.exists(place) else []

    def write_json(self, path: str, value: dict) -> None:
        place, system = self._at(path)
        out = system.create(place, True)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            out.close()

    def read_json(self, path: str) -> dict | None:
        """The value, or None if there is none or it can't be read."""
        place, system = self._at(path)
        if not system.exists(place):
            return None
        stream = system.open(place)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()


def stored(frame: DataFrame, path: str) -> DataFrame:
    """Write a frame and read it back: whoever uses the result re-reads it and recomputes nothing."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
