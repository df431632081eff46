"""Shared-folder scratch tables: the way these operators cut lineage.

A scratch table is ordinary Parquet below ``spark.checkpoint.dir``, which every
executor and the driver see, so a lost executor costs a re-read and never a
recomputation of paid or random work.  Where that setting is absent a local
session gets a temporary folder and a cluster session uses its warehouse.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.storage import Files, shared_root


class Scratch:
    """Writes frames below one fresh folder and reads them back; the folder goes when the application ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/quillrow/{label}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def keep(self, frame: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``frame``, in folders of the values of ``by`` if given, and return the stored rows, lineage cut."""
        path = f"{self.root}/{name}"
        out = frame.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(path)
        if not self.names:
            Files(self.spark).delete_on_exit(self.root)
        self.names.append(name)
        return self.spark.read.schema(frame.schema).parquet(path)

    def read(self, name: str, schema: str) -> DataFrame:
        """What lies below a folder that several tables were kept in."""
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.root}/{name}")

    def discard(self, *names: str) -> None:
        """Delete tables that no lazy result reads any more."""
        files = Files(self.spark)
        for name in names:
            files.delete(f"{self.root}/{name}")
            self.names.remove(name)

    def discard_but(self, *names: str) -> None:
        """Delete all tables but those that a result still reads."""
        self.discard(*(n for n in dict.fromkeys(self.names) if n not in names))
