"""Connected components of a link table, by the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, label: every id in ``links`` (a, b) with the smallest id that its links reach.

    Large and small stars alternate: each id's larger neighbours, then its
    smaller ones, are tied to the smallest neighbour.  Paths shrink by a
    constant factor each time, links never grow in number, and every sum is a
    partial aggregate.  Each round is stored, so no lineage builds up.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = scratch.keep(edges, f"{name}-0")
    before, turn = None, 0
    while True:
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        following = scratch.keep(small, f"{name}-{turn}")
        mark = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.discard(f"{name}-{turn - 1}")
        edges = following
        if mark == before:
            break
        before = mark
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
    found = scratch.keep(found, name)
    scratch.discard(f"{name}-{turn}")
    return found
