"""Joins of rows to what is known about their key, whatever share of the rows one key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt to.
PARTS = 64


def spread_join(rows: DataFrame, summary: DataFrame, key: str | list[str], by: str) -> DataFrame:
    """``rows`` with their key's one row of ``summary`` (inner join on ``key``).

    The rows of a key are dealt to PARTS by the hash of column ``by``.  Which
    parts a key has is found by a partial aggregate; the summary goes to these,
    PARTS rows a key at most, and the rows meet it part by part.  Both joins are
    shuffled: Spark would judge the keys by the files they are made from and
    send them through the driver, though hashes are larger than what they stand for.
    """
    keys = [key] if isinstance(key, str) else key
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    placed = dealt.select(*keys, "__part").distinct().hint("merge").join(summary.hint("merge"), keys)
    return dealt.join(placed.hint("merge"), [*keys, "__part"]).drop("__part")


def spread_left_join(rows: DataFrame, summary: DataFrame, key: str, by: str) -> DataFrame:
    """As ``spread_join``, but rows whose key the summary lacks stay, with nulls."""
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    placed = dealt.select(key, "__part").distinct().hint("merge").join(summary.hint("merge"), key)
    return dealt.join(placed.hint("merge"), [key, "__part"], "left").drop("__part")
