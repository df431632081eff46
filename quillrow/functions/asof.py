"""As-of lookups: for each row the last row of another table at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIDE, AT, FOUND, LANE = "__side", "__at", "__found", "__lane"


def last_before(
    rows: DataFrame, history: DataFrame, by: tuple[str, str], at: tuple[str, str], values: list[str], bucket: int = 86_400,
    within: int | None = None, order: str | None = None,
) -> DataFrame:
    """``rows`` with ``values`` of the last row of ``history`` that has the same key and no later time.

    ``by`` and ``at`` name key and time in ``rows`` and in ``history``.  Times
    are cut into buckets of so many seconds; a key's rows meet bucket by
    bucket, and what is known at a bucket's end is carried to the later ones,
    so a key of any share of the rows is split by time.  What a bucket's task
    carries on is one row a key and bucket that has history.  Rows without
    partner, key or time get nulls; history without key or time is never
    found.  Of equal times the largest ``order`` counts (the largest values,
    without one).  ``within`` seconds bounds the age of what is found.  Every
    row comes out once, and may be used as a step's input.
    """
    given = F.struct(*(history[c].alias(c) for c in values))
    rank = F.struct(history[order].alias("o"), given.alias("v")) if order else F.struct(given.alias("v"))
    known = history.where(history[by[1]].isNotNull() & history[at[1]].isNotNull()).select(
        history[by[1]].alias(LANE), history[at[1]].alias(AT), F.struct(history[at[1]].alias("t"), rank.alias("r")).alias(FOUND)
    )
    asked = rows.select(F.struct(*rows.columns).alias("__row"), rows[by[0]].alias(LANE), rows[at[0]].alias(AT))
    both = known.select(LANE, AT, FOUND, F.lit(0).alias(SIDE), F.lit(None).cast(asked.schema["__row"].dataType).alias("__row")).unionByName(
        asked.select(LANE, AT, F.lit(None).cast(known.schema[FOUND].dataType).alias(FOUND), F.lit(1).alias(SIDE), "__row")
    )
    both = both.withColumn("__bucket", F.floor(F.unix_micros(F.col(AT).cast("timestamp")) / (bucket * 1_000_000)))
    inside = Window.partitionBy(LANE, "__bucket").orderBy(AT, SIDE, FOUND).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__here", F.last(FOUND, ignorenulls=True).over(inside)).where(F.col(SIDE) == 1)
    ends = both.where(F.col(SIDE) == 0).groupBy(LANE, "__bucket").agg(F.max(FOUND).alias("__end"))
    # only the buckets of rows that found nothing in their own look back
    open_buckets = seen.where(F.col("__here").isNull() & F.col(LANE).isNotNull() & F.col("__bucket").isNotNull()).select(LANE, "__bucket").distinct()
    marks = ends.select(LANE, "__bucket", "__end", F.lit(False).alias("__asks")).unionByName(
        open_buckets.select(LANE, "__bucket", F.lit(None).cast(ends.schema["__end"].dataType).alias("__end"), F.lit(True).alias("__asks"))
    )
    earlier = Window.partitionBy(LANE).orderBy("__bucket").rangeBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("__carried", F.last("__end", ignorenulls=True).over(earlier)).where("__asks").select(LANE, "__bucket", "__carried")
    found = seen.join(carried, [LANE, "__bucket"], "left").withColumn("__last", F.coalesce("__here", "__carried"))
    if within is not None:
        age = F.unix_micros(F.col(AT).cast("timestamp")) - F.unix_micros(F.col("__last.t").cast("timestamp"))
        found = found.withColumn("__last", F.when(age <= within * 1_000_000, F.col("__last")))
    return found.select("__row.*", *(F.col(f"__last.r.v.{c}").alias(c) for c in values))
