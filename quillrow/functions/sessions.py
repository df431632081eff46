"""Sessions: runs of a key's rows without a long gap, as inputs of a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a session that one step's call sees at most, unless the caller says otherwise.
MOST = 1000


def sessions(rows: DataFrame, by: str, at: str, gap: int, values: list[str], order: str | None = None, most: int = MOST) -> DataFrame:
    """``by``, began, part, rows: a session's rows (``at`` and ``values``) in order of time, at most ``most`` of them a part.

    A session ends where the next row of the key comes ``gap`` seconds later or
    more.  A longer session comes as several parts, numbered from 0, so that no
    call sees an unbounded group; equal times go by ``order``.  The windows
    sort a key's rows but never gather them: a window keeps one row of state.
    Rows without time take no part; those without key are one key.
    """
    row = F.struct(at, *values)
    inside = Window.partitionBy(by).orderBy(at, *([order] if order else []))
    since = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(inside).cast("timestamp"))
    opens = rows.where(F.col(at).isNotNull()).withColumn("__opens", F.when(since < gap * 1_000_000, None).otherwise(F.col(at)))
    began = opens.withColumn("began", F.last("__opens", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sort = F.struct(at, *([order] if order else []))
    number = F.row_number().over(Window.partitionBy(by, "began").orderBy(sort)) - 1
    placed = began.select(by, "began", F.floor(number / most).alias("part"), F.struct(sort.alias("k"), row.alias("v")).alias("__row"))
    grouped = placed.groupBy(by, "began", "part").agg(F.sort_array(F.collect_list("__row")).alias("r"))
    return grouped.select(by, "began", "part", F.transform("r", lambda x: x["v"]).alias("rows"))
