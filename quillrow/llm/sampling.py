"""Bounded samples on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: How far above the bound the expected number of rows that reach the driver lies.
SLACK = 1.25


def sampled(rows: DataFrame, bound: int) -> list[Row]:
    """At most ``bound`` rows, the same ones each time: those whose hash is smallest.

    The hash threshold follows from the row count, so that about SLACK * bound
    rows leave the executors in all, however many tasks there are; rows equal
    in everything share a hash, and a limit holds off masses of them.
    """
    total = rows.count()
    if not total:
        return []
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40))
    share = min(1.0, SLACK * (bound + 3 * bound**0.5) / total)
    found = rows.withColumn("__place", place).where(F.col("__place") <= int(share * (1 << 40))).limit(2 * bound + 100).collect()
    found.sort(key=lambda r: (r["__place"], str(r[0])))
    return found[:bound]


def sampled_by(rows: DataFrame, column: str, bound: int) -> list[Row]:
    """At most ``bound`` rows of each value of ``column``, the same ones each time.

    As ``sampled``, with a hash threshold for each value that follows from its
    row count.  The values are labels: there are few, and each brings its bound.
    """
    counts = [(r[0], r[1]) for r in rows.groupBy(column).count().collect()]
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40))
    wanted = bound + 3 * bound**0.5
    within = {value: int(min(1.0, SLACK * wanted / total) * (1 << 40)) for value, total in counts}
    if not within:
        return []
    limit = F.create_map(*(F.lit(x) for pair in within.items() for x in pair))
    found = rows.withColumn("__place", place).where(F.col("__place") <= limit[F.col(column)]).limit(len(within) * (2 * bound + 100)).collect()
    found.sort(key=lambda r: (str(r[column]), r["__place"], str(r[0])))
    kept: dict[object, list[Row]] = {}
    for r in found:
        kept.setdefault(r[column], []).append(r)
    return [r for group in kept.values() for r in group[:bound]]
