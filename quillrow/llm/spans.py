"""Places of regular expression matches as DataFrame expressions.

Matches are fenced with a control character that no pattern can match, the
text is split there, and prefix sums over the piece lengths give each match's
code point offsets.  Sums run in blocks, so their cost stays near linear in
the number of matches however long a text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCE, STAND_IN = "\u0001", "\u0002"
#: Pieces whose lengths are summed in one sweep.
SWEEP = 256


def _sums(lengths: Column) -> Column:
    """struct(total, starts) of an array of ints."""
    zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        lengths,
        zero,
        lambda acc, n: F.struct((acc["total"] + n).alias("total"), F.concat(acc["starts"], F.array(acc["total"])).alias("starts")),
    )


def _swept(parts: Column) -> Column:
    """Sums of the piece lengths of each block of SWEEP pieces."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / SWEEP).cast("int"))
    return F.transform(numbers, lambda b: _sums(F.transform(F.slice(parts, b * SWEEP + 1, SWEEP), F.length)))


def with_spans(frame: DataFrame, text: str, patterns: dict[str, str], context: int = 0) -> DataFrame:
    """``frame`` with a column spans_<kind> for each pattern, the text column gone.

    A span has start and end (code points, end exclusive), value, and left and
    right: up to ``context`` code points beside it, cut at the kind's
    neighbouring matches.  Matches are leftmost and do not overlap.
    """
    keep = [c for c in frame.columns if c != text]
    safe = F.replace(F.col(text), F.lit(FENCE), F.lit(STAND_IN))
    split = {k: F.split(F.regexp_replace(safe, p, f"{FENCE}$0{FENCE}"), FENCE).alias(f"__p_{k}") for k, p in patterns.items()}
    frame = frame.select(*keep, *split.values())
    parts = {k: F.col(f"__p_{k}") for k in patterns}
    blocks = {k: _swept(p) for k, p in parts.items()}
    frame = frame.select(*keep, *parts.values(), *(b.alias(f"__b_{k}") for k, b in blocks.items()))
    starts = {
        k: F.flatten(
            F.zip_with(
                F.transform(F.col(f"__b_{k}"), lambda b: b["starts"]),
                _sums(F.transform(F.col(f"__b_{k}"), lambda b: b["total"]))["starts"],
                lambda own, ahead: F.transform(own, lambda s: s + ahead),
            )
        )
        for k in patterns
    }
    frame = frame.select(*keep, *parts.values(), *(s.alias(f"__s_{k}") for k, s in starts.items()))

    def spans(k: str) -> Column:
        p, s = parts[k], F.col(f"__s_{k}")

        def one(i: Column) -> Column:
            beside = [F.right(F.get(p, i - 1), F.lit(context)), F.left(F.get(p, i + 1), F.lit(context))] if context else [F.lit(""), F.lit("")]
            return F.struct(
                F.get(s, i).alias("start"), F.get(s, i + 1).alias("end"), F.get(p, i).alias("value"),
                beside[0].alias("left"), beside[1].alias("right"),
            )

        found = F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), one)
        return F.when(F.size(p) > 1, found).otherwise(F.expr("filter(array(struct(0 start, 0 end, '' value, '' left, '' right)), x -> false)"))

    return frame.select(*keep, *(spans(k).alias(f"spans_{k}") for k in patterns))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans with fields start, place, end, kind, sorted so and comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others.

    The others are sorted by start and cut into about as many blocks as a block
    has members, so a span is compared with the blocks' bounds and with the
    members of the few blocks that it touches.
    """

    def touching(span: Column, start: Column, end: Column) -> Column:
        return (start < span["end"]) & (span["start"] < end)

    def blocks(ordered: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(ordered).cast("double"))).cast("int")
        numbers = F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / size).cast("int"))
        parts = F.transform(numbers, lambda i: F.slice(ordered, i * size + 1, size))
        return F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0))["start"].alias("start"), F.array_max(F.transform(p, lambda o: o["end"])).alias("end"), p.alias("members")))

    def kept(cut: Column) -> Column:
        hit = lambda s: F.exists(cut, lambda b: touching(s, b["start"], b["end"]) & F.exists(b["members"], lambda o: touching(s, o["start"], o["end"])))
        return F.filter(spans, lambda s: ~hit(s))

    none = (F.size(spans) == 0) | (F.size(others) == 0)
    return F.when(none, spans).otherwise(_let(_let(F.array_sort(others), blocks), kept))


def count_of(spans: Column, field: str, value: str) -> Column:
    return F.size(F.filter(spans, lambda s: s[field] == value)).cast("long").alias(f"n_{value}")
