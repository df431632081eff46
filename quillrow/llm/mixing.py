"""Mixing sources to target weights (operator 2).

Efraimidis-Spirakis sampling: every document draws an exponential key divided
by its quality weight; inside its source the documents are taken in key order
until the source's word budget is met.  Whole epochs come first and only the
fraction that is left is selected.  Prefix sums run in two levels (key buckets
per source, then rows inside one bucket), so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .carried import apart, row_hash
from .scratch import Scratch
from .skew import PARTS

#: Weights of the sources in code point order, repeating.
SOURCE_WEIGHTS = (5.0, 2.0, 1.0)
#: Key buckets of a source; the rows of one bucket are ordered exactly.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"
#: Weight of a document by its quality label; without a label it is 1.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}
SEED = "mix-1:"


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight of every labelled document; the best label of a repeated id counts."""
    weight = F.lit(1.0)
    for label, value in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("quality") == label, value).otherwise(weight)
    best = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", weight.alias("weight"))


def source_targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """source, source_size -> also target: budgets by weight, capped and reshared.

    Raising a common level until the budget is spent equals resharing the
    excess by weight again and again; sources fill up in order of cap/weight.
    Only one row per source meets here.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weights = F.array(*map(F.lit, SOURCE_WEIGHTS))
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumns(
        {
            "weight": F.get(weights, F.col("place") % len(SOURCE_WEIGHTS)),
            "cap": F.col("source_size") * F.lit(float(most)),
        }
    )
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    levels = ranked.withColumns(
        {
            "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
            "spent": F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("budget") - F.col("spent")) / F.col("open"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    level = F.max(fits).over(everything)  # levels rise up to the first that fits and fall after it
    return levels.withColumn("common", level).select(
        "source", "source_size", F.least("cap", F.coalesce("common", F.col("cap") / F.col("weight")) * F.col("weight")).alias("target")
    )


def mix_sources(
    docs: DataFrame, weights: DataFrame, share: float = 1.5, most: float = 2.0, buckets: int = BUCKETS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs``.

    ``size`` counts words (null text: 0); ``copies`` is how often the mix takes
    the whole document and ``taken`` the words of those copies.  A source's
    last selected document is the one that brings it nearest to its target.
    Null sources form one source that sorts last; null ids draw one common key
    and weigh 1.  Repeated rows count each.  The columns named in ``carry`` follow;
    texts never leave the scan.  All sources meet in one task, one row each.
    An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.coalesce(docs["text"], F.lit(""))
    draw = F.md5(F.concat(F.lit(SEED), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))))
    uniform = (F.conv(F.substring(draw, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    narrow = docs.select(
        docs["doc_id"].alias("doc_id"),
        docs["source"].alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        uniform.alias("uniform"),
        F.monotonically_increasing_id().alias("row"),
        *(docs[c].alias(f"__carry_{i}") for i, c in enumerate(carry)),
    )
    # rows without id find no weight; the second key spreads them over the join's partitions
    apart = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("row"), F.lit(PARTS))).otherwise(0)
    keys = {"__id": F.coalesce("doc_id", F.lit(0)), "__apart": apart}
    weighed = narrow.withColumns(keys).join(weights.select(F.col("doc_id").alias("__id"), F.lit(0).cast("long").alias("__apart"), "weight"), list(keys), "left").drop(*keys)
    drawn = (
        weighed.withColumn("key", -F.log("uniform") / F.coalesce("weight", F.lit(1.0)))
        .withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((1 - F.exp(-F.col("key"))) * buckets)).cast("int"))
        .drop("weight", "uniform")
    )
    drawn = scratch.keep(drawn, "drawn")
    filled = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(filled.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, most)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        filled.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
        .join(targets.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .select(
            F.col("source").alias("plan_source"), F.col("bucket").alias("plan_bucket"), "ahead", "source_size", "target", "epochs",
            (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"),
        )
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.asc_nulls_last("doc_id"), "row")
    before = F.col("ahead") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    taken = (
        drawn.join(plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("bucket") == F.col("plan_bucket")))
        .withColumn("before", before)
        .withColumn("selected", ((F.col("rest") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest"))).cast("long"))
        .withColumn("copies", F.col("epochs") + F.col("selected"))
    )
    carried = (F.col(f"__carry_{i}").alias(c) for i, c in enumerate(carry))
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carried)


def mixed_corpus(docs: DataFrame, weights: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns as they are.

    Rows meet their count by two hashes of all their columns, maps by their
    JSON text; rows repeated in full share one total.  Extra columns may have
    any name and type.  Null ids, texts and sources are as in ``mix_sources``.
    """
    docs, restore = apart(docs, ("doc_id", "text", "source"))
    marks = ["__mark_1", "__mark_2"]
    marked = docs.withColumns({m: row_hash(docs, m) for m in marks})
    plan = mix_sources(marked, weights, share, most, carry=tuple(marks))
    total = plan.groupBy(*marks).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).where("__copies > 0")
    taken = marked.join(total, marks)
    many = taken.where("__rows > 1").groupBy(*marks).agg(F.first(F.struct(*docs.columns)).alias("__row"), F.min("__copies").alias("__copies"))
    each = taken.where("__rows = 1").select(*docs.columns, "__copies").unionByName(many.select("__row.*", "__copies"))
    return restore(each.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))))
