"""Exact duplicates by content sort (operator 9), DataFrame functions only.

Normalised texts are dealt to ranges by sampled splitters over their leading
bytes and a digest, which brings equal texts to one range, and are sorted there
externally by their bytes; each is compared in full with its neighbour, and a
run of equals keeps its best row.  The digest only spreads texts with one
beginning over ranges; it decides nothing.  A text that a sample shows to be
frequent is salted into parts of about equal size, so that splitters can cut
inside its group; the parts' representatives are then compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Removed before texts are compared.
WHITE_SPACE = r"[\x20\x09-\x0D]"
#: Bytes of a text that the splitters see; bounds what sampling sends to the driver.
LEADING_BYTES = 24
#: Rows of the sample that shows frequent texts, and how often one occurs there; the quotient bounds their number.
SAMPLE, FREQUENT = 1 << 16, 16


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _keyed(rows: DataFrame) -> DataFrame:
    body = F.regexp_replace("text", WHITE_SPACE, "")
    keyed = rows.select("doc_id", F.length("text").alias("points"), body.alias("body"), "row")
    return keyed.select("*", _digest(F.col("body")).alias("digest"), F.substring(F.col("body").cast("binary"), 1, LEADING_BYTES).alias("leading"))


def _frequent(rows: DataFrame) -> DataFrame:
    """leading, digest, parts of the texts that are frequent in a sample: SAMPLE / FREQUENT rows and parts at most, or about that."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    sample = _keyed(rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))))
    often = sample.groupBy("leading", "digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    return often.select("leading", "digest", F.ceil(F.col("n") / FREQUENT).alias("parts"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; the longest original
    (code points) stays, then the smallest id.  Null text counts as empty, so
    all null and blank texts form one group.  Null ids sort last and may be
    the keep_id only of a group without other ids.  Of rows repeated in full
    exactly one is kept.  Texts of any length are compared whole.  An empty
    table gives an empty result; other columns are ignored, whatever their
    names.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    often = scratch.keep(_frequent(base), "frequent")
    salt = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0))
    salted = _keyed(base).join(F.broadcast(often), ["leading", "digest"], "left").withColumn("salt", salt)  # SAMPLE / FREQUENT rows or so

    place = ["leading", "digest", "salt"]
    order = Window.partitionBy(*place).orderBy("body", F.desc("points"), F.asc_nulls_last("doc_id"), "row")
    differs = (~F.col("body").eqNullSafe(F.lag("body").over(order))).cast("int")
    runs = (
        salted.repartitionByRange(*place)
        .withColumn("first", differs)
        .withColumn("run", F.sum("first").over(order))
        .select(*place, "run", "doc_id", "points", "row", "parts", F.when(F.col("parts").isNotNull() & (F.col("first") == 1), F.col("body")).alias("body"))
    )
    run = Window.partitionBy(*place, "run")
    best = F.struct(-F.col("points"), F.isnull("doc_id").alias("no_id"), "doc_id", "row")
    rows = scratch.keep(runs.withColumns({"n": F.count(F.lit(1)).over(run), "best": F.min(best).over(run)}).drop("points"), "runs")

    # parts of frequent texts: their runs' first texts, one a part and run, meet in content order
    same = Window.partitionBy("leading", "digest").orderBy("body", "salt")
    first = rows.where("body is not null").withColumn("differs", (~F.col("body").eqNullSafe(F.lag("body").over(same))).cast("int"))
    first = first.select(*place, "run", "n", "best", F.sum("differs").over(same).alias("variant"))
    whole = Window.partitionBy("leading", "digest", "variant")
    first = first.select(*place, "run", F.sum("n").over(whole).alias("n"), F.min("best").over(whole).alias("best"))
    split = rows.where("parts is not null").drop("n", "best").join(first, [*place, "run"])
    return rows.where("parts is null").select("doc_id", "row", "digest", "n", "best").unionByName(split.select("doc_id", "row", "digest", "n", "best")).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
