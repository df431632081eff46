"""Secrets and who owns them (operator 1), DataFrame functions only.

Patterns propose spans in every text.  The hash of each proposed value is then
counted over the whole corpus, by distinct repositories and owners: a value
that many owners carry is a copied example, one that a single owner holds in
a few repositories looks live.  Generic tokens become spans unless they are
copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import spread_join
from .spans import clear_of, count_of, listed, with_spans

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order in which equal starts are listed; the last is added by ownership.
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "token": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
BASE = ("assign", "access", "hex")
SHORTEST_ASSIGNED = 8
#: A value is live-looking up to so many owners and repositories, and copied from so many owners.
LIVE_OWNERS, LIVE_REPOSITORIES, COPIED_OWNERS = 1, 3, 3


def _shaped(kind: str, spans: Column) -> Column:
    """Spans of a kind that pass its check, with place, kind and the secret's hash."""
    secret = (lambda s: F.regexp_extract(s["value"], ASSIGN, 1)) if kind == "assign" else (lambda s: s["value"])
    place = list(PATTERNS).index(kind)
    passing = {
        "assign": lambda s: F.length(secret(s)) >= SHORTEST_ASSIGNED,
        "token": lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"),
    }.get(kind)
    kept = F.filter(spans, passing) if passing else spans
    return F.transform(
        kept,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            F.sha2(secret(s), 256).alias("hash"),
        ),
    )


def ownership(occurrences: DataFrame) -> DataFrame:
    """hash -> repositories, owners, verdict; every level is a partial aggregate, so no hash gathers its rows."""
    return (
        occurrences.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))
        .withColumn(
            "verdict",
            F.when((F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES), "live")
            .when(F.col("owners") >= COPIED_OWNERS, "copied").otherwise("unclear"),
        )
    )


def secret_scan(docs: DataFrame, repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """doc_id and spans: array of (start, place, end, kind, hash, repositories, owners, verdict), in order.

    Base spans (assign, access, hex) always stay; a token span is added where
    it overlaps no base span and its value isn't copied, with its verdict.  Null
    text counts as empty; a null owner or repository counts as one more; rows repeating a
    repository count it once.  One row per input row, none for an empty table;
    other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    narrow = docs.select(
        docs["doc_id"].alias("doc_id"),
        docs[repository_col].alias("repository"),
        docs[owner_col].alias("owner"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
    )
    found = with_spans(narrow, "text", PATTERNS)
    base = F.concat(*(_shaped(k, F.col(f"spans_{k}")) for k in BASE))
    found = found.select("doc_id", "repository", "owner", "row", base.alias("base"), _shaped("token", F.col("spans_token")).alias("tokens"))
    tokens = clear_of(F.col("tokens"), F.col("base"))
    found = scratch.keep(found.select("doc_id", "repository", "owner", "row", F.concat("base", tokens).alias("spans")), "found")
    occurrences = found.where(F.size("spans") > 0).select("repository", "owner", "row", F.explode("spans").alias("span")).withColumn("hash", F.col("span.hash"))
    judged = spread_join(occurrences, ownership(occurrences), "hash", "row").where("span.kind <> 'token' or verdict <> 'copied'")
    span = F.struct("span.start", "span.place", "span.end", "span.kind", "hash", "repositories", "owners", "verdict")
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("judged"))
    bare = found.where(F.size("spans") == 0).select("doc_id", F.lit(None).cast(by_row.schema["judged"].dataType).alias("judged"))
    full = found.where(F.size("spans") > 0).select("doc_id", "row").join(by_row, "row", "left").select("doc_id", "judged")
    empty = F.array().cast(by_row.schema["judged"].dataType)
    return full.unionByName(bare).select("doc_id", F.coalesce("judged", empty).alias("spans"))


def digest_columns(scanned: DataFrame) -> DataFrame:
    """The counts and digests that the query returns, and how many of the spans have each verdict."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "token")
    counts = [count_of(spans, "kind", k) for k in BASE]
    verdicts = [count_of(spans, "verdict", v) for v in ("live", "unclear", "copied")]
    return scanned.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"), *verdicts)
