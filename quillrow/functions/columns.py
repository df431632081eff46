"""Enrichment rules as column expressions, so they stay inside generated code."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Answers that mean "no answer", compared without case and outer white space.
REFUSALS = (
    "unable to determine",
    "n/a",
    "not available",
    "not specified",
    "insufficient data",
    "unknown",
    "not enough information",
    "cannot determine",
    "no data",
    "no information",
    "not applicable",
    "data not available",
    "information not available",
)
#: Outer white space as Python's str.strip sees it.
_OUTER = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def is_refusal(text: Column) -> Column:
    """Null, blank, or one of REFUSALS."""
    plain = F.lower(F.regexp_replace(text, _OUTER, ""))
    return F.coalesce(plain.isin("", *REFUSALS), F.lit(True))


def with_default(value: Column, default: Any, text: bool = True) -> Column:
    """The value, or the default where it is a refusal (only text can refuse in words)."""
    missing = is_refusal(value) if text else value.isNull()
    return F.when(missing, F.lit(default)).otherwise(value)


def is_filled(value: Column, kind: T.DataType) -> Column:
    """Whether an existing cell counts as filled: not null, not NaN, not the empty string."""
    filled = value.isNotNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        filled &= ~F.isnan(value)
    if isinstance(kind, T.StringType):
        filled &= value != ""
    return filled


def merged(old: Column, kind: T.DataType, new: Column, overwrite: bool) -> Column:
    """A column after enrichment: filled cells stay unless overwriting."""
    return new if overwrite else F.when(is_filled(old, kind), old).otherwise(new)


def row_json(columns: list[str], frame: DataFrame) -> Column:
    """Canonical JSON of some columns: sorted by name, nulls kept."""
    return F.to_json(F.struct(*(frame[f"`{c}`"].alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def cache_key(static: str, row: Column, prior: Column) -> Column:
    """Hash of what a step's answer for a row depends on."""
    return F.sha2(F.concat_ws("\u001e", F.lit(static), row, prior), 256)


def first_citations(citations: Column) -> Column:
    """Citations with a url, the first of each url, in order."""
    kind = "array<struct<url:string,title:string,snippet:string>>"
    return F.aggregate(
        citations.cast(kind),
        F.array().cast(kind),
        lambda kept, x: F.when(
            x["url"].isNull() | (x["url"] == "") | F.exists(kept, lambda y: y["url"] == x["url"]), kept
        ).otherwise(F.concat(kept, F.array(x))),
    )


def render(template: str, columns: dict[str, Column]) -> Column:
    """``{name}`` templates over columns; null renders as None, an unknown name is an error."""
    import string

    parts = []
    for literal, name, spec, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in columns:
                raise ValueError(f"template field {name!r} is not among {', '.join(sorted(columns))}")
            if spec:
                raise ValueError("format specifications need a function step")
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def whole_json(text: Column) -> Column:
    """Text as a variant; null where it isn't JSON, or JSON with more behind it, which Spark's parser would not look at."""
    mark = F.sha2(text, 256)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    read = (F.try_variant_get(both, "$[1]", "string") == mark) & (F.size(F.try_variant_get(both, "$", "array<variant>")) == 2)
    return F.when(read, F.try_variant_get(both, "$[0]", "variant"))


def list_cell(cell: Column) -> Column:
    """A cell as an array of texts: a JSON array's elements as they are, else the comma-separated parts, trimmed, without empty ones.

    Elements that are not texts come as their JSON text; a cell that only
    begins like an array is split at its commas.
    """
    parts = F.filter(F.transform(F.split(cell, ","), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.trim(cell)
    whole = F.when(plain.startswith("["), F.try_variant_get(whole_json(plain), "$", "array<variant>"))
    return F.coalesce(F.transform(whole, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("null"))), parts)
