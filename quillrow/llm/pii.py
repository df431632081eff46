"""Personal data (operator 10), DataFrame functions only.

Regular expressions propose spans, validators (octet range, Luhn, mod-97,
digit counts) confirm them, and words near a span adjust its score.  Spans of
the four base kinds stay whatever their score; account numbers and national
phone numbers are added when their score reaches the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import clear_of, count_of, listed, with_spans

#: Kinds in the order in which equal starts are listed.  Possessive forms match
#: the same spans as the plain ones, without recursion or quadratic scanning.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}",
    "local": r"0[0-9]{2,4}[\x20/-][0-9](?:[\x20-]?[0-9]){5,9}",
}
BASE = ("email", "ip", "card", "phone")
#: Words that raise the score of a span within CONTEXT code points.
CONTEXT_WORDS = {
    "email": "mail|e-mail|email|contact|kontakt|contacto|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "local": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
}
CONTEXT = 40
#: Score of a proposed span, and what a passed checksum and a context word add.
PROPOSED, CHECKED, NEARBY, THRESHOLD = 0.5, 0.3, 0.2, 0.7
CHECKSUMMED = ("card", "iban")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """Remainder of an account number, letters as 10 to 35, its first four characters last."""
    packed = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(packed, F.lit(5)), F.left(packed, F.lit(4)))
    return F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda rest, c: F.when(c <= "9", (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97),
    )


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"),
    "card": lambda v: F.length(_digits(v)).between(14, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
    "iban": lambda v: _mod97(v) == 1,
    "local": lambda v: F.length(_digits(v)).between(9, 13),
}


def _confirmed(kind: str, spans: Column) -> Column:
    near = rf"(?iu)(?:^|[^\p{{L}}])(?:{CONTEXT_WORDS[kind]})(?:$|[^\p{{L}}])"
    first = PROPOSED + (CHECKED if kind in CHECKSUMMED else 0.0)
    place = list(PATTERNS).index(kind)
    return F.transform(
        F.filter(spans, lambda s: VALID[kind](s["value"])),
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            F.when(F.concat_ws("|", s["left"], s["right"]).rlike(near), round(first + NEARBY, 2)).otherwise(first).alias("score"),
        ),
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (start, place, end, kind, score), in order.

    Null text counts as empty.  Added spans (iban, local) reach THRESHOLD and
    overlap no base span.  One row per input row, repeated rows included, none
    for an empty table; other columns are ignored, whatever their names.
    """
    narrow = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    found = with_spans(narrow, "text", PATTERNS, CONTEXT)
    base = F.concat(*(_confirmed(k, F.col(f"spans_{k}")) for k in BASE))
    more = F.concat(*(_confirmed(k, F.col(f"spans_{k}")) for k in PATTERNS if k not in BASE))
    found = found.select("doc_id", base.alias("base"), more.alias("more"))
    added = clear_of(F.filter("more", lambda s: s["score"] >= THRESHOLD), F.col("base"))
    return found.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def digest_columns(scanned: DataFrame) -> DataFrame:
    """The counts and digests that the query returns."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    counts = [count_of(spans, "kind", k) for k in PATTERNS]
    return scanned.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))
