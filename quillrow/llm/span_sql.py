"""DuckDB SQL of the two span queries; patterns, words and limits are written out here and not taken from the operators."""

from __future__ import annotations

BESIDE = 40
SECRET_PATTERNS = {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
PERSONAL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}",
    "local": r"0[0-9]{2,4}[\x20/-][0-9](?:[\x20-]?[0-9]){5,9}",
}
NEAR_WORDS = {
    "email": "mail|e-mail|email|contact|kontakt|contacto|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "local": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(kind: str, place: int, pattern: str) -> str:
    """row_no, kind, place, s, e, piece, beside of a pattern's matches; offsets by running sums over the pieces."""
    return f"""SELECT row_no, '{kind}' AS kind, {place} AS place, CAST(e - length(piece) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, piece, beside FROM (
    SELECT row_no, pos, piece, sum(length(piece)) OVER (PARTITION BY row_no ORDER BY pos) AS e,
           right(lag(piece) OVER (PARTITION BY row_no ORDER BY pos), {BESIDE}) || '|' || left(lead(piece) OVER (PARTITION BY row_no ORDER BY pos), {BESIDE}) AS beside
    FROM (SELECT row_no, unnest(parts) AS piece, generate_subscripts(parts, 1) AS pos FROM (
        SELECT row_no, string_split(regexp_replace(t, {_quoted("(" + pattern + ")")}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM texts) WHERE len(parts) > 1)
) WHERE pos % 2 = 0"""


_TEXTS = "texts AS (SELECT row_number() OVER () AS row_no, doc_id, {more}replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents)"
_LIST = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place, e){only}, '')"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def secrets_sql() -> str:
    words = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
    assign = rf"""(?:{words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    base = " UNION ALL ".join(f"({_matches(k, i, p)})" for i, (k, p) in enumerate([("assign", assign), *SECRET_PATTERNS.items()]))
    tokens = _matches("token", 3, r"[A-Za-z0-9+/_=-]{20,}")
    return rf"""
WITH {_TEXTS.format(more="source, ")},
base AS (
    SELECT *, CASE kind WHEN 'assign' THEN regexp_extract(piece, {_quoted(assign)}, 1) ELSE piece END AS value FROM ({base})
), kept AS (SELECT row_no, kind, place, s, e, value FROM base WHERE kind <> 'assign' OR length(value) >= 8
), tokens AS (
    SELECT row_no, kind, place, s, e, piece AS value FROM ({tokens}) m
    WHERE regexp_matches(piece, '[0-9]') AND regexp_matches(piece, '[A-Z]') AND regexp_matches(piece, '[a-z]')
      AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.row_no = m.row_no AND k.s < m.e AND m.s < k.e)
), occurrences AS (SELECT * FROM kept UNION ALL SELECT * FROM tokens
), counted AS (
    SELECT value, count(DISTINCT coalesce('s' || source, 'n')) AS owners,
           count(DISTINCT coalesce('s' || source, 'n') || chr(1) || coalesce(CAST(doc_id AS VARCHAR), '')) AS repositories
    FROM occurrences JOIN texts USING (row_no) GROUP BY value
), judged AS (
    SELECT o.*, CASE WHEN owners <= 1 AND repositories <= 3 THEN 'live'
                     WHEN owners >= 3 THEN 'copied' ELSE 'unclear' END AS verdict
    FROM occurrences o JOIN counted USING (value)
), spans AS (SELECT * FROM judged WHERE kind <> 'token' OR verdict <> 'copied')
SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex, sha256({_LIST.format(only=" FILTER (WHERE kind <> 'token')")}) AS base_sha256,
       {_LIST.format(only="")} AS spans, count(*) FILTER (WHERE verdict = 'live') AS n_live,
       count(*) FILTER (WHERE verdict = 'unclear') AS n_unclear, count(*) FILTER (WHERE verdict = 'copied') AS n_copied
FROM texts LEFT JOIN spans USING (row_no) GROUP BY row_no, doc_id
"""


def personal_sql() -> str:
    found = " UNION ALL ".join(f"({_matches(k, i, p)})" for i, (k, p) in enumerate(PERSONAL_PATTERNS.items()))
    near = " ".join(f"WHEN '{k}' THEN regexp_matches(beside, '(?i)(?:^|[^\\p{{L}}])(?:{w})(?:$|[^\\p{{L}}])')" for k, w in NEAR_WORDS.items())
    base, summed = "'email', 'ip', 'card', 'phone'", "'card', 'iban'"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in PERSONAL_PATTERNS)
    return rf"""
WITH {_TEXTS.format(more="")},
found AS (
    SELECT *, regexp_replace(piece, '[^0-9]', '', 'g') AS digits, replace(piece, ' ', '') AS packed, CASE kind {near} END AS near FROM ({found})
), valid AS (
    SELECT *, (CASE WHEN kind IN ({summed}) THEN 0.8 ELSE 0.5 END) + CASE WHEN near THEN 0.2 ELSE 0 END AS score FROM found
    WHERE CASE kind
        WHEN 'email' THEN true
        WHEN 'ip' THEN regexp_matches(piece, '^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){{4}}$')
        WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(digits)),
            lambda i: CASE WHEN i % 2 = 0 THEN CAST(digits[length(digits) - i] AS INT) ELSE CAST(digits[length(digits) - i] AS INT) * 2
                      - CASE WHEN CAST(digits[length(digits) - i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
        WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
        WHEN 'iban' THEN list_reduce(list_transform(string_split(substr(packed, 5) || left(packed, 4), ''),
            lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda rest, x: (rest * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97, 0) = 1
        ELSE length(digits) BETWEEN 9 AND 13 END
), spans AS (
    SELECT * FROM valid v WHERE kind IN ({base})
    UNION ALL SELECT * FROM valid v WHERE kind NOT IN ({base}) AND score >= 0.7 - 1e-9
        AND NOT EXISTS (SELECT 1 FROM valid b WHERE b.kind IN ({base}) AND b.row_no = v.row_no AND b.s < v.e AND v.s < b.e)
)
SELECT doc_id, {counts}, sha256({_LIST.format(only=f" FILTER (WHERE kind IN ({base}))")}) AS base_sha256, {_LIST.format(only="")} AS spans
FROM texts LEFT JOIN spans USING (row_no) GROUP BY row_no, doc_id
"""
