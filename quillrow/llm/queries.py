"""The queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, language, lm_scoring, pii, ranked, secrets, span_sql, toxicity, whitening
from .exact_dedup import exact_dedup
from .jaccard import jaccard_components
from .line_dedup import line_dedup
from .mixing import mix_sources, quality_weights
from .neighbours import nearest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.secret_scan(table(spark, sf_dir, "documents")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_corpus(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.digest_columns(byte_bpe.decode_corpus(encoded, path))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest_columns(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_mix_sources, op3_line_dedup, op4_neighbours, op5_toxicity, op6_jaccard_join, op7_byte_bpe, op8_language, op9_exact_dedup, op10_personal_data, op11_whitening, op12_lm_scoring, op13_ranked_search)}

ORACLE_SQL = {
    "op1_secret_scan": span_sql.secrets_sql(),
    "op10_personal_data": span_sql.personal_sql(),
    "op2_mix_sources": r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5)
               / 281474976710656.0 AS u
    FROM documents
), best AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id
), keyed AS (
    SELECT sized.*, -ln(u) / CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS draw
    FROM sized LEFT JOIN best USING (doc_id)
), ranked AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight,
           row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM keyed GROUP BY source
), levels AS (
    SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, place
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
           / sum(weight) OVER (ORDER BY 2.0 * source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM ranked
), targets AS (
    SELECT source, source_size, CAST(least(2.0 * source_size, weight * coalesce(
               max(CASE WHEN level <= 2.0 * source_size / weight THEN level END) OVER (), 2.0 * source_size / weight)) AS DOUBLE) AS target
    FROM levels
), budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets
), placed AS (
    SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
           sum(k.size) OVER (PARTITION BY k.source ORDER BY k.draw, k.doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) - k.size AS ahead
    FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       CAST((epochs + CASE WHEN rest > 0 AND ahead + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
""",
    "op3_line_dedup": r"""
WITH split AS (
    SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT row_no, doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM split
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
    SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
    SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.first_id AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id
""",
    "op6_jaccard_join": r"""
WITH RECURSIVE worded AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM worded
), flat AS (SELECT r, unnest(s) AS shingle FROM sets
), pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM flat a JOIN flat b USING (shingle) WHERE a.r <> b.r GROUP BY a.r, b.r
), links AS (
    SELECT x, y FROM pairs JOIN sets a ON a.r = x JOIN sets b ON b.r = y WHERE 100 * n >= 80 * (len(a.s) + len(b.s) - n)
), reached AS (SELECT r AS x, r AS y FROM sets UNION SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x)
SELECT a.doc_id, CAST(len(a.s) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id
FROM reached JOIN sets a ON a.r = x JOIN sets b ON b.r = y GROUP BY a.r, a.doc_id, a.s
""",
    "op13_ranked_search": r"""
WITH words AS (
    SELECT row_number() OVER () AS row_no, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), docs AS (SELECT row_no, doc_id, CAST(len(terms) AS HUGEINT) AS n, terms FROM words WHERE len(terms) > 0
), totals AS (SELECT CAST(count(*) AS HUGEINT) AS big_n, CAST(sum(n) AS HUGEINT) AS big_l FROM docs
), items AS (
    SELECT row_number() OVER () AS item_no, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), wanted AS (SELECT item_no, item_id, term, count(*) AS times FROM items GROUP BY ALL
), flat AS (SELECT row_no, doc_id, n, unnest(terms) AS term FROM docs
), postings AS (
    SELECT row_no, doc_id, n, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weighed AS (
    SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS HUGEINT) AS w
    FROM postings, totals GROUP BY term, big_n
), scored AS (
    SELECT item_no, item_id, row_no, doc_id,
           sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l)))) AS score
    FROM wanted JOIN postings USING (term) JOIN weighed USING (term), totals GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0
)
SELECT item_id, CAST(place AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE place <= 10
""",
    "op9_exact_dedup": r"""
WITH normal AS (
    SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
    FROM documents
), ranked AS (
    SELECT doc_id, sha256(body) AS text_sha256,
           first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
           row_number() OVER best = 1 AS kept
    FROM normal WINDOW best AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ranked
""",
}
