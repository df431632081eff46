"""A corpus pipeline: five stages, each written and read again before the next.

The stages rewrite or thin the ``documents`` table in order: documents whose
language can't be told go, lines repeated across documents go, one document of
each near-duplicate group stays, sources are mixed to target weights, and what
is left is encoded to token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrow.llm import byte_bpe, language
from quillrow.llm.carried import apart, quoted
from quillrow.llm.jaccard import keep_one_of_each
from quillrow.llm.line_dedup import without_repeats
from quillrow.llm.mixing import mixed_corpus, quality_weights
from quillrow.llm.scratch import Scratch

#: Mean posterior below which a document's language is not accepted.
LEAST_SCORE = 0.3
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null, empty and letterless texts, and scores below LEAST_SCORE.

    Every row is judged for itself, so repeated rows and rows without id fare
    alike; without any labelled row all go.  Long texts are read whole.  Extra
    columns may have any name and type, here and in the stages after.
    """
    named, restore = apart(docs, ("doc_id", "text", "lang"))
    labelled = language.identify(named, language.fit(named), carry=True)
    return restore(labelled.where((F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows the text.

    No row goes.  Rows that repeat an id are one document, rows without id one
    after all others; a null text becomes empty.
    """
    kept = without_repeats(docs)
    n_chars = F.length("text").cast("long").alias("n_chars")
    return kept.select(*(n_chars if c == "n_chars" else kept[quoted(c)] for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the row with the smallest doc_id stays, one without id only where none has one.

    Of rows repeated in full one stays; rows without words stay all.
    """
    return keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; null texts have no words, null sources are one source, null ids weigh 1."""
    return mixed_corpus(docs, quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, one row per row taken; a null text has no tokens."""
    path = public_tokenizers.path(VOCABULARY)
    return byte_bpe.digest_columns(byte_bpe.decode_corpus(byte_bpe.encode_corpus(docs, path, public_tokenizers.PATTERN), path))


STAGES = [
    ("language ID", keep_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", encode),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{number}")
        scratch.discard_but(f"stage-{number}")
    return docs
