"""The corpus pipeline against its stages done by brute force."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
from conftest import SMALL
from pyspark.sql import functions as F
from test_operators import awkward, brute_jaccard, brute_lines, empty, plain, sha, tokenizer  # noqa: F401

import corpus_pipeline
from quillrow.llm import language
from quillrow.llm.mixing import mix_sources, quality_weights


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, SMALL)
        assert done.columns == docs.columns and [f.dataType for f in done.schema] == [f.dataType for f in docs.schema]
    assert len(corpus_pipeline.STAGES) in (4, 5)


def test_stages_on_awkward_rows(spark, awkward, empty, monkeypatch):  # noqa: F811
    """Null texts and ids, repeated rows, ties, an empty table, long texts and columns of clashing names."""
    plain_docs = [(r.doc_id, r.text) for r in awkward.collect()]
    languages, lines, groups, mixing, tokens = (stage for _, stage in corpus_pipeline.STAGES)
    model = language.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    monkeypatch.setattr(language, "fit", lambda docs: model)
    told = {t: language.Model.predict(model, [t])[0] for _, t in plain_docs}
    stays = [(i, t) for i, t in plain_docs if told[t][0] != "und" and told[t][1] >= corpus_pipeline.LEAST_SCORE]
    kept = languages(spark, awkward, SMALL)
    assert kept.schema == awkward.schema and sorted(plain(kept), key=str) == sorted(stays, key=str) and None in [i for i, _ in stays]
    cut = lines(spark, awkward, SMALL)
    assert cut.columns == awkward.columns and sorted(plain(cut), key=str) == sorted(((i, t) for i, _, _, t in brute_lines(plain_docs)), key=str)
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    one = sorted(plain(groups(spark, awkward, SMALL)), key=str)
    components = brute_jaccard(plain_docs)
    assert len(one) == len({c for _, n, c in components if n}) + sum(n == 0 for _, n, _ in components) and (22, "dup text that comes twice") in one
    mixed = mixing(spark, awkward, SMALL)
    assert mixed.columns == awkward.columns and set(plain(mixed)) <= set(plain_docs)
    coded = tokens(spark, awkward, SMALL).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in coded if r.doc_id is not None) == sorted((i, sha(t or "")) for i, t in plain_docs if i is not None)
    for stage in (languages, lines, groups, mixing, tokens):
        assert stage(spark, empty, SMALL).count() == 0


CLASHES = [
    "n_lines", "n_dropped", "kept_text", "drops", "slice", "size", "copies", "taken", "row", "key", "bucket", "weight", "held_out", "n_tokens", "label", "id", "class_key",
    "__rows", "__copies", "__copy", "__row", "__mark", "__mark_1", "__mark_2", "__key", "__often", "__same_id", "__lang", "__score", "__id", "__text", "__rest_0",
    "__rest_1", "__carry_0", "__part", "__deal", "__owner", "__column_0", "a.b", "with `tick`",
]


def test_stages_on_columns_of_any_name_and_type(spark):
    """Every internal name as an extra column, and maps: each stage keeps them, with their values by the row."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(80)
    odd = docs.select("*", *(F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")).alias(c) for i, c in enumerate(CLASHES)), F.create_map(F.lit("k"), "doc_id").alias("a_map"))
    odd = odd.unionByName(odd.limit(5)).select(*(f"`{c.replace('`', '``')}`" for c in reversed(odd.columns))).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, odd, SMALL)
        assert done.columns == odd.columns and [f.dataType for f in done.schema] == [f.dataType for f in odd.schema], name
        rows = [r.asDict() for r in done.collect()]
        assert rows and all(r[c] == f"{i}-{r['doc_id']}" for r in rows for i, c in enumerate(CLASHES)) and all(r["a_map"] == {"k": r["doc_id"]} for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SMALL).count() == odd.count()


def test_mixing_takes_rows_as_often_as_it_says(spark, awkward):  # noqa: F811
    """The mixing stage's rows, counted, on awkward rows: those of mix_sources, by id."""
    weights = quality_weights(spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = Counter()
    for r in mix_sources(awkward, weights).collect():
        want[(r.doc_id, r.source)] += r.copies
    got = Counter((r.doc_id, r.source) for r in corpus_pipeline.STAGES[3][1](spark, awkward, SMALL).collect())
    assert got == +want


def test_run_keeps_only_its_last_table(spark):
    import glob

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{root}/quillrow/pipeline-*"))
    done = corpus_pipeline.run(spark, SMALL)
    assert done.count() > 0
    (folder,) = set(glob.glob(f"{root}/quillrow/pipeline-*")) - before
    assert [x.rsplit("/", 1)[1] for x in glob.glob(f"{folder}/*")] == ["stage-4"]


def test_pipeline_against_brute_force(spark, tokenizer):  # noqa: F811
    library = tokenizer[3]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    told = {r.doc_id for r in language.identify(docs, language.fit(docs)).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in told}
    assert len(rows) > 0.95 * docs.count()
    texts = {i: t for i, _, _, t in brute_lines([(i, r.text) for i, r in rows.items()])}
    kept = [i for i, _, component in brute_jaccard(list(texts.items())) if i == component]
    mixed = spark.createDataFrame([(i, texts[i], rows[i].source) for i in kept], "doc_id long, text string, source string")
    weights = quality_weights(spark.read.parquet(f"{SMALL}/labels.parquet"))
    copies = {r.doc_id: r.copies for r in mix_sources(mixed, weights).collect()}
    want = Counter()
    for i in kept:
        ids = np.array(library.encode_ordinary(texts[i]), "<u4")
        want[(i, len(ids), sha(ids.tobytes()), sha(texts[i]))] += copies[i]
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == +want and sum(got.values()) > 0
    assert re.match("byte", corpus_pipeline.VOCABULARY) and public_tokenizers.path(corpus_pipeline.VOCABULARY)
