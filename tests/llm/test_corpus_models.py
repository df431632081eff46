"""Whitening, language-model scoring and ranked search against brute force, on whole small tables and on awkward rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quillrow.llm import lm_scoring, ranked, whitening
from quillrow.llm.lm_scoring import score_texts
from quillrow.llm.queries import QUERIES
from quillrow.llm.ranked import rank_documents
from quillrow.llm.whitening import digest_columns, whiten

SPACE = r"[^\x20\x09-\x0D]+"
UPPER = {c: c + 32 for c in range(65, 91)}
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "One two one TWO"), (4, "One two one TWO"), (5, "é É ſ K"), (6, "a" * 70_000), (7, " ".join(f"w{i % 500}" for i in range(6_000))),
    (8, "x"), (9, "don't stop—now here there"), (None, "one two"), (None, None), (10, "one two one two three"), (11, "\x00one\x7ftwo\x80three日本"),
]


def texts(spark, rows=AWKWARD):
    clash = [(*r, 1, "x", 2, "y", 0.5) for r in rows]
    return spark.createDataFrame(clash, "doc_id long, text string, part int, block string, item long, tokens string, score double").repartition(3)


# whitening


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "vec_id long, embedding array<float>, component int, x string, v double").repartition(3)


def check_whitening(found, rows):
    """``found`` against numpy on the rows that take part."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    exact = (n * x - sums) ** 2
    centre = (n * x - sums).astype(float) / n
    covariance = centre.T @ centre / n
    variances, components = np.linalg.eigh(covariance)
    variances, components = variances[::-1], components[:, ::-1]
    kept = min(32, int((variances > 1e-10 * variances[0]).sum()))
    by_id = defaultdict(dict)
    for r in found:
        by_id[r.vec_id][r.component] = r
    assert len(found) == n * kept and len(by_id) == len({i for i, _ in rows})
    whitened = np.zeros((n, kept))
    for at, (vec_id, _) in enumerate(rows):
        for k in range(kept):
            r = by_id[vec_id][k + 1]
            assert (r.n, r.deviation) == (n, exact[at].sum())
            assert abs(r.explained / (variances[k] / variances.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
            whitened[at, k] = r.whitened
    wanted = centre @ components[:, :kept] / np.sqrt(variances[:kept])
    signs = np.sign((wanted * whitened).sum(0))
    assert np.abs(wanted * signs - whitened).max() < 1e-6


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitening(QUERIES["op11_whitening"](spark, SMALL).collect(), rows)


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(100, [0.0] * 5), (101, [-2.5, 1e4, 0.0, -0.0, 1e-30])]
    odd = [(200, None), (201, []), (202, [1.0] * 4), (203, [1.0, None, 1.0, 1.0, 1.0]), (204, [float("nan")] * 5), (205, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (206, [2e9] + [0.0] * 4)]
    check_whitening(digest_columns(whiten(vectors(spark, good + odd))).collect(), good)


def test_whitening_keeps_repeated_rows_and_rows_without_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 3.0])]
    found = whiten(vectors(spark, rows)).collect()
    assert len(found) == 8 and Counter(r.vec_id for r in found) == {1: 4, None: 4} and {r.n for r in found} == {4}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_whitening_without_variance_is_empty(spark, rows):
    assert whiten(vectors(spark, rows)).count() == 0


def test_whitening_is_exact_beyond_64_bits(spark):
    """Deviations of large entries, by Python's integers; what a long can't hold is null in the query's form."""
    rows = [(i, [float(1 << 29) * (i % 2), float(i), 1.0]) for i in range(6)]
    found = whiten(vectors(spark, rows))
    x = np.array([[int(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    exact = dict(enumerate(((6 * x - x.sum(0)) ** 2).sum(1)))
    assert {r.vec_id: int(r.deviation) for r in found.collect()} == exact
    assert {r.vec_id: r.deviation for r in digest_columns(found).collect()} == {i: d if d < 1 << 63 else None for i, d in exact.items()}


def test_whitening_asks_for_fewer_components_than_dimensions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=120).astype(np.float32).tolist()) for i in range(300)]
    check_whitening(whiten(vectors(spark, rows)).collect(), rows)


def test_centred_numerators_leave_64_bits_only_where_they_must():
    assert whitening.centred(np.array([[5, 7]]), 2, (10, 3)).tolist() == [[0, 11]]
    large = whitening.centred(np.array([[1 << 40]]), 1 << 30, (7,))
    assert large.dtype == object and large[0, 0] == (1 << 70) - 7


# language-model scoring


def fold(doc_id, folds):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def brute_scores(rows, deleted_ids, order):
    """What score_texts gives, from dictionaries: (doc_id, held_out, n_tokens, n_known, N, base, score) of each row."""
    words = [[*re.findall(SPACE, (t or "").translate(UPPER)), None] for _, t in rows]
    held = [fold(i, 7) == 2 for i, _ in rows]

    def grams(ws, k):
        padded = [False] * (k - 1) + ws
        return [tuple(padded[i : i + k]) for i in range(len(ws))]

    def counted(chosen):
        counts = [Counter(g for at in chosen for g in grams(words[at], k)) for k in range(1, order + 1)]
        return counts, len(chosen)

    train = [i for i in range(len(rows)) if not held[i]]
    gone = [i for i in train if rows[i][0] in deleted_ids]
    full, full_texts = counted(train)
    rest, rest_texts = counted([i for i in train if i not in gone])
    types = len(full[0])

    def parts(ws, counts, number):
        total = sum(counts[0].values())
        own = [None, *(grams(ws, k) for k in range(1, order + 1))]
        for at in range(len(ws)):
            estimate, bucket = [1 / (types + 1)] + [-1.0] * order, 0
            if total:
                estimate[1], bucket = counts[0][(ws[at],)] / total, 1
            for k in range(2, order + 1):
                context = number if at == 0 else counts[k - 2][own[k - 1][at - 1]]
                if context:
                    estimate[k], bucket = counts[k - 1][own[k][at]] / context, 2 + (k - 2) * lm_scoring.BUCKETS + min(int(math.log2(context)), lm_scoring.BUCKETS - 1)
            yield bucket, estimate

    weights = lm_scoring.even_weights(order)
    learn = [p for at in gone for p in parts(words[at], rest, rest_texts)]
    for _ in range(lm_scoring.ROUNDS):
        owed = np.zeros((lm_scoring.bucket_count(order), order + 1))
        for bucket, estimate in learn:
            share = [max(e, 0) * w for e, w in zip(estimate, weights[bucket], strict=True)]
            owed[bucket] += np.array(share) / sum(share)
        weights = lm_scoring.renewed(owed, order)
    n = sum(full[0].values())
    out = []
    for (doc_id, _), ws, out_of in zip(rows, words, held, strict=True):
        base = sum(math.log10((full[0][(w,)] + 1) / (n + types + 1)) for w in ws)
        score = sum(math.log10(sum(max(e, 0) * w for e, w in zip(estimate, weights[b], strict=True))) for b, estimate in parts(ws, full, full_texts))
        out.append((doc_id, out_of, len(ws), sum(full[0][(w,)] > 0 for w in ws), n, base, score))
    return out


def deleted_of(frame, deleted):
    return {r[0] for r in frame.where(lm_scoring._fit_fold(F.col("doc_id"), deleted)).select("doc_id").collect()}


def same_scores(found, wanted):
    found, wanted = (sorted(map(tuple, x), key=lambda r: (str(r[0]), *r[1:])) for x in (found, wanted))
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    assert np.allclose([f[5:] for f in found], [w[5:] for w in wanted], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_of_awkward_rows(spark, order, monkeypatch):
    """Several blocks and counting parts give what dictionaries give."""
    monkeypatch.setattr(lm_scoring, "PART_KEYS", 2000)
    frame = texts(spark, AWKWARD + [(i, f"one two {'three ' * (i % 4)}w{i % 7} W{i % 5}") for i in range(20, 120)])
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    found = score_texts(frame, order=order, deleted=4, block_bytes=2000).collect()
    same_scores(found, brute_scores(rows, deleted_of(frame, 4), order))


def test_scores_of_the_table(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    found = QUERIES["op12_lm_scoring"](spark, SMALL).collect()
    same_scores(found, brute_scores(rows, deleted_of(frame, lm_scoring.DELETED), lm_scoring.ORDER))
    held = [r for r in found if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_without_training_rows(spark):
    none = [(i, "a b") for i in range(200) if fold(i, 7) == 2]
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in score_texts(texts(spark, none)).collect()} == {(3, 0, 0, 0.0, 0.0)}
    assert score_texts(texts(spark, [])).count() == 0


def test_each_round_makes_the_deleted_texts_likelier():
    rng = np.random.default_rng(1)
    bucket, estimate = rng.integers(2, 9, 500), np.vstack([np.full(500, 0.01), rng.random((2, 500)) * [[0.1], [0.5]]])
    weights, before = lm_scoring.even_weights(2), -np.inf
    for _ in range(8):
        owed = lm_scoring.expected(bucket, estimate, weights, np.ones(500, np.int64))
        assert owed[:, -1].sum() > before
        before = owed[:, -1].sum()
        weights = lm_scoring.renewed(owed[:, :-1], 2)
    assert np.allclose(weights.sum(1), 1) and (weights[lm_scoring.orders_of(2)] > 0).all()


def test_probabilities_of_a_context_sum_to_one(spark):
    """Over all words seen, the end, and one unseen word, after any context."""
    counts = {"a": 3, "b": 2, None: 4}
    totals = lm_scoring.Totals(9, 3, 4)
    weights = lm_scoring.renewed(np.zeros((lm_scoring.bucket_count(2), 3)), 2)
    for pairs, context in (({"a": 1, "b": 1, None: 1}, 3), ({}, 0)):
        total = 0.0
        for w in ("a", "b", None, "unseen"):
            ones, twos = np.array([context, counts.get(w, 0)]), np.array([0, pairs.get(w, 0)])
            bucket, estimate = lm_scoring.estimates([ones, twos], np.array([0]), totals)
            total += (np.maximum(estimate[:, 1], 0) * weights[bucket[1]]).sum()
        assert abs(total - 1) < 1e-12


def test_packed_numbers_come_back():
    for kind in (np.uint32, np.uint64, np.int64):
        for values in ([], [0], [1, 2, 2**31], list(range(5000))):
            assert lm_scoring._unpacked(lm_scoring._packed(np.array(values, kind)), kind).tolist() == values


# ranked search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def brute_ranks(docs, items, best=10):
    split = [(i, Counter(re.findall(TERM, (t or "").translate(UPPER)))) for i, t in docs]
    split = [(i, c, c.total()) for i, c in split if c]
    big_n, big_l = len(split), sum(n for _, _, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = []
    for item_id, text in items:
        wanted = Counter(re.findall(TERM, (text or "").translate(UPPER)))
        scores = []
        for doc_id, c, n in split:
            m = 25 + 75 * n * big_n // big_l
            s = sum(q * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in wanted.items() if c[t])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2, 1 << 20])
def test_ranks_of_awkward_rows(spark, block, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_DOCUMENTS", 7 if block == 2 else 8192)
    monkeypatch.setattr(ranked, "BLOCK_ENTRIES", 20 if block == 2 else 1 << 21)
    docs = AWKWARD + [(i, "one two three") for i in range(50, 75)] + [(80 + i, f"term{i} one " * (i + 1)) for i in range(6)]
    items = [(1, "one"), (2, "ONE one two"), (3, None), (4, ""), (5, "nowhere"), (6, "term1 term5 w3 w3 w4"), (None, "two"), (7, "two"), (7, "three 日本"), (8, "don t stop—now")]
    found = rank_documents(texts(spark, docs), spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, rank int, score string").repartition(2), block_terms=block)
    assert sorted(map(tuple, found.collect()), key=str) == brute_ranks(docs, items)


def test_ranks_of_empty_tables(spark):
    none, items = texts(spark, []), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert rank_documents(none, items).count() == 0
    assert rank_documents(texts(spark), items.limit(0)).count() == 0
    assert rank_documents(texts(spark, [(1, None), (2, "!")]), items).count() == 0
