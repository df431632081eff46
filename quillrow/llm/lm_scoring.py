"""Language-model scoring by deleted interpolation (operator 12).

Maximum-likelihood estimates of each order are mixed with weights that depend
on how often the context was seen.  The weights are learned by
expectation-maximisation on documents whose counts are deleted from the
training counts; the scores then use the counts of all training documents.

Texts become blocks of numbered words.  A block sends each of its distinct
n-grams once, as 64-bit hashes in sorted runs, to the part of the hash range
that counts it, and gets the corpus-wide counts back in the same order, so
what is exchanged are distinct n-grams of blocks and never a row a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import sliced
from .held import Remembered, give_back, tidy
from .scratch import Scratch
from .subwords import in_fold

#: Longest n-grams, in words.
ORDER = 2
#: Training documents whose counts are deleted to learn the weights: one in so many.
DELETED = 20
#: Bytes of the texts of a block, unless one text alone has more.
BLOCK_BYTES = 1 << 23
#: Distinct n-grams of all blocks that one counting task takes, about.
PART_KEYS = 1 << 20
#: Bits of a context's frequency, each a bucket; frequencies beyond share the last.
BUCKETS = 24
ROUNDS = 12
#: Tokens that each weight of a bucket is given beside those it earned, so that none becomes zero.
LEAST_TOKENS = 0.01
#: Hashes of words that a worker remembers.
WORDS = 1 << 18
END, START = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" start")  # no word holds a space
BLOCK = "block long, fit boolean, ids array<long>, held array<boolean>, lengths binary, words binary, tokens binary, keys long, counted long, documents long"


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased; bytes split at the ASCII white space that the words leave out."""
    return (text or b"").lower().split()


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: high bytes are mostly zero."""
    size = len(values).to_bytes(8, "little")
    if not len(values):
        return size
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T)
    return size + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(blob[8:], n * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _mixed(older: np.ndarray, newer: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its first words and that of its last."""
    with np.errstate(over="ignore"):
        x = older * np.uint64(0x9E3779B97F4A7C15) + newer
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_keys(words: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order from 1, the hash of the n-gram that ends at each token.

    ``words`` are word hashes, ``first`` marks the first token of a text, before
    which stand as many start marks as an n-gram has room for.
    """
    found, marks = [words], np.uint64(START)
    for _ in range(1, order):
        before = np.roll(found[-1], 1)
        before[first] = marks
        found.append(_mixed(before, words))
        marks = _mixed(np.array([marks], np.uint64), np.array([START], np.uint64))[0]
    return found


def _fit_fold(doc_id: Column, deleted: int) -> Column:
    """The training documents whose counts are deleted while weights are learned."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("deleted")), F.lit(deleted)) == 0


def encode_blocks(docs: DataFrame, order: int, folds: int, held_out: int, deleted: int, block_bytes: int) -> DataFrame:
    """Blocks of documents as numbered words (BLOCK); documents of the deleted part come a second time, in blocks marked ``fit``.

    ``keys`` is the block's number of distinct n-grams, ``counted`` and
    ``documents`` are tokens and rows that count as training.
    """
    out = in_fold(docs["doc_id"], folds, held_out)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), out.alias("held_out"), (~out & _fit_fold(docs["doc_id"], deleted)).alias("fit"), docs["text"].cast("binary").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        hashes = Remembered(xxhash.xxh64_intdigest, WORDS)
        waiting = {fit: [[], [], [], 0] for fit in (False, True)}

        def block(fit: bool) -> pa.RecordBatch:
            nonlocal number
            ids, held, rows, _ = waiting[fit]
            waiting[fit] = [[], [], [], 0]
            lengths = np.array([len(r) for r in rows], np.int64)
            flat = np.concatenate(rows)
            words, where, often = np.unique(flat, return_inverse=True, return_counts=True)
            by = np.argsort(-often, kind="stable")  # frequent words get small numbers, which pack well
            place = np.empty_like(by)
            place[by] = np.arange(len(by))
            keys = sum(len(np.unique(k)) for k in ngram_keys(flat, _firsts(lengths), order))
            train = ~np.array(held, bool)
            number += 1
            columns = [
                pa.array([number], pa.int64()), pa.array([fit]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                *(pa.array([_packed(x)], pa.binary()) for x in (lengths, words[by], place[where].astype(np.uint32))),
                *(pa.array([int(x)], pa.int64()) for x in (keys, lengths[train].sum(), train.sum())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "fit", "ids", "held", "lengths", "words", "tokens", "keys", "counted", "documents"])

        for batch in sliced(batches):
            for doc_id, held, fit, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = tokens(text)
                row = np.fromiter((hashes[w] for w in found), np.uint64, len(found))
                row = np.append(row, np.uint64(END))
                for kind in (False, True) if fit else (False,):
                    own = waiting[kind]
                    if own[0] and own[3] + len(text or b"") > block_bytes:
                        yield block(kind)
                        own = waiting[kind]
                    own[0].append(doc_id)
                    own[1].append(held)
                    own[2].append(row)
                    own[3] += len(text or b"")
        for kind in (False, True):
            if waiting[kind][0]:
                yield block(kind)

    return rows.mapInArrow(tidy(encode), BLOCK)


def _firsts(lengths: np.ndarray) -> np.ndarray:
    """Where each text of a block begins; no text is without token."""
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def _distinct(columns: dict[str, pa.Array], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of a stored block: text lengths; for each order the sorted distinct keys and each token's place among them; which tokens count as training."""
    lengths = _unpacked(columns["lengths"], np.int64)
    flat = _unpacked(columns["words"], np.uint64)[_unpacked(columns["tokens"], np.uint32)]
    found = [np.unique(k, return_inverse=True) for k in ngram_keys(flat, _firsts(lengths), order)]
    return lengths, found, np.repeat(~np.array(columns["held"], bool), lengths)


def _part_edges(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def _requests(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """Each block's distinct n-grams by order and part of the hash range: sorted hashes as differences, and how often training texts of the block hold them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, found, train = _distinct(row, order)
                for k, (keys, where) in enumerate(found, 1):
                    counts = np.bincount(where[train], minlength=len(keys)).astype(np.uint32)
                    cuts = np.searchsorted(keys, _part_edges(parts))
                    for part, (own, often) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts), strict=True)):
                        if len(own):
                            yield pa.RecordBatch.from_pydict({
                                "ngram": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "block": [row["block"]], "fit": [row["fit"]],
                                "hashes": pa.array([_packed(np.diff(own, prepend=np.uint64(0)))], pa.binary()), "often": pa.array([_packed(often)], pa.binary()),
                            })

    wanted = blocks.select("block", "fit", "held", "lengths", "words", "tokens")
    return wanted.mapInArrow(tidy(ask), "ngram int, part int, block long, fit boolean, hashes binary, often binary")


def _count(table: pa.Table) -> pa.Table:
    """The corpus-wide counts of one part's n-grams, for each block in the order it asked.

    A block of deleted documents gets the counts without all deleted ones.
    ``types`` holds, on one row of the part, how many n-grams training texts have.
    """
    give_back()  # what the part before has left
    rows = table.to_pylist()
    hashes = [np.cumsum(_unpacked(r["hashes"], np.uint64), dtype=np.uint64) for r in rows]
    often = [_unpacked(r["often"], np.uint32).astype(np.int64) for r in rows]
    keys, where = np.unique(np.concatenate(hashes), return_inverse=True)
    deleted = np.repeat([r["fit"] for r in rows], [len(h) for h in hashes])
    flat = np.concatenate(often)
    total = np.bincount(where[~deleted], flat[~deleted], len(keys)).astype(np.int64)
    rest = total - np.bincount(where[deleted], flat[deleted], len(keys)).astype(np.int64)
    cuts = np.cumsum([len(h) for h in hashes])[:-1]
    answers = [(rest if r["fit"] else total)[at] for r, at in zip(rows, np.split(where, cuts), strict=True)]
    return pa.table({
        "block": table.column("block"), "fit": table.column("fit"), "ngram": table.column("ngram"), "part": table.column("part"),
        "counts": pa.array([_packed(a) for a in answers], pa.binary()), "types": pa.array([int((total > 0).sum()), *[0] * (len(rows) - 1)], pa.int64()),
    })


def _token_counts(block: pa.Table, answers: pa.Table, order: int) -> tuple[dict, np.ndarray, list[np.ndarray]]:
    """A block's row, its text lengths, and for each order the count of the n-gram at each token."""
    give_back()  # what the block before has left
    row = block.to_pylist()[0]
    lengths, found, _ = _distinct(row, order)
    parts: dict[int, list] = {k: [] for k in range(1, order + 1)}
    for a in answers.sort_by([("ngram", "ascending"), ("part", "ascending")]).to_pylist():
        parts[a["ngram"]].append(_unpacked(a["counts"], np.int64))
    return row, lengths, [np.concatenate(parts[k])[where] for k, (_, where) in enumerate(found, 1)]


@dataclass(frozen=True)
class Totals:
    """Of the training texts: tokens, different tokens, texts."""

    tokens: int
    types: int
    texts: int


def estimates(counts: list[np.ndarray], first: np.ndarray, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
    """Each token's bucket, and a row an order (0: equal shares) of its maximum-likelihood estimates; -1 where the context is unseen.

    Buckets go by the longest context that was seen and the bits of its frequency.
    """
    n = len(counts[0])
    estimate = np.full((len(counts) + 1, n), -1.0)
    estimate[0] = 1.0 / (totals.types + 1)
    bucket = np.zeros(n, np.int64)
    if totals.tokens:
        estimate[1] = counts[0] / totals.tokens
        bucket += 1
    for k in range(2, len(counts) + 1):
        context = np.roll(counts[k - 2], 1)
        context[first] = totals.texts
        seen = context > 0
        estimate[k, seen] = counts[k - 1][seen] / context[seen]
        bits = np.minimum(np.log2(context[seen]).astype(np.int64), BUCKETS - 1)
        bucket[seen] = 2 + (k - 2) * BUCKETS + bits
    return bucket, estimate


def bucket_count(order: int) -> int:
    return 2 + (order - 1) * BUCKETS


def orders_of(order: int) -> np.ndarray:
    """Which orders each bucket mixes: all up to that of its context."""
    longest = np.concatenate([[0, 1], np.repeat(np.arange(2, order + 1), BUCKETS)])
    return np.arange(order + 1) <= longest[:, None]


def even_weights(order: int) -> np.ndarray:
    allowed = orders_of(order)
    return allowed / allowed.sum(1, keepdims=True)


def expected(bucket: np.ndarray, estimate: np.ndarray, weights: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Tokens that each bucket owes to each order under ``weights``; the last column is their log-likelihood."""
    shares = np.maximum(estimate, 0).T * weights[bucket]
    whole = shares.sum(1)
    shares = np.hstack([shares / whole[:, None], np.log(whole)[:, None]]) * times[:, None]
    return np.stack([np.bincount(bucket, s, len(weights)) for s in shares.T], 1)


def renewed(owed: np.ndarray, order: int) -> np.ndarray:
    """Weights from the tokens owed; a bucket without any takes those of the nearest with some and the same orders, else even ones."""
    allowed, weights = orders_of(order), even_weights(order)
    seen = owed.sum(1) > 0
    given = owed + LEAST_TOKENS * allowed
    weights[seen] = given[seen] / given[seen].sum(1, keepdims=True)
    for b in np.flatnonzero(~seen):
        like = np.flatnonzero(seen & (allowed == allowed[b]).all(1))
        if len(like):
            weights[b] = weights[like[np.argmin(np.abs(like - b))]]
    return weights


def _fit_weights(blocks: DataFrame, answers: DataFrame, totals: Totals, order: int, scratch: Scratch) -> np.ndarray:
    """Mixture weights by expectation-maximisation over the deleted documents' tokens, one pass over their stored estimates a round."""
    own = blocks.where("fit")
    gone = own.agg(F.sum("counted").alias("tokens"), F.sum("documents").alias("texts")).first()
    rest = Totals(totals.tokens - (gone.tokens or 0), totals.types, totals.texts - (gone.texts or 0))

    def prepare(key: tuple, block: pa.Table, found: pa.Table) -> pa.Table:
        _, lengths, counts = _token_counts(block, found, order)
        bucket, estimate = estimates(counts, _firsts(lengths), rest)
        same, times = np.unique(np.vstack([bucket, estimate]), axis=1, return_counts=True)
        return pa.table({"bucket": pa.array([same[0].astype(np.int16).tobytes()], pa.binary()), "estimate": pa.array([same[1:].tobytes()], pa.binary()), "times": pa.array([times.tobytes()], pa.binary())})

    told = own.groupBy("block").cogroup(answers.where("fit").groupBy("block")).applyInArrow(prepare, "bucket binary, estimate binary, times binary")
    told = scratch.keep(told, "deleted")
    weights = even_weights(order)
    for _ in range(ROUNDS):

        def expect(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            owed = np.zeros((bucket_count(order), order + 2))
            for batch in batches:
                for row in batch.to_pylist():
                    bucket = np.frombuffer(row["bucket"], np.int16).astype(np.int64)
                    estimate = np.frombuffer(row["estimate"]).reshape(order + 1, -1)
                    owed += expected(bucket, estimate, weights, np.frombuffer(row["times"], np.int64))
            at = np.argwhere(owed[:, :-1])
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(owed[:, :-1][tuple(at.T)])], ["bucket", "ngram", "owed"])

        sums = told.mapInArrow(tidy(expect), "bucket long, ngram long, owed double").groupBy("bucket", "ngram").agg(F.sum("owed").alias("owed")).collect()
        owed = np.zeros((bucket_count(order), order + 1))
        for r in sums:
            owed[r.bucket, r.ngram] = r.owed
        weights = renewed(owed, order)
    return weights


def score_texts(docs: DataFrame, order: int = ORDER, folds: int = 7, held_out: int = 2, deleted: int = DELETED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Tokens are the words, A-Z lower-cased, and one end for each text, so null
    and empty texts have one token.  Counts come from the rows outside the
    held-out fold, of which one in ``deleted`` is left out of them while the
    weights are learned; too few rows to have such leave the weights even.
    ``base_score`` is the add-one unigram estimate, ``score`` the mixture of
    n-gram estimates up to ``order`` words and equal shares.  Without any
    training row all tokens are unknown and both scores are 0.  Rows that
    repeat, or lack an id, are each a text of their own; a null id hashes as
    empty text.  A task holds one block of texts, or one longer text; words
    and n-grams go by 64-bit hashes.  An empty table gives an empty result and
    other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lm-scoring")
    blocks = scratch.keep(encode_blocks(docs, order, folds, held_out, deleted, block_bytes), "blocks")
    sums = blocks.groupBy("fit").agg(F.sum("counted").alias("tokens"), F.sum("documents").alias("texts"), F.sum("keys").alias("keys")).collect()
    whole = next((r for r in sums if not r.fit), None)
    parts = max(1, -(-sum(r["keys"] for r in sums) // (order * PART_KEYS)))
    answered = _requests(blocks, order, parts).groupBy("ngram", "part").applyInArrow(_count, "block long, fit boolean, ngram int, part int, counts binary, types long")
    answers = scratch.keep(answered, "answers")
    types = answers.where("ngram = 1").agg(F.sum("types")).first()[0] or 0
    totals = Totals(whole.tokens if whole else 0, types, whole.texts if whole else 0)
    weights = _fit_weights(blocks, answers, totals, order, scratch)

    def score(key: tuple, block: pa.Table, found: pa.Table) -> pa.Table:
        row, lengths, counts = _token_counts(block, found, order)
        first = _firsts(lengths)
        bucket, estimate = estimates(counts, first, totals)
        mixed = np.log10((np.maximum(estimate, 0).T * weights[bucket]).sum(1))
        base = np.log10((counts[0] + 1) / (totals.tokens + totals.types + 1))
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(lengths),
            "n_known": pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), first)), "train_tokens": pa.array([totals.tokens] * len(lengths), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(mixed, first)),
        })

    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    own = blocks.where("not fit").drop("fit", "keys", "counted", "documents")
    return own.groupBy("block").cogroup(answers.where("not fit").select("block", "ngram", "part", "counts").groupBy("block")).applyInArrow(score, result)
