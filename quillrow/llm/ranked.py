"""Ranked lexical search (operator 13).

A blocked sparse matrix product: items by terms (multiplicities) times terms by
documents (whole-number impacts).  The term-document matrix is stored in blocks
of documents with the columns of the terms that items ask for.  An item's row
merges the rows of its terms, Gustavson's way, in numpy; each block keeps its
best documents of an item, and those of all blocks are reduced in two rounds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import sliced
from .held import tidy
from .scratch import Scratch

BEST = 10
#: Terms of the items that are searched at the same time, repeats counted, unless one item alone has more.
BLOCK_TERMS = 1 << 20
#: Documents and stored entries of a block of the term-document matrix, unless one document alone has more.
BLOCK_DOCUMENTS, BLOCK_ENTRIES = 8192, 1 << 21
#: Parts that an item's candidates are dealt to before the last round.
PARTS = 32
# Fixed values of the score.
UNIT, TF_WEIGHT, LENGTH_WEIGHT, LENGTH_SHARE = 1_000_000_000, 1000, 8, 75
RESULT = "item_id long, rank int, doc_id long, score long"
MATRIX = "doc_ids array<long>, lengths array<long>, starts binary, terms binary, counts binary, documents long, total long"

_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b if b >= 0x80 else c if (c := ord(chr(b).lower())) in _LETTERS else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and everything beyond ASCII of a UTF-8 text; only A-Z are lower-cased."""
    return (text or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class Items:
    """A block of items: their terms' numbers and multiplicities, item by item."""

    numbers: list[int]
    ids: list[int | None]
    vocabulary: dict[bytes, int]
    starts: np.ndarray
    terms: np.ndarray
    counts: np.ndarray


def item_blocks(benchmark: DataFrame, most: int = BLOCK_TERMS) -> Iterator[Items]:
    """The items block by block; the driver holds one block at a time."""
    numbers, ids, rows, size = [], [], [], 0

    def block() -> Items:
        vocabulary: dict[bytes, int] = {}
        coded = [{vocabulary.setdefault(t, len(vocabulary)): c for t, c in row.items()} for row in rows]
        starts = np.cumsum([0, *map(len, coded)])
        flat = [(t, c) for row in coded for t, c in row.items()]
        return Items(numbers, ids, vocabulary, starts, np.array([t for t, _ in flat], np.int64), np.array([c for _, c in flat], np.int64))

    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    for number, item in enumerate(texts.toLocalIterator()):
        row = Counter(terms(item.text))
        if rows and size + len(row) > most:
            yield block()
            numbers, ids, rows, size = [], [], [], 0
        if row:
            numbers.append(number)
            ids.append(item.item_id)
            rows.append(row)
            size += len(row)
    if rows:
        yield block()


def term_document_blocks(docs: DataFrame, items: Items) -> DataFrame:
    """Blocks of documents (MATRIX): each row's term count, and the entries of the items' terms, document by document."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)  # at most BLOCK_TERMS terms, or one item's

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        ids, lengths, found, counts, starts = [], [], [], [], [0]

        def block() -> pa.RecordBatch:
            columns = {"starts": np.array(starts, np.int64), "terms": np.array(found, np.int32), "counts": np.array(counts, np.int64)}
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), *(pa.array([c.tobytes()], pa.binary()) for c in columns.values()),
                    pa.array([sum(n > 0 for n in lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64()),
                ],
                ["doc_ids", "lengths", *columns, "documents", "total"],
            )

        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms(text)
                own = Counter(t for w in words if (t := known.get(w)) is not None)
                if ids and (len(ids) >= BLOCK_DOCUMENTS or len(found) + len(own) > BLOCK_ENTRIES):
                    yield block()
                    ids, lengths, found, counts, starts = [], [], [], [], [0]
                ids.append(doc_id)
                lengths.append(len(words))
                found += own.keys()
                counts += own.values()
                starts.append(len(found))
        if ids:
            yield block()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(tidy(build), MATRIX)


def document_frequencies(matrix: DataFrame, width: int) -> np.ndarray:
    """How many documents hold each term."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(width, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                found += np.bincount(np.frombuffer(blob, np.int32), minlength=width)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], ["term", "df"])

    total = np.zeros(width, np.int64)
    for row in matrix.select("terms").mapInArrow(tidy(add), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        total[row.term] = row.df
    return total


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def length_norms(lengths: list[int], documents: int, total: int) -> np.ndarray:
    """m of each document, in whole numbers of any size."""
    return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * documents // total for n in lengths], np.int64)


def best_of_block(items: Items, weight: np.ndarray, norms: np.ndarray, ids: list[int | None], starts: np.ndarray, held: np.ndarray, counts: np.ndarray, best: int) -> Iterator[tuple[int, int, int]]:
    """(item, document, score) of each item's best documents in one block; items and documents by place."""
    owner = np.repeat(np.arange(len(ids)), np.diff(starts))
    impact = weight[held] * ((UNIT * counts) // (TF_WEIGHT * counts + LENGTH_WEIGHT * norms[owner]))
    order = np.argsort(held, kind="stable")
    rows, values = owner[order], impact[order]
    first = np.searchsorted(held[order], np.arange(len(weight) + 1))
    tie = np.argsort(np.argsort([(1 << 63) - 1 if i is None else i for i in ids], kind="stable"), kind="stable")
    merged = np.zeros(len(ids), np.int64)
    for item in range(len(items.ids)):
        touched = []
        for at in range(items.starts[item], items.starts[item + 1]):
            part = slice(first[items.terms[at]], first[items.terms[at] + 1])
            if part.start < part.stop:
                merged[rows[part]] += items.counts[at] * values[part]
                touched.append(rows[part])
        if not touched:
            continue
        hit = np.unique(np.concatenate(touched))
        score = merged[hit]
        merged[hit] = 0
        hit, score = hit[score > 0], score[score > 0]
        if len(hit) > best:
            least = np.partition(score, len(score) - best)[len(score) - best]
            hit, score = hit[score >= least], score[score >= least]
        for i in np.lexsort((tie[hit], -score))[:best]:
            yield item, int(hit[i]), int(score[i])


def _ranked(docs: DataFrame, items: Items, scratch: Scratch, name: str, best: int) -> DataFrame:
    """item, item_id, doc_id, score of one block of items: each item's best documents."""
    matrix = scratch.keep(term_document_blocks(docs, items), f"{name}-matrix")
    sums = matrix.agg(F.sum("documents").alias("n"), F.sum("total").alias("l")).first()
    documents, total = sums.n or 0, sums.l or 0
    weight = weights(document_frequencies(matrix, len(items.vocabulary)), documents)
    shared = docs.sparkSession.sparkContext.broadcast((Items(items.numbers, items.ids, {}, items.starts, items.terms, items.counts), weight))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                starts, held, counts = (np.frombuffer(batch.column(2 + i)[row].as_py(), kind) for i, kind in enumerate((np.int64, np.int32, np.int64)))
                found = list(best_of_block(own, weight, length_norms(lengths, documents, max(total, 1)), ids, starts, held, counts, best))
                columns = [[own.numbers[i] for i, _, _ in found], [own.ids[i] for i, _, _ in found], [ids[d] for _, d, _ in found], [s for _, _, s in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "item_id", "doc_id", "score"])

    # a block is one row, so tasks take few rows: a batch of them must fit a worker
    found = matrix.drop("documents", "total").mapInArrow(tidy(multiply), "item long, item_id long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("place") <= best)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best)
    stored = scratch.keep(last.select("item_id", "rank", "doc_id", "score"), f"{name}-best")
    scratch.discard(f"{name}-matrix")
    return stored


def rank_documents(docs: DataFrame, benchmark: DataFrame, best: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``best`` documents by score, equal scores by smaller doc_id, one without id last.

    Every row of ``benchmark`` is an item and every row of ``docs`` a document:
    rows that repeat an id or a text count each for themselves, and items that
    repeat an id are ranked each for itself.  Null texts have no terms; an item
    without terms, or whose terms no document holds, has no rows, and so has
    an empty table on either side.  Texts of any length are read whole.  Items
    are taken in blocks of ``block_terms`` terms; each block reads the texts
    once.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    result = None
    for number, items in enumerate(item_blocks(benchmark, block_terms)):
        part = _ranked(docs, items, scratch, f"block-{number}", best)
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], RESULT) if result is None else result
