"""Lines repeated across documents (operator 3).

A first pass turns each document's lines into 16-byte digests, a narrow table
that stands for the texts.  Its digests fold into once-seen and twice-seen
Bloom filters, slice by slice of the hash range, and only those in a twice-seen
filter shuffle: a partial aggregate confirms which occur in two documents and
picks the first.  Texts meet the lines they lose by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import sliced
from .bloom import KEY, contains, filter_shape, positions, slice_of, twice_filter
from .carried import quoted
from .held import tidy
from .scratch import Scratch
from .skew import spread_join

#: Stripped at both ends of a line.
STRIPPED = b" \t\n\x0b\x0c\r"
#: Code points of a key from which a line can be a repeat.
SHORTEST = 10
#: Tasks that write a slice of the digests.
WRITERS = 16


def line_key(line: bytes, shortest: int = SHORTEST) -> bytes | None:
    """The key of a UTF-8 line, or None if it is too short; only A-Z are lower-cased."""
    key = line.strip(STRIPPED).lower()
    if len(key) >= 4 * shortest or len(key) >= shortest and len(key.decode("utf-8", "replace")) >= shortest:
        return key
    return None


def document_keys(text: bytes | None, shortest: int) -> set[bytes]:
    return {key for line in (text or b"").split(b"\n") if (key := line_key(line, shortest)) is not None}


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:KEY]


def _owner(docs: DataFrame) -> list:
    """What tells documents apart: doc_id, and of rows without id a hash of the text, so that these don't form one huge group."""
    return [docs["doc_id"].alias("__id"), F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"])).otherwise(0).alias("__mark")]


def repeated_lines(docs: DataFrame, scratch: Scratch, shortest: int) -> DataFrame:
    """__id, __mark, drops: the digests of the lines that a document loses.

    All slices together read the digests twice, whatever their number: more
    than one slice are dealt out first, so that each has files of its own.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [b"".join(map(digest, document_keys(t, shortest))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], ["__id", "__mark", "lines"])

    texts = docs.select(*_owner(docs), docs["text"].cast("binary").alias("text"))
    lines = scratch.keep(texts.mapInArrow(tidy(digests), "__id long, __mark long, lines binary").where("length(lines) > 0"), "lines")
    keys = lines.agg(F.sum(F.length("lines") / KEY).cast("long")).first()[0] or 0
    bits, slices = filter_shape(keys)
    if slices > 1:
        lines = scratch.keep(_dealt(lines, slices), "slices", by="slice")
        scratch.discard("lines")
    for number in range(slices):
        own = lines if slices == 1 else lines.where(F.col("slice") == number).drop("slice")
        shared = docs.sparkSession.sparkContext.broadcast(twice_filter(own.select("lines"), bits))  # MOST_BITS / 8 bytes at most
        scratch.keep(_suspects(own, bits, shared), f"suspects/slice={number}")
        shared.destroy()
    suspects = scratch.read("suspects", "__id long, __mark long, line binary")
    first = (
        suspects.groupBy("line")
        .agg(F.min("__id").alias("first"), F.max("__id").alias("last"), F.max(F.isnull("__id")).alias("no_id"))
        .where("first < last or (no_id and first is not null)")
        .select("line", "first")
    )
    dealt = suspects.withColumn("__deal", F.xxhash64("__id", "__mark"))
    lost = spread_join(dealt, first, "line", "__deal").where("__id is null or __id > first")
    return lost.groupBy("__id", "__mark").agg(F.collect_set("line").alias("drops"))


def _dealt(lines: DataFrame, slices: int) -> DataFrame:
    """Each document's digests cut by slices of the hash range, a slice's rows in few tasks that write it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = batch.column(2).to_pylist()
            owner = np.repeat(np.arange(len(raw)), [len(x) // KEY for x in raw])
            found = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2)
            place = slice_of(found, slices)
            order = np.lexsort((owner, place))
            pairs, starts = np.unique(np.stack([place[order], owner[order]]), axis=1, return_index=True)
            joined, ends = found[order].tobytes(), [*starts[1:].tolist(), len(order)]
            parts = [joined[a * KEY : e * KEY] for a, e in zip(starts.tolist(), ends, strict=True)]
            mine = pa.array(pairs[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(mine), batch.column(1).take(mine), pa.array(parts, pa.binary()), pa.array(pairs[0], pa.int32())], ["__id", "__mark", "lines", "slice"])

    cut = lines.mapInArrow(tidy(deal), "__id long, __mark long, lines binary, slice int")
    return cut.repartition("slice", F.pmod(F.xxhash64("__id", "__mark"), F.lit(WRITERS)))


def _suspects(lines: DataFrame, bits: int, shared: Broadcast) -> DataFrame:
    """__id, __mark, line: the digests that their slice's twice-seen filter may hold."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            owner = np.repeat(np.arange(len(raw)), [len(x) // KEY for x in raw])
            found = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2)
            hit = np.flatnonzero(contains(shared.value, positions(found, bits)))
            joined = found[hit].tobytes()
            picked = pa.array([joined[i : i + KEY] for i in range(0, len(joined), KEY)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(owner[hit])) for c in batch.columns[:2]), picked], ["__id", "__mark", "line"])

    return lines.mapInArrow(tidy(pick), "__id long, __mark long, line binary")


def line_dedup(docs: DataFrame, shortest: int = SHORTEST, carry: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of ``docs`` (long doc_id, string text).

    A key of at least ``shortest`` code points found in two documents stays
    only in the smallest doc_id that holds it; all its lines there stay.
    Documents are told apart by doc_id, so rows repeating an id are one
    document and lose the same lines; rows without id are one document after
    all others.  Null or empty text is one empty line, and a null text that is
    rewritten becomes empty.  A text of any length is split whole.  With
    ``carry`` the other columns of ``docs`` follow.  An empty table gives an
    empty result.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")] if carry else []
    kept = _rewritten(docs, shortest, rest)
    return kept.select("doc_id", "n_lines", "n_dropped", "kept_text", *(F.col(f"__rest_{i}").alias(c) for i, c in enumerate(rest)))


def _rewritten(docs: DataFrame, shortest: int, rest: list[str]) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text, then the columns of ``rest`` as __rest_0, __rest_1 and so on, whatever their names and types."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    drops = repeated_lines(docs.select("doc_id", "text"), scratch, shortest)
    drops = drops.select(F.col("__id").alias("__owner"), F.col("__mark").alias("__owner_mark"), "drops")
    same = F.col("__id").eqNullSafe(F.col("__owner")) & (F.col("__mark") == F.col("__owner_mark"))
    fields = (
        docs.select(*_owner(docs), docs["text"].cast("binary").alias("__text"), *(docs[quoted(c)].alias(f"__rest_{i}") for i, c in enumerate(rest)))
        .join(drops, same, "left")
        .select("__id", "__text", "drops", *(f"__rest_{i}" for i in range(len(rest))))
    )

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            total, gone, kept = [], [], []
            for text, lost in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                if lost:
                    lost = set(lost)
                    stays = [x for x in lines if (key := line_key(x, shortest)) is None or digest(key) not in lost]
                else:
                    stays = lines
                total.append(len(lines))
                gone.append(len(lines) - len(stays))
                kept.append((b"\n".join(stays)).decode("utf-8", "replace"))
            out = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(out + batch.columns[3:], ["doc_id", "n_lines", "n_dropped", "kept_text"] + batch.schema.names[3:])

    schema = T.StructType.fromDDL("doc_id long, n_lines long, n_dropped long, kept_text string")
    return fields.mapInArrow(tidy(rewrite), T.StructType(schema.fields + [T.StructField(f"__rest_{i}", docs.schema[c].dataType) for i, c in enumerate(rest)]))


def without_repeats(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs``, all columns as they are but ``text``, which lacks the lines that an earlier document holds."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = _rewritten(docs, shortest, rest)
    places = {c: f"__rest_{i}" for i, c in enumerate(rest)} | {"doc_id": "doc_id", "text": "kept_text"}
    return kept.select(*(F.col(places[c]).alias(c) for c in docs.columns))
