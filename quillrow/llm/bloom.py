"""A pair of Bloom filters: what was seen once, and what was seen twice.

Keys are 16-byte digests.  Their hash range is cut into as many slices as the
key count asks, and each slice has a pair of filters of bounded size, so
filters never fill however large the input is.  Builder tasks keep one slice's
pair and emit it in blocks; equal blocks of all builders meet and merge:
twice |= twice' | (once & once').  A key met by two builders has all its bits
in both ``once`` filters, so the merged filter misses no repeat; a false
suspicion only costs an exact check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .held import tidy

#: Bytes of a key, and of a filter block that is merged at a time.
KEY, BLOCK = 16, 1 << 16
HASHES = 4
BITS_PER_KEY = 8
#: Bits of one filter at most (64 MB); more keys take more slices.
MOST_BITS = 1 << 29


def filter_shape(keys: int) -> tuple[int, int]:
    """Bits of a filter, a power of two, and slices, for so many keys."""
    slices = max(1, -(-keys * BITS_PER_KEY // MOST_BITS))
    share = -(-keys // slices)
    return min(MOST_BITS, max(BLOCK * 8, 1 << max(1, share * BITS_PER_KEY - 1).bit_length())), slices


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """The slice that each key (a row of two 64-bit words) belongs to."""
    return (((keys[:, 1] >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)).astype(np.int32)


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """HASHES rows of bit positions of keys."""
    step = (keys[:, 0] >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([((keys[:, 0] + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(HASHES)])


def _bit(at: np.ndarray) -> np.ndarray:
    return np.uint8(1) << (at & 7).astype(np.uint8)


def contains(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which columns of positions a packed filter may hold."""
    return ((packed[at >> 3] & _bit(at)) != 0).all(0)


def insert(packed: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed, at.ravel() >> 3, _bit(at.ravel()))


def twice_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """The packed twice-seen filter of a slice's ``keys``: one binary column, each row the distinct keys of one document, joined."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, 2)
            if len(found):
                distinct, count = np.unique(found[:, 0], return_counts=True)
                at = positions(distinct[:, None], bits)
                insert(twice, at[:, (count > 1) | contains(once, at)])
                insert(once, at)
        for at in range(0, bits // 8, BLOCK):
            if once[at : at + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([at // BLOCK], pa.int32()), "once": [once[at : at + BLOCK].tobytes()], "twice": [twice[at : at + BLOCK].tobytes()]})

    def merge(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(BLOCK, np.uint8), np.zeros(BLOCK, np.uint8)
        for a, b in zip(table.column("once"), table.column("twice"), strict=True):
            a, b = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint8)
            twice |= b | (once & a)
            once |= a
        return pa.table({"block": table.column("block")[:1], "twice": [twice.tobytes()]})

    # a builder's output is as large as the filters, so there are no more builders than run at once
    builders = max(1, keys.sparkSession.sparkContext.defaultParallelism)
    blocks = keys.coalesce(builders).mapInArrow(tidy(build), "block int, once binary, twice binary")
    merged = blocks.groupBy("block").applyInArrow(merge, "block int, twice binary")
    packed = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        packed[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.twice, np.uint8)
    return packed
