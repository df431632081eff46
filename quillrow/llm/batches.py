"""Arrow batches in slices, so that a worker's Python objects stay few."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows, and bytes of their texts, that are Python objects at the same time; one row always is.
ROWS, BYTES = 256, 1 << 22


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row's texts and binaries."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return total


def sliced(batches: Iterable[pa.RecordBatch], rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``rows`` rows and ``most`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ahead = np.concatenate([[0], np.cumsum(_sizes(batch))])
        start = 0
        while start < batch.num_rows:
            fits = int(np.searchsorted(ahead, ahead[start] + most, "right")) - 1
            end = min(max(start + 1, fits), start + rows, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
