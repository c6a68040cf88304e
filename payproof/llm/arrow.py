"""Arrow batches in small slices, so that a task's memory doesn't depend on how long the texts of a batch are."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 8 << 20      # bytes of text handled at once; a longer text is a slice of its own


def small(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A null text is an empty one."""
    return [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]


def lists(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    """The lists of whole numbers of a column, as views of its values. A null list is an empty one."""
    col = batch.column(column)
    ends, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    some = col.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else values[:0] for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), some.tolist(), strict=True)]
