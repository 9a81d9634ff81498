"""Helpers shared by the Arrow-based operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once by numpy code; bounds a Python worker's memory.
CHUNK_BYTES = 2 << 20


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows of about ``limit`` text bytes.

    A single text longer than the limit forms a slice of its own: texts are
    never cut.
    """
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start, n - start)


def arrow_map(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES):
    """A ``mapInArrow`` function that applies ``fn`` to bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return run


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the n + 1 offsets of the rows (null: empty)."""
    col = pc.fill_null(batch.column(column), "")
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column with ``counts[i]`` of the values in row i."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
