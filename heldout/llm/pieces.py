"""Arrow string columns as byte arrays, cut into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and where each row begins (one more at the end). NULL is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def string_rows(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The inverse of ``byte_rows``; ``data`` is valid UTF-8."""
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)])


def cut(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose strings have about ``size`` bytes together; a longer row makes a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(lengths), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
