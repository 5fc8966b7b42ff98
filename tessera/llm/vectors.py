"""Reading vector columns in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def finite_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors that are not null and hold only finite components, and those vectors as doubles.

    Shorter vectors are padded with zeros to ``dim``, which changes no inner product.
    """
    column = column.cast(pa.large_list(pa.float64()))
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    values = column.flatten() if not column.null_count else pa.chunked_array([column.drop_null().flatten()]).combine_chunks()
    valid = np.asarray(column.is_valid()) if len(column) else np.zeros(0, bool)
    flat = np.asarray(values.fill_null(np.nan)) if len(values) else np.zeros(0)
    sizes = np.where(valid, sizes, 0)
    out = np.zeros((len(column), dim))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    good = np.flatnonzero(valid & np.isfinite(out).all(1) & (sizes > 0))
    return good, out[good]


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(matrix), [None, pa.py_buffer(matrix.tobytes())]).cast(pa.binary())


def matrix_of(column: pa.Array, dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim)
