"""Unit vectors in binary form: they go between the JVM and numpy without a copy per element."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The float32 rows of a binary column without nulls. Rows of one byte a dimension are brought to length one."""
    n = len(column)
    if not n:
        return np.zeros((0, dim), np.float32)
    ends = np.frombuffer(column.buffers()[1], np.int32, n + 1 + column.offset)[column.offset :]
    data, at = column.buffers()[2], int(ends[0])
    if ends[1] - at == dim:
        rows = np.frombuffer(data, np.int8, n * dim, at).reshape(n, dim).astype(np.float32)
        rows *= 1 / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
        return rows
    return np.frombuffer(data, np.float32, n * dim, at).reshape(n, dim)


def binary(rows: np.ndarray) -> pa.Array:
    """The rows of a two-dimensional array as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * (rows.shape[1] if rows.ndim == 2 else 1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _unit(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            starts = lists.offsets.to_numpy()
            full = (np.diff(starts) == dim) & lists.is_valid().to_numpy(zero_copy_only=False)
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null elements become NaN
            rows = values[starts[:-1][full][:, None] + np.arange(dim)] if full.any() else np.zeros((0, dim))
            ok = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
            rows = rows[ok]
            rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
            rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[full][ok], pa.int64()), binary(rows)], ["id", "vec"])

    return run


def unit_vectors(df: DataFrame, ident: str, vector: str, dim: int) -> DataFrame:
    """(id, vec) of the rows whose vector is usable: ``dim`` finite numbers, not all zero. vec holds the vector at
    length one as float32 bytes. Null ids are left out; an id may come more than once."""
    d = df.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return d.mapInArrow(_unit(dim), "id long, vec binary")
