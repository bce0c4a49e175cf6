"""Vectors of integer components, packed for exact distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 26  # components up to here keep every squared distance of 64 components below 2^62
EXACT = 1 << 21  # up to here float64 holds every sum of a product of 64 components
_WIDTHS = (np.int8, np.int16, np.int32)


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float64 matrix) of the rows that hold exactly ``size`` components, all finite and none null."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null lists hold nothing, nulls are NaN
    starts = np.cumsum(lengths) - lengths
    rows = np.flatnonzero((lengths == size) & column.is_valid().to_numpy(zero_copy_only=False))
    x = flat[starts[rows, None] + np.arange(size)]
    fine = np.isfinite(x).all(axis=1)
    return rows[fine], x[fine]


def lists(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each row's components as float64 (a null one is NaN); None for a null row."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    at = 0
    for length in pc.list_value_length(column).to_pylist():
        yield None if length is None else flat[at : at + length]
        at += length or 0


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64; components that exact distances cannot hold are an error."""
    y = np.floor(scale * x)
    if y.size and np.abs(y).max() > LIMIT:
        raise ValueError(f"a component times {scale} is beyond {LIMIT}: squared distances would not fit a long")
    return y.astype(np.int64)


def width(x: np.ndarray) -> type:
    """The narrowest integer type that holds all components."""
    most = int(np.abs(x).max()) if x.size else 0
    return next(t for t in _WIDTHS if most <= np.iinfo(t).max)


def packed(x: np.ndarray, kind: type | None = None) -> pa.Array:
    """One binary value a row, as narrow as the components allow; its length tells the width."""
    data = np.ascontiguousarray(x, dtype=kind or width(x))
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    """The int64 matrix of packed rows, whatever their widths."""
    values = column.to_pylist()
    out = np.empty((len(values), size), dtype=np.int64)
    bytes_of = np.array([len(v) for v in values], dtype=np.int64)
    for length in np.unique(bytes_of):
        at = np.flatnonzero(bytes_of == length)
        kind = np.dtype(f"i{length // size}") if size else np.dtype("i1")
        out[at] = np.frombuffer(b"".join(values[i] for i in at), dtype=kind).reshape(len(at), size)
    return out


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of every row to every centre."""
    if max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)) <= EXACT and x.shape[1] <= 64:
        a, c = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def first_vectors(vectors: DataFrame, key: Column, count: int, size: int, scale: int) -> np.ndarray:
    """The ``count`` usable vectors of the least keys as integers, in order; ties by the vector, null keys last."""
    rows = vectors.select(key.alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    least = rows.where((F.size("embedding") == size) & finite).orderBy(F.asc_nulls_last("key"), "embedding").limit(count)
    found = np.array([r["embedding"] for r in least.collect()], dtype=np.float64).reshape(-1, size)
    return whole_numbers(found, scale)
