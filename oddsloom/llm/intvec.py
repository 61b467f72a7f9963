"""Vectors as whole numbers, and exact squared distances and products of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this fail the job: squares and sums of them would not fit into 64 bits any more.
LARGEST = 2**24
#: Doubles hold whole numbers below this exactly.
_EXACT = 2**53


def all_finite(vector: Column) -> Column:
    """Not null, not empty, and no component null, infinite or not a number."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as array<int>; a component that leaves ``LARGEST`` fails the job."""

    def whole(x: Column) -> Column:
        y = F.floor(x.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(x.cast("double") * F.lit(float(scale))) <= F.lit(float(LARGEST)), y.cast("int")).otherwise(F.raise_error(F.lit("a vector's component is too large to be added up exactly")).cast("int"))

    return F.transform(vector, whole)


def smallest(df: DataFrame, most: int, *order: Column) -> list:
    """The ``most`` rows that come first, to the driver; ``most`` is a parameter of the method, not of the data."""
    return df.orderBy(*order).limit(most).collect()


def matrix(column: pa.Array, dim: int, kind: type = np.int64) -> np.ndarray:
    """(rows, dim) numbers of an Arrow list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def bytes_matrix(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    """(rows, *shape) numbers of an Arrow binary column, all of one size."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), *shape)


def binary_column(x: np.ndarray) -> pa.Array:
    """One binary value for each row of a C-ordered array."""
    x = np.ascontiguousarray(x)
    width = x.dtype.itemsize * int(np.prod(x.shape[1:]))
    offsets = np.arange(len(x) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())]).cast(pa.binary())


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b) inner products as 64-bit whole numbers, exact; doubles are used where they are exact too."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b) squared Euclidean distances as whole numbers, exact."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    return np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * products(a, b)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows with rows, exact."""
    gap = a.astype(np.int64) - b.astype(np.int64)
    return np.einsum("ij,ij->i", gap, gap)


def first_least(d: np.ndarray) -> np.ndarray:
    """Position of the least of each row; ties to the first."""
    return d.argmin(axis=1)


def floor_means(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """floor(sum / count) by component; where the count is 0, the old row."""
    return np.where(counts[:, None] > 0, np.floor_divide(sums, np.maximum(counts, 1)[:, None]), old)


def add_up(partial: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, n, s): counts ``n`` and vectors ``s`` of ``width`` components added up by key.

    The input has a row for each key and task at most, so it is small against
    the rows that it stands for.
    """
    return partial.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
