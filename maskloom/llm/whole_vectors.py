"""Vectors scaled to whole numbers, and exact inner products of them, for the exact searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Up to here sums of products are exact in doubles; up to the second bound in 64-bit integers.
_DOUBLE, _LONG = float(2**53), float(2**62)


def _floor(x: Column) -> Column:
    """floor() that stays a double: a long would saturate, and doubles from 2**53 on are whole already."""
    return F.when(F.abs(x) < _DOUBLE, F.floor(x).cast("double")).otherwise(x)


def whole(rows: DataFrame, scale: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, *also, v): floor(scale * x) of every component, as doubles that are whole numbers.

    Rows without an id, and vectors that are null or hold null or non-finite components (or overflow
    when scaled), are left out, as are rows with a null in ``also``. Rows that share a vec_id count
    once, with the smallest (``also``, vector).
    """
    v = F.col("embedding")
    scaled = F.transform(v.cast("array<double>"), lambda x: _floor(x * scale))
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = F.col("vec_id").isNotNull() & v.isNotNull()
    for name in also:
        given = given & F.col(name).isNotNull()
    rows = rows.where(given).where(F.coalesce(fine, F.lit(False)))
    rows = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(*also, scaled.alias("v"))).alias("row"))
    return rows.select("vec_id", *[F.col("row")[name].alias(name) for name in also], F.col("row")["v"].alias("v"))


def first_copies(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """Of rows alike in ``by`` the ``most`` with the smallest vec_id; the others cannot be among the first ``most``.

    The limit of the window is applied before the shuffle, so a hot group costs each task ``most`` rows.
    """
    order = Window.partitionBy(*by).orderBy("vec_id")
    return rows.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= most).drop("copy")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _largest(a: np.ndarray) -> float:
    return float(np.abs(a).max(initial=0.0))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and of b, all pairs; beyond 64 bits the nearest long."""
    bound = _largest(a) * _largest(b) * max(a.shape[1], 1)
    if bound < _DOUBLE:
        return np.rint(a @ b.T).astype(np.int64)
    if bound < _LONG:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return _nearest_long(_integers(a) @ _integers(b).T)


def row_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of row i of a with row i of b; beyond 64 bits the nearest long."""
    bound = _largest(a) * _largest(b) * max(a.shape[1], 1)
    if bound < _DOUBLE:
        return np.rint((a * b).sum(axis=1)).astype(np.int64)
    if bound < _LONG:
        return (a.astype(np.int64) * b.astype(np.int64)).sum(axis=1)
    return _nearest_long((_integers(a) * _integers(b)).sum(axis=1))


def _integers(a: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in a.ravel()], object).reshape(a.shape)


def _nearest_long(a: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in np.ravel(a)], np.int64).reshape(np.shape(a))
