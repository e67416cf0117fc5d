"""Metrics: each has a Column form (readable, inside codegen) and a block form (numpy, for Arrow batches).

A smaller distance is nearer. Sums run in double precision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    """Raw inner product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ip_distance(a: Column, b: Column) -> Column:
    """1 less the inner product; nothing is normalised, so it may be negative."""
    return F.lit(1.0) - inner_product(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x)


def l2_int_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of integer vectors, exact."""
    square = lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))
    return F.aggregate(F.zip_with(a, b, square), F.lit(0).cast("long"), lambda s, x: s + x)


def subvector(v: Column, m: Column | int, size: int) -> Column:
    """The m-th stretch of ``size`` elements."""
    start = F.lit(m * size + 1) if isinstance(m, int) else m * size + 1
    return F.slice(v, start, size)


@dataclass(frozen=True)
class Metric:
    """``column(a, b)`` of two array columns; ``block(base, queries)`` of two matrices (rows x queries), which
    may round equal rows apart; ``rows(base, query)`` for one query, where equal rows are exactly equal."""

    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _l2_rows(base: np.ndarray, query: np.ndarray) -> np.ndarray:
    d = base - query
    return np.einsum("ij,ij->i", d, d)


def _l2_block(base: np.ndarray, queries: np.ndarray) -> np.ndarray:
    # differences, not the expanded square: equal vectors are at exactly 0
    out = np.empty((len(base), len(queries)))
    for j, q in enumerate(queries):
        out[:, j] = _l2_rows(base, q)
    return out


METRICS: dict[str, Metric] = {
    "ip": Metric(ip_distance, lambda base, queries: 1.0 - base @ queries.T, lambda base, query: 1.0 - np.einsum("ij,j->i", base, query)),
    "l2": Metric(l2_distance, _l2_block, _l2_rows),
    "l2_int": Metric(l2_int_distance, _l2_block, _l2_rows),
}


def register_metric(name: str, column: Callable[[Column, Column], Column], block: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Add a metric under a new name."""
    if name in METRICS:
        raise ValueError(f"metric {name!r} exists")
    METRICS[name] = Metric(column, block, rows)


def metric(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return METRICS[name]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a double matrix; null, ragged and non-finite vectors raise."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("null vector")
    flat = column.flatten()
    if flat.null_count or len(flat) % len(column):
        raise ValueError("vectors must have one length and no nulls")
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("vectors must have one length")
    out = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if not np.isfinite(out).all():
        raise ValueError("vector with NaN or infinity")
    return out


def checked(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows as they are; a null, wrong-length or non-finite vector fails the query when it runs."""
    v = F.col(vec)
    bad = v.isNull() | (F.size(v) != dim) | F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.withColumn(vec, F.when(bad, F.raise_error(F.lit(f"{vec} must hold {dim} finite numbers")).cast(df.schema[vec].dataType)).otherwise(v))
