"""Distances between vectors: as Column expressions, which Spark evaluates element by element, and for blocks of vectors, which
search uses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("sqeuclidean", "cosine", "ip")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def distance(a: Column, b: Column, metric: str = "sqeuclidean") -> Column:
    """Squared Euclidean distance, cosine distance, or one minus the inner product; smaller is nearer. Vectors of unequal
    length have no distance (null)."""
    if metric == "sqeuclidean":
        value = _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))))
    elif metric == "cosine":
        value = 1 - _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))
    elif metric == "ip":
        value = 1 - _dot(a, b)
    else:
        raise ValueError(f"metric must be one of {METRICS}")
    return F.when(F.size(a) == F.size(b), value)


def distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows): the same for blocks, in double precision."""
    if metric == "sqeuclidean":
        out = (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * queries @ rows.T
        return np.maximum(out, 0)
    if metric == "cosine":
        norms = np.sqrt((queries**2).sum(1)[:, None] * (rows**2).sum(1)[None, :])
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - queries @ rows.T / norms
    if metric == "ip":
        return 1 - queries @ rows.T
    raise ValueError(f"metric must be one of {METRICS}")


def exact_distances(query: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """The same of one query, without the digits that expanding the square loses."""
    return ((rows - query) ** 2).sum(axis=1) if metric == "sqeuclidean" else distances(query[None, :], rows, metric)[0]
