"""Distances between array columns, as expressions. Elements are doubles before arithmetic, sums run left to right."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def as_double(vector: Column | str) -> Column:
    return F.col(vector).cast("array<double>") if isinstance(vector, str) else vector.cast("array<double>")


def l2_squared(a: Column | str, b: Column | str) -> Column:
    """Sum of squared differences."""
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def inner_product(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(as_double(a), lambda x: x * x)))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Null where a vector is zero."""
    return F.nullif(inner_product(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(float("nan")))


def pairwise(a: np.ndarray, b: np.ndarray, metric: str = "l2") -> np.ndarray:
    """All distances of two blocks by one matrix product; smaller is nearer for each metric."""
    if metric == "ip":
        return -(a @ b.T)
    if metric == "cosine":
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return 1 - unit(a) @ unit(b).T
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def rowwise(a: np.ndarray, b: np.ndarray, metric: str = "l2") -> np.ndarray:
    """Distances of rows that belong together; equal vectors give equal distances, bit for bit."""
    if metric == "ip":
        return -(a * b).sum(1)
    if metric == "cosine":
        return 1 - (a * b).sum(1) / np.maximum(np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)), 1e-300)
    return ((a - b) ** 2).sum(1)
