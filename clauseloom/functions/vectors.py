"""Vector arithmetic over ARRAY columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2sq", "cosine")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; NULL when the norm is zero or not finite."""
    length = norm(vector)
    usable = (length > 0) & ~F.isnan(length) & (length != float("inf"))
    return F.when(usable, F.transform(vector, lambda value: value.cast("double") / length))


def finite(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def similarity(left: Column, right: Column, metric: str = "l2sq") -> Column:
    """``1 - distance`` by squared L2, or the cosine, of any two vectors.

    NULL for non-finite vectors, and for the cosine of a zero vector.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    both = dot(left, right)
    value = (
        1 - (dot(left, left) + dot(right, right) - 2 * both)
        if metric == "l2sq"
        else both / F.nullif(norm(left) * norm(right), F.lit(0.0))
    )
    return F.when(finite(left) & finite(right), value)


def similarities(left: np.ndarray, right: np.ndarray, metric: str = "l2sq") -> np.ndarray:
    """``similarity`` of all rows of two matrices; NaN where it is NULL."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    a, b = (left * left).sum(axis=1)[:, None], (right * right).sum(axis=1)[None, :]
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        both = left @ right.T
        value = 1 - (a + b - 2 * both) if metric == "l2sq" else both / np.sqrt(a * b)
    value[~(np.isfinite(left).all(axis=1)[:, None] & np.isfinite(right).all(axis=1)[None, :])] = np.nan
    return value
