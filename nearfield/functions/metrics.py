"""Distances: smaller is closer for every metric.

``l2`` is the squared Euclidean distance, ``cosine`` one minus the product of the
normalised vectors, ``inner_product`` the negated product.
"""

from __future__ import annotations

from enum import StrEnum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, InvalidParameter

#: Squared lengths up to this count as zero; the least normal double.
TINY = float(np.finfo(np.float64).tiny)


class Metric(StrEnum):
    L2 = "l2"
    COSINE = "cosine"
    INNER_PRODUCT = "inner_product"

    @classmethod
    def parse(cls, text: str | Metric) -> Metric:
        # Names users may write for each metric.
        names = {"l2": cls.L2, "euclidean": cls.L2, "cosine": cls.COSINE, "cos": cls.COSINE, "inner_product": cls.INNER_PRODUCT, "inner-product": cls.INNER_PRODUCT, "ip": cls.INNER_PRODUCT, "dot": cls.INNER_PRODUCT}
        found = names.get(str(text).strip().lower())
        if found is None:
            raise InvalidParameter(f"unknown metric {text!r}")
        return found


def active_kernel(strategy: str = "numpy") -> str:
    """Name of what computes distances under a strategy, for statistics."""
    return {"numpy": "numpy", "sql": "spark-hof"}[strategy]


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(vector: Column) -> Column:
    """Unit vector of the same direction, as doubles; a zero vector stays as it is."""
    v = as_doubles(vector)
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return F.when(square > TINY, F.transform(v, lambda x: x / F.sqrt(square))).otherwise(v)


def prepare(metric: Metric, vector: Column) -> Column:
    return l2_normalize(vector) if metric is Metric.COSINE else as_doubles(vector)


def distance_prepared(metric: Metric, a: Column, b: Column) -> Column:
    """Distance of two vectors that :func:`prepare` has seen; null if a side is null or the lengths differ."""
    if metric is Metric.L2:
        return l2_squared(a, b)
    product = inner_product(a, b)
    return 1 - product if metric is Metric.COSINE else -product


def distance(metric: str | Metric, a: Column, b: Column) -> Column:
    metric = Metric.parse(metric)
    return distance_prepared(metric, prepare(metric, a), prepare(metric, b))


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def prepare_array(metric: Metric, x: np.ndarray) -> np.ndarray:
    """Rows as doubles, normalised for cosine."""
    x = np.asarray(x, np.float64)
    if metric is not Metric.COSINE:
        return x
    square = (x**2).sum(axis=-1, keepdims=True)
    return np.where(square > TINY, x / np.sqrt(np.where(square > TINY, square, 1.0)), x)


def l2_squared_batch(query: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Squared distances of one query to each row, or of each of several queries to each row."""
    _same_width(query, block)
    if query.ndim == 1:
        return ((block - query) ** 2).sum(axis=1)
    out = np.empty((len(query), len(block)))
    for i, q in enumerate(query):  # differences, not the expanded square: no cancellation
        d = block - q
        out[i] = np.einsum("ij,ij->i", d, d)
    return out


def inner_product_batch(query: np.ndarray, block: np.ndarray) -> np.ndarray:
    _same_width(query, block)
    return query @ block.T


def distances_batch(metric: Metric, query: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Distances between prepared arrays."""
    if metric is Metric.L2:
        return l2_squared_batch(query, block)
    product = inner_product_batch(query, block)
    return 1 - product if metric is Metric.COSINE else -product


def _same_width(query: np.ndarray, block: np.ndarray) -> None:
    if block.ndim != 2 or query.shape[-1] != block.shape[1]:
        raise DimensionMismatch(block.shape[-1], query.shape[-1])
