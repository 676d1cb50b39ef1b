"""Vectors as columns: array<float or double> in, array<double> or double out.

A null vector gives null; so does a pair of different lengths (zip_with pads
with null). An empty vector has norm 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column, eps: float = EPS) -> Column:
    """v / (|v| + eps)."""
    n = norm(v) + eps
    return F.transform(doubles(v), lambda x: x / n)


def normalize_clamped(v: Column, eps: float = EPS) -> Column:
    """v / max(|v|, eps)."""
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(doubles(v), lambda x: x / n)


def normalize_or_zero(v: Column, eps: float = EPS) -> Column:
    """v / |v|, or zeros where |v| is at most eps."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n > eps, x / n).otherwise(0.0))


def distance2(a: Column, b: Column) -> Column:
    """Squared distance."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance2(a, b))


def best_dot(v: Column, stored: Column) -> Column:
    """Greatest dot product with any of the stored vectors; null if there is none."""
    return F.array_max(F.transform(stored, lambda s: dot(v, s)))


def mean_of(vectors: Column, dim: int) -> Column:
    """Elementwise mean of an array of vectors."""
    total = F.aggregate(vectors, F.array_repeat(F.lit(0.0), dim), lambda s, v: F.zip_with(s, doubles(v), lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vectors))
