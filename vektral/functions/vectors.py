"""Expressions over array<double> columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return dot(a, a)


def l2_normalized(a: Column, floor: float = 1e-14) -> Column:
    size = F.greatest(F.sqrt(squared_norm(a)), F.lit(floor))
    return F.transform(a, lambda x: x / size)


def l1_normalized(a: Column, floor: float = 1e-14) -> Column:
    size = F.greatest(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x)), F.lit(floor))
    return F.transform(a, lambda x: x / size)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def gather(a: Column, index: list[int]) -> Column:
    """Elements by a constant list of places (from 0)."""
    return F.transform(F.array(*[F.lit(i) for i in index]), lambda i: F.element_at(a, i + 1))


def distance(a: Column, b: Column, metric: str) -> Column:
    """euclidean, sqeuclidean, cityblock, chebychev, cosine, correlation or minkowski (order 3)."""
    diff = F.zip_with(a, b, lambda x, y: x - y)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    if metric in ("euclidean", "sqeuclidean"):
        d = total(F.transform(diff, lambda x: x * x))
        return F.sqrt(d) if metric == "euclidean" else d
    if metric == "cityblock":
        return total(F.transform(diff, F.abs))
    if metric == "chebychev":
        return F.array_max(F.transform(diff, F.abs))
    if metric == "minkowski":
        return F.pow(total(F.transform(diff, lambda x: F.pow(F.abs(x), F.lit(3.0)))), F.lit(1 / 3))
    if metric == "cosine":
        return 1 - dot(a, b) / F.sqrt(squared_norm(a) * squared_norm(b))
    if metric == "correlation":
        centre = lambda v: F.transform(v, lambda x: x - total(v) / F.size(v))
        return distance(centre(a), centre(b), "cosine")
    raise ValueError(f"unknown metric {metric}")


def kernel(a: Column, b: Column, kind: str, t: float = 1.0, degree: int = 2, gamma: float = 1.0, c: float = 0.0) -> Column:
    """gaussian exp(-d2/2t2), rbf exp(-d2/t2), linear, polynomial, polyplus, sigmoid."""
    if kind in ("gaussian", "rbf"):
        return F.exp(-distance(a, b, "sqeuclidean") / ((2 if kind == "gaussian" else 1) * t * t))
    if kind == "linear":
        return dot(a, b)
    if kind == "polynomial":
        return F.pow(dot(a, b), F.lit(float(degree)))
    if kind == "polyplus":
        return F.pow(dot(a, b) + 1, F.lit(float(degree)))
    if kind == "sigmoid":
        return F.tanh(gamma * dot(a, b) + c)
    raise ValueError(f"unknown kernel {kind}")


def zero_to_one(v: Column) -> Column:
    """Bytes as shares of 255."""
    return F.transform(v, lambda x: x / 255)


def gauss_error(f: Column) -> Column:
    """The weight of an error given as its square over its width."""
    return F.exp(-f / 2)


def row_deviation(v: Column) -> Column:
    """The sample standard deviation of a vector's own components; null for fewer than two."""
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(squares / (n - 1)))
