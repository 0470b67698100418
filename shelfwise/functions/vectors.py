"""Expressions over ``array<double>`` feature vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(prods, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column | str) -> Column:
    """Unit-length vector; a zero vector stays zero."""
    n = norm(v)
    return F.transform(_c(v), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n))


def argmax(p: Column | str) -> Column:
    """Zero-based index of the first largest entry."""
    return (F.array_position(_c(p), F.array_max(_c(p))) - 1).cast("int")


def has_nan(v: Column | str) -> Column:
    return F.exists(_c(v), lambda x: F.isnan(x))
