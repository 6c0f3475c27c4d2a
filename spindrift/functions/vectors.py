"""Vectors as arrays of numbers, computed in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x * x))


def normalized(v) -> Column:
    """Length one; the zero vector stays zero."""
    n = norm(v)
    return F.transform(_c(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def argmax(v) -> Column:
    """Index of the first maximum, from 0."""
    c = F.col(v) if isinstance(v, str) else v
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def to_json(v) -> Column:
    return F.to_json(_c(v))


def from_json(text) -> Column:
    return F.from_json(F.col(text) if isinstance(text, str) else text, "array<double>")
