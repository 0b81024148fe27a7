"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespan.functions.text import col


def dims(v: Column | str) -> Column:
    return F.size(col(v))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def literal(v: list[float]) -> Column:
    """A query vector as a literal: it needs no join."""
    return F.array(*[F.lit(float(x)) for x in v])


def cosine(a: Column | str, b: Column | str) -> Column:
    """1 less the cosine distance; null if either vector is null or all zero, or their lengths differ."""
    n = norm(a) * norm(b)
    return F.when((dims(a) == dims(b)) & (n > 0), dot(a, b) / n)
