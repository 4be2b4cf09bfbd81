"""Vector functions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    n = norm(a)
    length = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.zip_with(a, F.array_repeat(length, F.size(a)), lambda x, y: x.cast("double") / y)  # the norm is computed once, not per element


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Null for a zero vector if eps is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b) + F.lit(float(eps)))


def scaled(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * k)
