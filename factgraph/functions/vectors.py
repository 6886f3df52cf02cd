"""Vectors as arrays of doubles; zip_with and aggregate stay within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def scaled_cosine(a: Column, b: Column, scale: str = "unit") -> Column:
    """Raw cosine, or moved to 0..1."""
    return cosine(a, b) if scale == "raw" else (cosine(a, b) + 1) / 2


def l2_normalize(a: Column) -> Column:
    """Unchanged where the vector is zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))
