"""Vector expressions on ARRAY columns; arithmetic is done in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(as_double(left), as_double(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vector), F.lit(0.0), lambda total, x: total + x * x))


def l2_normalize(vector: Column) -> Column:
    """Unit-length vector; a zero vector stays zero."""
    length = norm(vector)
    return F.transform(as_double(vector), lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)
