"""Vectors as arrays of doubles, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; zero vectors stay zero."""
    # the length is bound as an item of a list, or it would be computed again for each component
    return F.get(F.transform(F.array(norm(a)), lambda size: F.transform(a, lambda x: F.when(size > 0, x / size).otherwise(0.0))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
