"""Vectors as arrays of floats, worked on in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero or the sizes differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)



def normalised(a: Column, digits: int | None = None) -> Column:
    """The vector with length one; a zero vector stays."""
    size = norm(a)
    scale = F.when(size == 0, 1.0).otherwise(size)
    part = lambda x: x.cast("double") / scale
    return F.transform(a, part if digits is None else lambda x: F.round(part(x), digits))
