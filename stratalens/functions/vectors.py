"""Vector expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0; an error for unequal lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    checked = F.when(F.size(a) == F.size(b), F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms))
    return checked.otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def rounded(vector: Column, places: int = 5) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.round(x, places))
