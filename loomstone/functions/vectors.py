"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similarity_score(cos: Column) -> Column:
    """Cosine mapped into [0, 1], four digits."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2)), 4)
