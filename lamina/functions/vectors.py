"""Vector expressions. Embeddings are arrays of floats; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1.1920929e-07


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b for unit vectors: 0 for equal, 2 for opposite directions."""
    return F.lit(1.0) - dot(a, b)


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def l2_normalised(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(EPSILON))
    return F.transform(v, lambda x: x.cast("double") / norm)


def literal(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def require_dim(v: Column, dim: int) -> Column:
    """The vector; the query fails where its length differs."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.lit(f"vectors must have {dim} values")).cast("array<float>"))
