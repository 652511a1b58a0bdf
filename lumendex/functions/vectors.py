"""Vector math as native array expressions, accumulated in double in array order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    scaled = F.transform(F.array(magnitude(v)), lambda m: F.transform(v, lambda x: x.cast("double") / m))  # the magnitude once a row
    return F.element_at(scaled, 1)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (magnitude(a) * magnitude(b))


def score(similarity: Column) -> Column:
    """Relevance from a cosine similarity: clamped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity))


def is_valid(v: Column, dim: int | None = None) -> Column:
    """Not empty, not all zero and, if given, of the right dimension."""
    ok = (F.size(v) > 0) & F.exists(v, lambda x: x != 0)
    return ok & (F.size(v) == dim) if dim else ok
