"""Vector functions on arrays of numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a null or zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x / n)


def literal(values: list[float]) -> Column:
    """A vector as a constant, with its elements as doubles."""
    if any(v is None or math.isnan(v) for v in values):
        raise ValueError("a query vector has no value somewhere")
    return F.array(*(F.lit(float(v)) for v in values))
