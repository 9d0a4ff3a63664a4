"""Dense-vector arithmetic as column expressions over ``array<float>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays zero (V2)."""
    length = norm(v)
    safe = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.transform(v, lambda x: x.cast("double") / safe)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either norm is 0 (V3)."""
    denom = norm(a) * norm(b)
    return F.when(denom == 0, F.lit(0.0)).otherwise(dot(a, b) / denom)


def as_vector(values: list[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(x)) for x in values])
