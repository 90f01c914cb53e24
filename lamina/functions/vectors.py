"""Vector columns (array<float>), computed in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """v over its length; a zero vector stays zero."""
    return F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: x.cast("double") / F.when(s["n"] == 0, 1.0).otherwise(s["n"])))[0]


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def negative_squared_distance(a: Column, b: Column) -> Column:
    return -squared_distance(a, b)


def expanded_distance(a: Column, b: Column) -> Column:
    """Squared distance from norms and inner product, never below 0."""
    return F.greatest(dot(a, a) - 2 * dot(a, b) + dot(b, b), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """2 - 2 cos of two vectors, which is the squared distance of unit vectors."""
    return 2 - 2 * dot(normalized(a), normalized(b))


def finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())


def nearly_zero(v: Column, tolerance: float = TINY) -> Column:
    return norm(v) <= tolerance


def is_unit(v: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(norm(v) - 1) <= tolerance
