"""Arrays and vectors (A5, X4, X5, X7, X12) as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """The inner product in double precision; null where lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def norm(v) -> Column:
    """X4."""
    return F.sqrt(dot(v, v))


def cosine(a, b) -> Column:
    """Null where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def centroid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean vector of each key; components are averaged apart, so nothing wide is gathered."""
    each = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def project(v, mean: list[float], component: list[float]) -> Column:
    """(v - mean) . component for a fitted component (driver-side constants of one vector's length)."""
    m, c = F.array(*map(F.lit, mean)), F.array(*map(F.lit, component))
    return dot(F.zip_with(v, m, lambda x, y: x.cast("double") - y), c)


def entropy_bits(counts) -> Column:
    """A5: Shannon entropy in bits of an array of counts; 0 for at most one item or a zero total."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x.cast("double"))
    h = F.aggregate(counts, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.log2(x / total)).otherwise(F.lit(0.0)))
    return F.when((F.size(counts) <= 1) | (total <= 0), F.lit(0.0)).otherwise(h)


def valid_vector(v) -> Column:
    """Every component is there and a number."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
