"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, guard: float = 1e-8) -> Column:
    """v / (|v| + guard)."""
    return F.transform(doubles(v), lambda x: x / (norm(v) + F.lit(guard)))


def with_normalised(df: DataFrame, vector: str, out: str, guard: float = 1e-8) -> DataFrame:
    """Adds out = vector / (|vector| + guard); the norm is a column of its own, computed once a row."""
    held = df.withColumn("_norm", norm(F.col(vector)))
    return held.withColumn(out, F.transform(doubles(F.col(vector)), lambda x: x / (F.col("_norm") + F.lit(guard)))).drop("_norm")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(a: Column, b: Column, scale: float = 255.0) -> Column:
    """1 - mean absolute difference / scale."""
    gaps = F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))
    return 1 - total(gaps) / F.size(gaps) / F.lit(float(scale))


def pooled(vectors: Column) -> Column:
    """Mean and maximum over an array of vectors, laid end to end."""
    first = F.element_at(vectors, 1)
    places = F.sequence(F.lit(0), F.size(first) - 1)
    mean = F.transform(places, lambda k: total(F.transform(vectors, lambda v: F.get(v, k).cast("double"))) / F.size(vectors))
    top = F.transform(places, lambda k: F.array_max(F.transform(vectors, lambda v: F.get(v, k).cast("double"))))
    return F.concat(mean, top)
