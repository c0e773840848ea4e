"""Vector operators: dot products, normalization, truncation, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision, from the first component to the last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Of unit length; zeros where the length is 1e-10 or less."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 1e-10, x.cast("double") / n).otherwise(0.0))


def truncate(v: Column, dim: int) -> Column:
    return F.slice(v, 1, dim)


def cosine_top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score) of the k largest dot products with one query vector; ties go to the smaller key."""
    literal = F.lit([float(x) for x in query])
    return vectors.where(F.col(vector).isNotNull()).select(key, dot(F.col(vector), literal).alias("score")).orderBy(F.desc("score"), key).limit(k)
