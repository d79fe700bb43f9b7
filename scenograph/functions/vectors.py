"""Vectors: a deterministic embedder by hashed tokens, and similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenograph.functions.text import tokens

BUCKETS = 64


def bucket(token: Column | str, buckets: int = BUCKETS) -> Column:
    """A token's bucket: the first 8 hex digits of its md5, modulo the number of buckets."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def sparse_vectors(df: DataFrame, keys: list[str], text: str, buckets: int = BUCKETS) -> DataFrame:
    """(keys, bucket, weight) with unit length per key: counts of hashed tokens. Texts without tokens have no rows."""
    return unit(bucket_counts(df, keys, text, buckets), keys)


def bucket_counts(df: DataFrame, keys: list[str], text: str, buckets: int = BUCKETS) -> DataFrame:
    """(keys, bucket, c): hashed tokens counted."""
    return df.select(*keys, F.explode(tokens(text)).alias("t")).select(*keys, bucket("t", buckets).alias("bucket")).groupBy(*keys, "bucket").agg(F.count("*").cast("double").alias("c"))


def unit(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts (keys, bucket, c) brought to unit length per key: (keys, bucket, weight)."""
    norms = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return counts.join(norms, keys).select(*keys, "bucket", (F.col("c") / F.col("norm")).alias("weight"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; lengths under 1e-8 count as 1e-8."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.greatest(F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))), F.lit(1e-8))
    return dot / (norm(a) * norm(b))


def certainty(cos: Column | str) -> Column:
    """1 - distance / 2 with distance = 1 - cosine, at least 0; no distance counts as 2."""
    cos = F.col(cos) if isinstance(cos, str) else cos
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(F.lit(1.0) - cos, F.lit(2.0)) / 2)
