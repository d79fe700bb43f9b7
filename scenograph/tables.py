"""Reading the tables of a data folder and the latest row of an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_rows(df: DataFrame, key: str, columns: list[str], at: str = "written_at") -> DataFrame:
    """The row of each key with the greatest `at`; copies count once. Null keys are dropped. Only the named columns are shuffled.

    Rows of one key with the same time but other values: the one with the greater hash of the values, so the choice is stable.
    """
    cols = [c for c in columns if c != key]
    packed = F.struct(*cols)
    best = F.max_by(packed, F.struct(F.col(at), F.xxhash64(*cols) if cols else F.lit(0)))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
