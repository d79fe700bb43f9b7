"""A key/value dataset: records under dotted keys as partitioned JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def put(df: DataFrame, base: str, keys: list[str]) -> None:
    """Write records under their key columns; partitions that df holds are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(base)


def _there(spark: SparkSession, base: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def get(spark: SparkSession, base: str, schema: StructType, **keys) -> DataFrame:
    """Records of the given keys; a missing dataset and unreadable records give no rows."""
    if not _there(spark, base):
        return spark.createDataFrame([], schema)
    guarded = StructType([*schema.fields]).add("_corrupt", "string")
    rows = spark.read.schema(guarded).option("columnNameOfCorruptRecord", "_corrupt").json(base)
    for k, v in keys.items():
        rows = rows.where(F.col(k) == v)
    # a value is looked at as well, since Spark does not read records for the corrupt column alone
    data = [f.name for f in schema.fields]
    return rows.where(F.col("_corrupt").isNull() & (F.to_json(F.struct(*data)) != "")).drop("_corrupt")


def list_keys(spark: SparkSession, base: str, schema: StructType, keys: list[str]) -> DataFrame:
    """Distinct keys in order; numbers order as numbers."""
    return get(spark, base, schema).select(*keys).distinct().orderBy(*keys)


def history(rows: DataFrame, by: list[str], order: list[Column], value: str, most: int) -> DataFrame:
    """(by, history): the last `most` values of each key in order, joined by line ends; Spark cuts each key's rows before the shuffle."""
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*[c.desc() for c in order]))).where(F.col("_n") <= most)
    return last.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))), lambda x: F.coalesce(x.v, F.lit(""))), "\n").alias("history"))


def append_log(df: DataFrame, base: str) -> None:
    """A step's log: records are only ever added."""
    df.write.mode("append").json(base)
