"""Volumes of novels as text files: one folder a novel, one file a volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenograph.functions.ids import tenant_hash
from scenograph.functions.text import line_ends, number_in


def list_volumes(spark: SparkSession, base: str, first: int = 0, last: int = 0) -> DataFrame:
    """(path, folder, file, vol_num) of the text files under base, volumes from first to last (0: no bound); no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(base).select("path")
    named = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    rows = named.withColumn("vol_num", number_in("file")).where(F.col("vol_num") >= first)
    return rows.where(F.col("vol_num") <= last) if last > 0 else rows


def read_volumes(spark: SparkSession, base: str, first: int = 0, last: int = 0) -> DataFrame:
    """(novel_hash, folder, vol_num, text), line ends made one.

    Files lie as <folder>/<file>, or as folder=<folder>/vol=<file>/<part> as write_volumes() lays them out. The volume bounds are a filter on the files' own
    metadata, so files outside them are not opened. The tenant hash is of the folder's own name, so that it does not change with the machine.
    """
    text = spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    path = F.col("_metadata.file_path")
    named = lambda key, plain: F.coalesce(F.nullif(F.regexp_extract(path, f"/{key}=([^/]+)/", 1), F.lit("")), F.regexp_extract(path, plain, 1))
    folder, number = named("folder", r"([^/]+)/[^/]+$"), number_in(named("vol", r"([^/]+)$"))
    inside = (number >= first) & (number <= last) if last > 0 else number >= first
    return text.where(inside).select(tenant_hash(folder).alias("novel_hash"), folder.alias("folder"), number.alias("vol_num"), line_ends("value").alias("text"))


def write_volumes(df: DataFrame, base: str) -> None:
    """df(folder, vol_num, text), one row a volume, as text files, one folder per novel and volume."""
    named = df.select(F.concat_ws("/", "folder").alias("folder"), F.concat(F.lit("vol"), F.col("vol_num").cast("string")).alias("vol"), F.col("text").alias("value"))
    named.repartition("folder", "vol").write.partitionBy("folder", "vol").option("lineSep", "\n").text(base)
