"""Incremental ingest: idempotent upserts from a stream, and per-volume progress as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scenograph.tables import current_rows


def rows_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A folder or file of Parquet as a stream of rows."""
    schema = spark.read.parquet(path).schema
    # as a pattern, since a stream takes the path of a single file for a folder otherwise
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def upsert_stream(rows: DataFrame, key: str, columns: list[str], target: str, checkpoint: str) -> None:
    """Append the current rows of every micro-batch to target until the input is read; a batch that runs again replaces its own files, so nothing doubles."""

    def write(batch: DataFrame, number: int) -> None:
        current_rows(batch, key, columns).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upserted(spark: SparkSession, key: str, columns: list[str], target: str) -> DataFrame:
    """The table that the batches make together: the latest row of each key."""
    return current_rows(spark.read.parquet(target), key, columns)


PROGRESS = "novel_hash string, vol_num int, scenes int, tokens long, last_scene int"


def volume_progress(rows: DataFrame) -> DataFrame:
    """Scenes of a stream counted once per volume however often they come; the state holds scene numbers, not texts. Use with output mode update."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, tokens = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        known = set(seen)
        for b in batches:
            b = b[b.scene_index.notna()].drop_duplicates("scene_index")
            new = b[~b.scene_index.isin(known)]
            known.update(int(x) for x in new.scene_index)
            tokens += int(new.token_count.fillna(0).sum())
        state.update((sorted(known), tokens))
        yield pd.DataFrame([{"novel_hash": key[0], "vol_num": key[1], "scenes": len(known), "tokens": tokens, "last_scene": max(known, default=0)}])

    narrow = rows.where("novel_hash is not null and vol_num is not null").select("novel_hash", "vol_num", "scene_index", "token_count")
    return narrow.groupBy("novel_hash", "vol_num").applyInPandasWithState(step, PROGRESS, "scenes array<int>, tokens long", "update", GroupStateTimeout.NoTimeout)


def run_progress(rows: DataFrame, target: str, checkpoint: str) -> None:
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    volume_progress(rows).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
