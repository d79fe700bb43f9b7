"""Schemas of the two layers, and their tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

CHUNK = "chunk_uuid string, novel_hash string, vol_num int, scene_index int, title string, content string, token_count int, entity_refs array<string>, full_text_vec array<float>, summary_vec array<float>, written_at timestamp"
ENTITY = (
    "entity_uuid string, novel_hash string, vol_num int, entity_type string, keyword string, aliases array<string>, categories array<string>, description string, "
    "major_status_changes array<struct<scene_index:int,event:string>>, appeared_in array<int>, chunk_refs array<string>, tainted boolean, tainted_reason string, identity_vec array<float>, content_vec array<float>, written_at timestamp"
)


def create_tables(spark: SparkSession, database: str, location: str) -> None:
    """Both layers as Parquet tables partitioned by novel and volume, if they are not there."""
    spark.sql(f"create database if not exists {database} location '{location}'")
    for name, schema in (("chunks", CHUNK), ("entities", ENTITY)):
        spark.sql(f"create table if not exists {database}.{name} ({schema}) using parquet partitioned by (novel_hash, vol_num)")
