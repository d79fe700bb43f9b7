"""Links between scenes and entities, and the writes that keep them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenograph.functions.ids import scene_key, uuid5

# Fixed value: the namespace of scene uuids.
NAMESPACE = uuid.UUID("6f3a1e4c-2a93-4b5e-9c3a-1c4d9e7f0a11")


def chunk_uuid() -> Column:
    """The uuid that a scene's place gives, the same on every run."""
    return uuid5(scene_key(), NAMESPACE)


def to_entities(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_uuid, pos, entity_uuid, keyword) in the order of the references; the first of repeats counts, unknown ones drop out."""
    refs = chunks.select("chunk_uuid", F.posexplode(F.array_distinct("entity_refs")).alias("pos", "entity_uuid"))
    return refs.join(entities.select("entity_uuid", "keyword"), "entity_uuid").select("chunk_uuid", "pos", "entity_uuid", "keyword")


def to_chunks(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    refs = entities.select("entity_uuid", F.posexplode(F.array_distinct("chunk_refs")).alias("pos", "chunk_uuid"))
    return refs.join(chunks.select("chunk_uuid", "title"), "chunk_uuid").select("entity_uuid", "pos", "chunk_uuid", "title")


def previews(entities: DataFrame, chunks: DataFrame, most: int = 8) -> DataFrame:
    """(entity_uuid, pos, scene_index, title): the first `most` scenes an entity appears in, looked up in its own volume; missing scenes drop out."""
    seen = entities.select("entity_uuid", "novel_hash", "vol_num", F.posexplode(F.slice("appeared_in", 1, most)).alias("pos", "scene_index"))
    return seen.join(chunks.select("novel_hash", "vol_num", "scene_index", "title"), ["novel_hash", "vol_num", "scene_index"]).select("entity_uuid", "pos", "scene_index", "title")


def consistency(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_uuid, entity_uuid, side) of links that only one side has."""
    forth = chunks.select("chunk_uuid", F.explode("entity_refs").alias("entity_uuid")).where("entity_uuid is not null").distinct().withColumn("f", F.lit(1))
    back = entities.select(F.explode("chunk_refs").alias("chunk_uuid"), "entity_uuid").where("chunk_uuid is not null").distinct().withColumn("b", F.lit(1))
    both = forth.join(back, ["chunk_uuid", "entity_uuid"], "full").where("f is null or b is null")
    return both.select("chunk_uuid", "entity_uuid", F.when(F.col("f").isNotNull(), "chunk").otherwise("entity").alias("side"))


def backfill(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_uuid, entity_refs): references derived from the entities' side, sorted; chunks without any get an empty array."""
    back = entities.select(F.explode("chunk_refs").alias("chunk_uuid"), "entity_uuid").groupBy("chunk_uuid").agg(F.array_sort(F.collect_set("entity_uuid")).alias("entity_refs"))
    return chunks.select("chunk_uuid").join(back, "chunk_uuid", "left").select("chunk_uuid", F.coalesce("entity_refs", F.array().cast("array<string>")).alias("entity_refs"))


def append_scene(appeared_in: str, scene: str) -> Column:
    """appeared_in with a scene added at the end if it is new and greater than 0."""
    had = F.coalesce(F.col(appeared_in), F.array().cast("array<int>"))
    return F.when(F.col(scene) > 0, F.array_union(had, F.array(scene))).otherwise(had)


def upsert(current: DataFrame, incoming: DataFrame, key: str, reset_refs: str | None = None) -> DataFrame:
    """Keyed latest-wins: incoming rows replace current ones of the same key, the latest written_at first. reset_refs: an array column that replacing empties."""
    if reset_refs:
        incoming = incoming.withColumn(reset_refs, F.array().cast("array<string>"))
    both = current.select("*", F.lit(0).alias("_new")).unionByName(incoming.select("*", F.lit(1).alias("_new")), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (key, "_new")]
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("_new", "written_at")).alias("r")).select(key, "r.*")


def delete_volumes(df: DataFrame, doomed: DataFrame) -> DataFrame:
    """Rows outside the (novel_hash, vol_num) of doomed."""
    return df.join(doomed.select("novel_hash", "vol_num").distinct(), ["novel_hash", "vol_num"], "left_anti")


def misfiled(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Backup files (entity_uuid, folder_type) that lie under another type than the entity's current one."""
    canonical = entities.select("entity_uuid", F.col("entity_type").alias("folder_type"))
    known = files.join(entities.select("entity_uuid"), "entity_uuid", "left_semi")
    return known.join(canonical, ["entity_uuid", "folder_type"], "left_anti")
