"""What the knowledge base holds: novels, volumes, types, and a novel's profile. All counts are over current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenograph.functions.predicates import not_tainted


def volumes(chunks: DataFrame) -> DataFrame:
    """(novel_hash, vol_num, scenes), and with null vol_num the novel's total, in one pass."""
    return chunks.rollup("novel_hash", "vol_num").agg(F.count("*").alias("scenes"), F.grouping_id().alias("level")).where("level < 3")


def list_novels(chunks: DataFrame, entities: DataFrame, titles: DataFrame, default: str = "untitled") -> DataFrame:
    """Novels that have scenes: title, volumes with scene counts in order, scene total, entity total (tainted ones included)."""
    per_vol = chunks.groupBy("novel_hash", "vol_num").agg(F.count("*").alias("scenes"))
    per_novel = per_vol.groupBy("novel_hash").agg(F.array_sort(F.collect_list(F.struct("vol_num", "scenes"))).alias("vols"), F.sum("scenes").alias("scene_count"))
    named = entities.groupBy("novel_hash").agg(F.count("*").alias("entity_count"))
    out = per_novel.join(named, "novel_hash", "left").join(titles.select("novel_hash", "title"), "novel_hash", "left")
    return out.select("novel_hash", F.coalesce("title", F.lit(default)).alias("title"), "vols", "scene_count", F.coalesce("entity_count", F.lit(0)).alias("entity_count"))


def profile_types(entities: DataFrame) -> DataFrame:
    """Entities per novel and type without tainted ones; no type counts as unknown."""
    return entities.where(not_tainted()).groupBy("novel_hash", F.coalesce("entity_type", F.lit("unknown")).alias("entity_type")).agg(F.count("*").alias("entities"))


def appearances(c: str = "appeared_in"):
    return F.coalesce(F.size(F.filter(F.col(c), lambda x: x.isNotNull())), F.lit(0))


def entity_types(entities: DataFrame) -> DataFrame:
    return entities.where("entity_type is not null and trim(entity_type) <> ''").select("entity_type").distinct()


def max_volume(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("novel_hash").agg(F.coalesce(F.max("vol_num"), F.lit(1)).alias("max_vol"))
