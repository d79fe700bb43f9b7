"""Summaries of volumes, scene by scene: which scenes wait, the fold, and its compaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenograph.functions.predicates import not_tainted, valid_keyword

CHARACTERS, BACKGROUND = 10, 300


def pending(scenes: DataFrame, state: DataFrame) -> DataFrame:
    """Scenes with content that the state (novel_hash, vol_num, updated_scenes) does not name."""
    done = state.select("novel_hash", "vol_num", F.explode("updated_scenes").alias("scene_index")).distinct()
    return scenes.where("trim(coalesce(content, '')) <> ''").join(done, ["novel_hash", "vol_num", "scene_index"], "left_anti")


def scene_line(content: str = "content") -> Column:
    """The summariser's stand-in: a scene's first 50 characters on one line."""
    return F.trim(F.regexp_replace(F.left(F.col(content), F.lit(50)), r"\s+", " "))


def fold(scenes: DataFrame, entities: DataFrame, line: Callable[[], Column] = scene_line) -> DataFrame:
    """(novel_hash, vol_num, updated_scenes, protagonist, main_characters, key_locations, outline, background) of the volumes' scenes.

    The protagonist is the character with most appearances, up to ten others follow; the outline adds a line a scene, in order.
    """
    per = scenes.groupBy("novel_hash", "vol_num").agg(F.array_sort(F.collect_list(F.struct("scene_index", line().alias("line")))).alias("s"))
    told = per.select("novel_hash", "vol_num", F.transform("s", lambda x: x.scene_index).alias("updated_scenes"), F.array_join(F.transform("s", lambda x: x.line), " → ").alias("outline"))
    w = Window.partitionBy("novel_hash", "vol_num", "kind").orderBy(F.col("seen").desc(), "entity_uuid")
    cast = entities.where(not_tainted() & valid_keyword()).withColumn("kind", F.lower(F.trim("entity_type"))).where("kind in ('character', 'location')")
    ranked = cast.withColumn("seen", F.coalesce(F.size("appeared_in"), F.lit(0))).withColumn("n", F.row_number().over(w)).where(F.col("n") <= CHARACTERS + 1)
    who = ranked.groupBy("novel_hash", "vol_num").agg(
        F.max(F.when((F.col("kind") == "character") & (F.col("n") == 1), F.col("keyword"))).alias("protagonist"),
        F.array_sort(F.collect_list(F.when((F.col("kind") == "character") & (F.col("n") > 1), F.struct("n", "keyword")))).alias("c"),
        F.array_sort(F.collect_list(F.when((F.col("kind") == "location") & (F.col("n") <= CHARACTERS), F.struct("n", "keyword")))).alias("l"),
    )
    who = who.select("novel_hash", "vol_num", "protagonist", F.transform("c", lambda x: x.keyword).alias("main_characters"), F.transform("l", lambda x: x.keyword).alias("key_locations"))
    return told.join(who, ["novel_hash", "vol_num"], "left").withColumn("background", F.col("outline"))


def resume(state: DataFrame, scenes: DataFrame, line: Callable[[], Column] = scene_line) -> DataFrame:
    """The state after the scenes that wait: (novel_hash, vol_num, updated_scenes, outline, compacted).

    state has the same columns. Scenes it names are skipped, the outline so far is carried on with a line for each new scene in order; volumes without
    new scenes keep their state, volumes without state begin with an empty one. What changes is no longer compacted.
    """
    todo = pending(scenes, state).groupBy("novel_hash", "vol_num").agg(F.array_sort(F.collect_list(F.struct("scene_index", line().alias("line")))).alias("s"))
    both = state.join(todo, ["novel_hash", "vol_num"], "full")
    had, new = F.coalesce("updated_scenes", F.array().cast("array<int>")), F.coalesce(F.transform("s", lambda x: x.scene_index), F.array().cast("array<int>"))
    lines = F.filter(F.concat(F.array("outline"), F.coalesce(F.transform("s", lambda x: x.line), F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    return both.select("novel_hash", "vol_num", F.array_sort(F.array_union(had, new)).alias("updated_scenes"), F.array_join(lines, " → ").alias("outline"), (F.col("s").isNull() & F.coalesce("compacted", F.lit(False))).alias("compacted"))


def compacted(state: DataFrame, scenes: DataFrame, most: int = BACKGROUND) -> DataFrame:
    """The state with the outline cut to `most` characters where every scene with content is updated and it was not cut before; an empty outline counts as cut."""
    total = scenes.where("trim(coalesce(content, '')) <> ''").groupBy("novel_hash", "vol_num").agg(F.count("*").alias("_n"))
    whole = F.coalesce(F.size("updated_scenes") >= F.col("_n"), F.lit(False))
    cut = whole & ~F.col("compacted")
    joined = state.join(total, ["novel_hash", "vol_num"], "left")
    return joined.withColumn("outline", F.when(cut, F.left("outline", F.lit(most))).otherwise(F.col("outline"))).withColumn("compacted", F.col("compacted") | whole).drop("_n")


def compact(summaries: DataFrame, scenes: DataFrame, most: int = BACKGROUND) -> DataFrame:
    """Background cut to `most` characters and compacted = true where all scenes of the volume are updated and there is one; others stay as they are."""
    total = scenes.where("trim(coalesce(content, '')) <> ''").groupBy("novel_hash", "vol_num").agg(F.count("*").alias("_n"))
    whole = F.coalesce(F.size("updated_scenes") >= F.col("_n"), F.lit(False)) & (F.coalesce("background", F.lit("")) != "")
    return summaries.join(total, ["novel_hash", "vol_num"], "left").withColumn("compacted", whole).withColumn("background", F.when(whole, F.left("background", F.lit(most))).otherwise(F.col("background"))).drop("_n")
