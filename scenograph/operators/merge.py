"""Merging a new reading of an entity into the old one, and signs that two were merged by mistake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenograph.functions.vectors import sparse_vectors

MOST_ALIASES, LONGEST_DESCRIPTION, LEAST_COSINE = 8, 800, 0.75
CHANGE = "array<struct<scene_index:int,event:string>>"


def _array(c: Column | str, kind: str = "array<string>") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast(kind))


def canonical_name(old: str, new: str) -> Column:
    """The old name stays unless it is unknown."""
    return F.when(F.coalesce(F.col(old), F.lit("")).contains("未知"), F.col(new)).otherwise(F.coalesce(F.col(old), F.lit("")))


def merged_aliases(old_aliases: str, new_aliases: str, old: str, new: str) -> Column:
    """Union of both, sorted; a new name that lost to the old one joins them."""
    lost = ~F.coalesce(F.col(old), F.lit("")).contains("未知") & ~F.coalesce(F.col(old), F.lit("")).eqNullSafe(F.col(new)) & F.col(new).isNotNull()
    both = F.array_union(_array(new_aliases), _array(old_aliases))
    return F.array_sort(F.filter(F.when(lost, F.array_union(both, F.array(new))).otherwise(both), lambda a: a.isNotNull()))


def merged_changes(old: str, new: str) -> Column:
    """All old changes and of each scene they do not know the first new one, in order of scenes; old before new where scenes are equal."""
    had, more = _array(old, CHANGE), _array(new, CHANGE)
    fresh = F.filter(more, lambda n: ~F.exists(had, lambda o: o.scene_index.eqNullSafe(n.scene_index)))
    firsts = F.filter(F.transform(fresh, lambda n, i: F.struct(i.alias("i"), n.alias("n"))), lambda x: ~F.exists(F.slice(fresh, F.lit(1), x.i), lambda p: p.scene_index.eqNullSafe(x.n.scene_index)))
    every = F.concat(had, F.transform(firsts, lambda x: x.n))
    placed = F.transform(every, lambda c, i: F.struct(F.coalesce(c.scene_index, F.lit(0)).alias("s"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(placed), lambda x: x.c)


def locked_type(old: str, new: str) -> Column:
    """The old type stays where there is one."""
    return F.when(F.trim(F.coalesce(F.col(old), F.lit(""))) != "", F.trim(old)).otherwise(F.col(new))


def categories_after_lock(categories: str, old: str, new: str) -> Column:
    """A new type that lost to the old one is kept as a category."""
    kept = F.trim(F.coalesce(F.col(old), F.lit("")))
    lost = (kept != "") & (F.coalesce(F.col(new), F.lit("")) != "") & (F.col(new) != kept)
    return F.when(lost, F.array_union(_array(categories), F.array(new))).otherwise(_array(categories))


def taint(aliases: Column, description: Column, cosine: Column | None = None, renamed: Column | None = None) -> tuple[Column, Column]:
    """(tainted, reason): more aliases or a longer description than one entity has, or a renamed entity whose names lie apart."""
    n, length = F.size(F.coalesce(aliases, F.array().cast("array<string>"))), F.length(F.coalesce(description, F.lit("")))
    parts = [F.when(n > MOST_ALIASES, F.concat(F.lit("aliases "), n.cast("string"))), F.when(length > LONGEST_DESCRIPTION, F.concat(F.lit("description "), length.cast("string")))]
    if cosine is not None:
        apart = (renamed if renamed is not None else F.lit(True)) & (cosine < LEAST_COSINE)
        parts.append(F.when(apart, F.format_string("cosine %.2f", cosine)))
    reason = F.concat_ws(", ", *parts)
    return reason != "", reason


def versions(entities: DataFrame) -> DataFrame:
    """Each row of an entity beside its previous one: the columns and old_* of keyword, aliases, entity_type, categories. Copies count once."""
    rows = entities.dropDuplicates(["entity_uuid", "written_at"])
    w = Window.partitionBy("entity_uuid").orderBy("written_at")
    olds = {f"old_{c}": F.lag(c).over(w) for c in ("keyword", "aliases", "entity_type", "categories", "content")}
    return rows.withColumns({**olds, "version": F.row_number().over(w)})


def name_cosines(pairs: DataFrame) -> DataFrame:
    """pairs(entity_uuid, version, old_keyword, keyword) -> the same with renamed (both names stand, trimmed, and differ) and their cosine, 0 where they share no bucket."""
    keys = ["entity_uuid", "version"]
    pairs = pairs.withColumn("renamed", F.coalesce((F.trim("old_keyword") != "") & (F.trim("keyword") != "") & (F.trim("old_keyword") != F.trim("keyword")), F.lit(False)))
    old, new = (sparse_vectors(pairs.where("renamed"), keys, c).withColumnRenamed("weight", w) for c, w in (("old_keyword", "wo"), ("keyword", "wn")))
    cosines = old.join(new, [*keys, "bucket"]).groupBy(*keys).agg(F.sum(F.col("wo") * F.col("wn")).alias("cosine"))
    return pairs.join(cosines, keys, "left").withColumn("cosine", F.coalesce(F.round("cosine", 12), F.lit(0.0)))


def fold(mentions: DataFrame) -> DataFrame:
    """Mentions of one keyword in a volume merged in order (scene, ordinal) into one entity without leaving the JVM.

    (novel_hash, vol_num, keyword, entity_type, aliases, categories, appeared_in, mentions): the first type wins, later ones become categories.
    """
    rows = mentions.groupBy("novel_hash", "vol_num", "keyword").agg(F.array_sort(F.collect_list(F.struct("scene_index", "ordinal", "mention_type", "aliases", "categories"))).alias("m"))
    types = F.array_distinct(F.filter(F.transform("m", lambda x: F.lower(F.trim(x.mention_type))), lambda t: t.isNotNull() & (t != "")))
    flat = lambda f: F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("m", f)), lambda v: v.isNotNull())))
    return rows.select(
        "novel_hash", "vol_num", "keyword",
        F.get(types, F.lit(0)).alias("entity_type"),
        flat(lambda x: F.coalesce(x.aliases, F.array().cast("array<string>"))).alias("aliases"),
        F.array_sort(F.array_union(flat(lambda x: F.coalesce(x.categories, F.array().cast("array<string>"))), F.filter(types, lambda t, i: i > 0))).alias("categories"),
        F.array_distinct(F.filter(F.transform("m", lambda x: x.scene_index), lambda s: s > 0)).alias("appeared_in"),
        F.size("m").alias("mentions"),
    )
