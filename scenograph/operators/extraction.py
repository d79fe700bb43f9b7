"""Deterministic stand-ins for the language model's readings, and the checks that every reading must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenograph.functions.predicates import TYPES, valid_context, valid_keyword
from scenograph.functions.text import tokens

# Two or more capitalised words in a row.
NAME = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+(?: [A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+)+"


def extract_mentions(scenes: DataFrame) -> DataFrame:
    """(novel_hash, vol_num, scene_index, keyword, context_summary, times): names in a scene's text, the sentence of the first one as context."""
    sentences = scenes.select("novel_hash", "vol_num", "scene_index", F.posexplode(F.split("content", r"(?<=[.!?。！？\n])")).alias("pos", "s"))
    named = sentences.select("novel_hash", "vol_num", "scene_index", "pos", F.trim("s").alias("s"), F.explode(F.regexp_extract_all("s", F.lit(NAME), F.lit(0))).alias("keyword"))
    found = named.groupBy("novel_hash", "vol_num", "scene_index", "keyword").agg(F.min_by("s", "pos").alias("context_summary"), F.count("*").alias("times"))
    return found.where(valid_keyword() & valid_context())


def decide(candidates: DataFrame) -> DataFrame:
    """candidates as retrieval.similar_entities() gives them -> one row a mention that has any: (mention_id, selected_index, entity_uuid).

    The first candidate is taken if the strict rules 1 or 2 found it; else -1 and no entity: a new one is made.
    """
    order = Window.partitionBy("mention_id").orderBy(F.round("score", 9).desc(), "entity_uuid")
    first = candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    match = F.col("rule") <= 2
    return first.select("mention_id", F.when(match, 0).otherwise(-1).alias("selected_index"), F.when(match, F.col("entity_uuid")).alias("entity_uuid"))


def together(before: Column | str, after: Column | str, chars: int = 400, least: float = 0.05) -> Column:
    """Whether two neighbouring pieces belong together: the words at their seam overlap. Pieces without words do."""
    a = F.array_distinct(tokens(F.right(F.col(before) if isinstance(before, str) else before, F.lit(chars))))
    b = F.array_distinct(tokens(F.left(F.col(after) if isinstance(after, str) else after, F.lit(chars))))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)) >= least, F.lit(True))


def slim(entities: DataFrame, fields: str = "struct<keyword:string,aliases:array<string>,categories:array<string>,type:string,description:string>") -> DataFrame:
    """The projection that tools show: values of the JSON copy, or the columns where the copy's are missing or empty."""
    e = entities.withColumn("_j", F.from_json("content", fields))
    text = lambda a, b: F.coalesce(F.nullif(F.col(f"_j.{a}"), F.lit("")), F.col(b), F.lit(""))
    many = lambda c: F.when(F.size(f"_j.{c}") > 0, F.col(f"_j.{c}")).otherwise(F.coalesce(F.col(c), F.array().cast("array<string>")))
    return e.select("entity_uuid", text("keyword", "keyword").alias("keyword"), text("type", "entity_type").alias("type"), text("description", "description").alias("description"), many("aliases").alias("aliases"), many("categories").alias("categories"))


def extended_types(existing: Column | str) -> Column:
    """The types a prompt offers: the base types and those in use, as far as they are base types; each once, base types first."""
    base = F.array(*map(F.lit, TYPES))
    return F.array_intersect(F.array_union(base, F.coalesce(F.col(existing) if isinstance(existing, str) else existing, base)), base)


def shown(df: DataFrame) -> DataFrame:
    """Without columns that are internal: uuid and those that begin with an underscore."""
    return df.select(*[c for c in df.columns if c != "uuid" and not c.startswith("_")])
