"""Queries of the operators on training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenograph.llm import leakage, lookalikes, names, packing, setpairs, subjects, terms
from scenograph.tables import current_rows, read


def _named(spark: SparkSession, d: str) -> DataFrame:
    rows = current_rows(read(spark, d, "entities"), "entity_uuid", ["novel_hash", "vol_num", "entity_type", "keyword", "aliases"])
    return rows.select(F.col("entity_uuid").alias("id"), F.concat_ws("|", "novel_hash", "vol_num").alias("grp"), F.col("entity_type").alias("type"), "keyword", "aliases")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_pairs(_named(spark, d)).select(F.col("a").alias("entity_uuid_a"), F.col("b").alias("entity_uuid_b"))


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each row that names a person or organisation, with the smallest uuid of the rows that name the same."""
    linked = names.linked_rows(_named(spark, d))
    least = linked.groupBy("entity").agg(F.min("id").alias("same_as"))
    return linked.join(least, "entity").select(F.col("id").alias("entity_uuid"), "same_as")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct plain value of categories and entity_type with its frequency and mark."""
    rows = current_rows(read(spark, d, "entities"), "entity_uuid", ["categories", "entity_type"])
    return terms.term_frequencies(rows, {"categories": "categories", "entity_type": "entity_type"})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_counts(spark, d).where("mark is not null").select("field", "term", "mark")


def _texts(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str, str]]:
    return [("chunks", read(spark, d, "chunks"), "chunk_uuid", "content"), ("entities", read(spark, d, "entities"), "entity_uuid", "keyword")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = [lookalikes.rows_with_cases(df, key, text).select(F.lit(name).alias("src_table"), F.col(key).alias("row_uuid")) for name, df, key, text in _texts(spark, d)]
    return a.unionByName(b)


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every current text that is not in it already."""
    a, b = [lookalikes.changed_forms(df, key, text).select(F.lit(name).alias("src_table"), F.col(key).alias("row_uuid"), "form") for name, df, key, text in _texts(spark, d)]
    return a.unionByName(b)


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(read(spark, d, "entities"), "entity_uuid", ["aliases", "categories"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = setpairs.similar_rows(_sets(spark, d), "entity_uuid", ["aliases", "categories"])
    return pairs.select(F.col("key_a").alias("entity_uuid_a"), F.col("key_b").alias("entity_uuid_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's class of equal sets and the number of classes similar to it."""
    return setpairs.linked_classes(_sets(spark, d), "entity_uuid", ["aliases", "categories"]).withColumnRenamed("key", "entity_uuid")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in containers of 4,096 tokens."""
    return packing.packed_documents(read(spark, d, "documents")).withColumnRenamed("item", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Number of containers by unused tokens, the measure of the packing."""
    return packing.fill(p6_packed(spark, d)).groupBy("unused").agg(F.count("*").alias("containers"), F.sum("items").alias("items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p7_edits(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a run of a passage with at most one edit in it."""
    return leakage.leaked(read(spark, d, "documents"), read(spark, d, "eval_items"), rule=leakage.Rule(edits=1), exact=False)


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: its task and the number of documents that contain it."""
    per_item = p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))
    return per_item.join(read(spark, d, "eval_items").select("item_id", "lang", "task"), "item_id")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(read(spark, d, "documents"), read(spark, d, "subjects"), read(spark, d, "subject_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each subject, the composition of the corpus."""
    return _subjects(spark, d).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities, "p8_found": p8_found, "p8_composition": p8_composition, "p4_found": p4_found, "p4_classes": p4_classes, "p6_packed": p6_packed, "p6_fill": p6_fill, "p7_found": p7_found, "p7_edits": p7_edits, "p7_items": p7_items, "p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p3_forms": p3_forms}

SQL: dict[str, str] = {}
