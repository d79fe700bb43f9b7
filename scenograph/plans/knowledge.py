"""Queries of the knowledge base: retrieval, catalog, links, merging and scenes, over the current rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenograph.functions import predicates as P
from scenograph.functions import text as X
from scenograph.functions.ids import tenant_hash
from scenograph.functions.vectors import bucket, certainty, cosine
from scenograph.operators import catalog, extraction, links, merge, retrieval, scenes
from scenograph.plans.knowledge_sql import SQL  # noqa: F401
from scenograph.tables import current_rows, read

CHUNKS = ["chunk_uuid", "novel_hash", "vol_num", "scene_index", "title", "content", "token_count", "entity_refs", "written_at"]
ENTITIES = ["entity_uuid", "novel_hash", "vol_num", "entity_type", "keyword", "aliases", "categories", "appeared_in", "chunk_refs", "description", "content", "tainted", "tainted_reason", "written_at"]
CHANGES = "struct<keyword:string,type:string,description:string,major_status_changes:array<struct<scene_index:int,event:string>>>"


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_rows(read(spark, d, "chunks"), "chunk_uuid", list(columns) or CHUNKS)


def entities(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_rows(read(spark, d, "entities"), "entity_uuid", list(columns) or ENTITIES)


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions without copies, with an id of their place."""
    ident = F.concat_ws(":", "novel_hash", "vol_num", "scene_index", "ordinal")
    return read(spark, d, "mentions").withColumn("mention_id", ident).distinct()


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: mentions whose scene number is divisible by 20, the smallest row of each place."""
    m = read(spark, d, "mentions").where("scene_index % 20 = 0").withColumn("mention_id", F.concat_ws(":", "novel_hash", "vol_num", "scene_index", "ordinal"))
    return m.groupBy("mention_id", "novel_hash", "vol_num").agg(F.min(F.struct(F.coalesce("keyword", F.lit("")).alias("keyword"), F.coalesce("mention_type", F.lit("")).alias("mention_type"), F.coalesce("context_summary", F.lit("")).alias("context_summary"))).alias("r")).select("mention_id", "novel_hash", "vol_num", "r.*")


# retrieval


def near_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    queries = rows.where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), "vec")
    return retrieval.near_vectors(queries, rows).select("query_id", "row_id", F.round("certainty", 6).alias("certainty"))


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).where("trim(keyword) <> ''")
    scored = retrieval.bm25(q, entities(spark, d, "novel_hash", "description"), ["novel_hash"], ["entity_uuid"], ["mention_id"], "keyword", "description")
    return scored.select("mention_id", "entity_uuid", F.round("bm25", 6).alias("bm25"))


def searched(spark: SparkSession, d: str) -> DataFrame:
    """Entities with what is searched of them: description and events for vectors, all their text for BM25."""
    e = entities(spark, d, "novel_hash", "vol_num", "entity_type", "keyword", "aliases", "description", "content", "appeared_in", "tainted").withColumn("j", F.from_json("content", CHANGES))
    return e.withColumns({"searched": X.content_text("description", "j.major_status_changes"), "words": F.concat_ws("\n", "description", "content")}).drop("j", "content")


def dual_track_gate(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.similar_entities(questions(spark, d), searched(spark, d))
    return out.select("mention_id", "entity_uuid", F.round("id_sim", 6).alias("id_sim"), F.round("content_sim", 6).alias("content_sim"), "rule", F.round("score", 6).alias("score"))


def gate_rules(spark: SparkSession, d: str) -> DataFrame:
    return dual_track_gate(spark, d).groupBy("rule").agg(F.count("*").alias("candidates"), F.countDistinct("mention_id").alias("mentions"))


def literal_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Mentions and the entities of the same scene: whether their names share a character."""
    m = mentions(spark, d).select("mention_id", "novel_hash", "vol_num", "scene_index", F.col("keyword").alias("m_keyword")).distinct()
    e = entities(spark, d, "novel_hash", "vol_num", "keyword", "appeared_in").select("novel_hash", "vol_num", "entity_uuid", "keyword", F.explode(F.array_distinct("appeared_in")).alias("scene_index"))
    both = m.join(e, ["novel_hash", "vol_num", "scene_index"]).withColumn("shared", retrieval.literal_overlap("m_keyword", "keyword"))
    return both.groupBy("novel_hash", "vol_num").agg(F.count("*").alias("pairs"), F.sum(F.col("shared").cast("int")).alias("overlapping"))


def _search_entities(spark: SparkSession, d: str, how) -> DataFrame:
    q = questions(spark, d).where("trim(keyword) <> ''").select(F.col("mention_id").alias("query_id"), "novel_hash", F.col("keyword").alias("query_text"))
    return how(q, searched(spark, d).where(P.not_tainted()), "entity_uuid", "searched", "words").select("query_id", "entity_uuid", F.round("hybrid", 6).alias("hybrid"))


def universal_search_semantic(spark: SparkSession, d: str) -> DataFrame:
    return _search_entities(spark, d, retrieval.search)


def universal_search_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _search_entities(spark, d, retrieval.ranked_search)


def search_scenes_semantic(spark: SparkSession, d: str) -> DataFrame:
    """Scenes by the vector of their title and BM25 over title and whole content."""
    q = questions(spark, d).where("trim(keyword) <> ''").select(F.col("mention_id").alias("query_id"), "novel_hash", F.col("keyword").alias("query_text"))
    c = chunks(spark, d, "novel_hash", "title", "content").withColumn("words", F.concat_ws("\n", "title", "content"))
    return retrieval.search(q, c, "chunk_uuid", "title", "words").select("query_id", "chunk_uuid", F.round("hybrid", 6).alias("hybrid"))


def universal_search_list(spark: SparkSession, d: str) -> DataFrame:
    """Without a query: each novel's 15 entities with most appearances."""
    e = entities(spark, d, "novel_hash", "keyword", "appeared_in", "tainted").where(P.not_tainted()).withColumn("appearances", catalog.appearances())
    return retrieval.top_k(e, ["novel_hash"], [F.col("appearances").desc(), F.col("entity_uuid")], retrieval.clamp(99)).select("novel_hash", "entity_uuid", "keyword", "appearances")


def search_scenes_list(spark: SparkSession, d: str) -> DataFrame:
    """Without a query: each novel's first 5 scenes in order, with an excerpt."""
    c = chunks(spark, d, "novel_hash", "vol_num", "scene_index", "title", "content")
    return retrieval.top_k(c, ["novel_hash"], [F.col("vol_num"), F.col("scene_index"), F.col("chunk_uuid")], 5).select("novel_hash", "vol_num", "scene_index", "title", F.left("content", F.lit(400)).alias("excerpt"))


def category_contains_any(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d, "novel_hash", "keyword", "categories")
    return e.where(P.any_category("categories", ["guild", "公會", "noble"])).groupBy("novel_hash").agg(F.count("*").alias("entities"))


def scene_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Scenes that mentions name, found by their computed uuid."""
    asked = read(spark, d, "mentions").where("novel_hash is not null and vol_num > 0 and scene_index is not null").select("novel_hash", "vol_num", "scene_index").distinct().withColumn("chunk_uuid", links.chunk_uuid())
    return asked.join(chunks(spark, d, "title").select("chunk_uuid", "title"), "chunk_uuid").select("chunk_uuid", "novel_hash", "vol_num", "scene_index", "title")


def no_future_leak(spark: SparkSession, d: str) -> DataFrame:
    """Entities a reader of each volume may see."""
    e = entities(spark, d, "novel_hash", "vol_num", "tainted").where(P.not_tainted())
    per = e.groupBy("novel_hash", "vol_num").agg(F.count("*").alias("n"))
    return per.select("novel_hash", "vol_num", F.sum("n").over(Window.partitionBy("novel_hash").orderBy("vol_num").rangeBetween(Window.unboundedPreceding, 0)).alias("visible"))


# catalog


def list_novels(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.list_novels(chunks(spark, d, "novel_hash", "vol_num"), entities(spark, d, "novel_hash"), read(spark, d, "novels"))
    return out.withColumn("vols", F.array_join(F.transform("vols", lambda v: F.concat_ws(":", v.vol_num, v.scenes)), ","))


def novel_profile_volumes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.volumes(chunks(spark, d, "novel_hash", "vol_num")).select("novel_hash", "vol_num", "scenes")


def novel_profile_types(spark: SparkSession, d: str) -> DataFrame:
    return catalog.profile_types(entities(spark, d, "novel_hash", "entity_type", "tainted"))


def novel_profile_top(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d, "novel_hash", "keyword", "appeared_in", "tainted").where(P.not_tainted()).withColumn("appearances", catalog.appearances())
    return retrieval.top_k(e, ["novel_hash"], [F.col("appearances").desc(), F.col("entity_uuid")], 8).select("novel_hash", "entity_uuid", "keyword", "appearances")


def entity_types(spark: SparkSession, d: str) -> DataFrame:
    return catalog.entity_types(entities(spark, d, "entity_type"))


def max_volume(spark: SparkSession, d: str) -> DataFrame:
    return catalog.max_volume(chunks(spark, d, "novel_hash", "vol_num"))


# links and writes


def find_entity_scenes(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d, "novel_hash", "vol_num", "appeared_in", "tainted").where(P.not_tainted())
    return links.previews(e, chunks(spark, d, "novel_hash", "vol_num", "scene_index", "title"))


def chunk_uuid5(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").select("novel_hash", "vol_num", "scene_index").distinct().withColumn("uuid", links.chunk_uuid())


def chunk_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "novel_hash", "vol_num", "scene_index", "token_count", "entity_refs", "written_at")
    return c.groupBy("novel_hash", "vol_num").agg(F.count("*").alias("scenes"), F.sum("token_count").alias("tokens"), F.max("written_at").alias("last_written"))


def rechunk_resets_refs(spark: SparkSession, d: str) -> DataFrame:
    """First volumes ingested again: their references are emptied, other volumes keep theirs."""
    now = chunks(spark, d, "novel_hash", "vol_num", "scene_index", "entity_refs", "written_at")
    after = links.upsert(now, now.where("vol_num = 1"), "chunk_uuid", "entity_refs")
    return after.groupBy("novel_hash", "vol_num").agg(F.count("*").alias("scenes"), F.sum(F.greatest(F.coalesce(F.size("entity_refs"), F.lit(0)), F.lit(0))).alias("refs"))


def entity_refs_backfill(spark: SparkSession, d: str) -> DataFrame:
    out = links.backfill(chunks(spark, d, "novel_hash"), entities(spark, d, "chunk_refs"))
    return out.select("chunk_uuid", F.array_join("entity_refs", ",").alias("entity_refs"))


def chunk_to_entities(spark: SparkSession, d: str) -> DataFrame:
    return links.to_entities(chunks(spark, d, "entity_refs"), entities(spark, d, "keyword"))


def entity_to_chunks(spark: SparkSession, d: str) -> DataFrame:
    return links.to_chunks(entities(spark, d, "chunk_refs"), chunks(spark, d, "title"))


def link_consistency(spark: SparkSession, d: str) -> DataFrame:
    return links.consistency(chunks(spark, d, "entity_refs"), entities(spark, d, "chunk_refs"))


def volume_delete(spark: SparkSession, d: str) -> DataFrame:
    """Both layers without the volumes of French novels."""
    c, e = chunks(spark, d, "novel_hash", "vol_num"), entities(spark, d, "novel_hash", "vol_num")
    doomed = c.join(read(spark, d, "novels").where("lang = 'fr'").select("novel_hash"), "novel_hash", "left_semi")
    left = links.delete_volumes(c, doomed).select(F.lit("chunks").alias("layer"), "novel_hash").unionByName(links.delete_volumes(e, doomed).select(F.lit("entities").alias("layer"), "novel_hash"))
    return left.groupBy("layer", "novel_hash").agg(F.count("*").alias("left_rows"))


def orphan_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Backups written under a type that is no longer the entity's."""
    files = read(spark, d, "entities").select("entity_uuid", F.col("entity_type").alias("folder_type")).distinct()
    return links.misfiled(files, entities(spark, d, "entity_type"))


# text


def structural_split(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", X.line_ends("text").alias("text"))
    return docs.select("doc_id", F.explode(X.structural_split("text")).alias("part")).groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum(F.length("part")).alias("chars"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(F.filter(X.sentence_split("text"), lambda s: s.rlike(r"(?U)\S"))).alias("sentences"))


def volume_number(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "novels").select("novel_hash", X.number_in("folder").alias("number"))


def truncate_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "content").where("content is not null")
    cut = c.select("chunk_uuid", F.length("content").alias("chars"), X.truncate_tokens("content", 100).alias("cut"))
    return cut.select("chunk_uuid", "chars", F.length("cut").alias("kept"), F.md5("cut").alias("digest"))


def identity_text(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d, "keyword", "aliases").select("entity_uuid", X.identity_text("keyword", "aliases").alias("identity"))


def content_text(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d, "description", "content").withColumn("j", F.from_json("content", CHANGES))
    return e.select("entity_uuid", F.md5(X.content_text("description", "j.major_status_changes")).alias("digest"))


def json_blob_agrees(spark: SparkSession, d: str) -> DataFrame:
    """Whether the JSON copy of an entity repeats its columns."""
    e = entities(spark, d, "keyword", "description", "content").withColumn("j", F.from_json(X.json_narrow("content"), CHANGES))
    return e.select("entity_uuid", F.col("keyword").eqNullSafe(F.col("j.keyword")).alias("keyword_same"), F.col("description").eqNullSafe(F.col("j.description")).alias("description_same"))


def mention_filter(spark: SparkSession, d: str) -> DataFrame:
    """Mentions per type by what the filters say of them."""
    m = read(spark, d, "mentions").select(F.coalesce(F.lower(F.trim("mention_type")), F.lit("concept")).alias("mention_type"), P.valid_keyword().alias("named"), P.valid_context().alias("told"))
    return m.groupBy("mention_type", "named", "told").agg(F.count("*").alias("mentions"))


def final_guard(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d, "keyword", "description").where(~P.final_guard()).select("entity_uuid")


def token_buckets(spark: SparkSession, d: str) -> DataFrame:
    """How a corpus fills the embedder's buckets."""
    t = entities(spark, d, "description").select(F.explode(X.tokens("description")).alias("t"))
    return t.groupBy(bucket("t").alias("bucket")).agg(F.count("*").alias("tokens"), F.countDistinct("t").alias("distinct_tokens"))


# merging


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return merge.versions(read(spark, d, "entities").select("entity_uuid", "written_at", "keyword", "aliases", "entity_type", "categories", "content"))


def merge_canonical_name(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d).where("version > 1")
    return v.select("entity_uuid", "version", merge.canonical_name("old_keyword", "keyword").alias("name"))


def merge_alias_union(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d).where("version > 1")
    return v.select("entity_uuid", "version", F.array_join(merge.merged_aliases("old_aliases", "aliases", "old_keyword", "keyword"), "|").alias("aliases"))


def merge_type_lock(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d).where("version > 1")
    return v.select("entity_uuid", "version", merge.locked_type("old_entity_type", "entity_type").alias("entity_type"), F.array_join(merge.categories_after_lock("categories", "old_entity_type", "entity_type"), "|").alias("categories"))


def merge_status_changes(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d).where("version > 1").withColumn("o", F.from_json("old_content", CHANGES)).withColumn("n", F.from_json("content", CHANGES))
    merged = merge.merged_changes("o.major_status_changes", "n.major_status_changes")
    return v.select("entity_uuid", "version", F.array_join(F.transform(merged, lambda c: F.concat_ws(":", c.scene_index, c.event)), "|").alias("changes"))


def taint_detect(spark: SparkSession, d: str) -> DataFrame:
    bad, reason = merge.taint(F.col("aliases"), F.col("description"))
    return entities(spark, d, "aliases", "description", "tainted").select("entity_uuid", bad.alias("found"), F.coalesce("tainted", F.lit(False)).alias("marked"), reason.alias("reason")).where("found or marked")


def taint_versions(spark: SparkSession, d: str) -> DataFrame:
    """Each written version of an entity under all three rules: aliases, description, and a merge under another name whose vector lies apart."""
    v = merge.name_cosines(merge.versions(read(spark, d, "entities").where("entity_uuid is not null")))
    bad, reason = merge.taint(F.col("aliases"), F.col("description"), F.col("cosine"), F.col("renamed"))
    return v.select("entity_uuid", "version", bad.alias("found"), reason.alias("reason")).where("found")


def mention_fold(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d).where(P.valid_keyword())
    out = merge.fold(m)
    return out.withColumns({c: F.array_join(c, "|") for c in ("aliases", "categories")}).withColumn("appeared_in", F.array_join(F.col("appeared_in").cast("array<string>"), "|"))


def label_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine and certainty of every vector to the next of its label, by array expressions."""
    w = Window.partitionBy("label").orderBy("vec_id")
    v = read(spark, d, "embeddings").withColumn("after", F.lead("embedding").over(w)).where("after is not null")
    return v.select("vec_id", F.round(cosine("embedding", "after"), 6).alias("cosine"), F.round(certainty(cosine("embedding", "after")), 6).alias("certainty"))


# scenes


def boundary_fold_cap(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of each volume joined while they stay within 4,096 tokens."""
    c = chunks(spark, d, "novel_hash", "vol_num", "scene_index", "token_count").withColumn("t", F.coalesce("token_count", F.lit(0))).withColumn("j", F.lit(True))
    return scenes.fold_pieces(c, ["novel_hash", "vol_num"], ["scene_index"], "t", "j", floor=0)


def fragment_merge(spark: SparkSession, d: str) -> DataFrame:
    """No scene joins another by itself, only those under 128 tokens."""
    c = chunks(spark, d, "novel_hash", "vol_num", "scene_index", "token_count").withColumn("t", F.coalesce("token_count", F.lit(0))).withColumn("j", F.lit(False))
    return scenes.fold_pieces(c, ["novel_hash", "vol_num"], ["scene_index"], "t", "j")


def semantic_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut by structure, then by meaning; pieces joined give the sections."""
    docs = read(spark, d, "documents").where("text is not null").dropDuplicates(["doc_id"]).select("doc_id", X.line_ends("text").alias("text"))
    return scenes.split_volumes(docs, ["doc_id"], "text").groupBy("doc_id").agg(F.countDistinct("section").alias("sections"), F.count("*").alias("pieces"), F.sum(F.length("piece_text")).alias("chars"), F.max("tokens").alias("largest"))


def boundary_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Of each pair of neighbouring scenes, whether they belong together by the words at their seam."""
    w = Window.partitionBy("novel_hash", "vol_num").orderBy("scene_index")
    c = chunks(spark, d, "novel_hash", "vol_num", "scene_index", "content").withColumn("before", F.lag(F.coalesce("content", F.lit(""))).over(w)).where("before is not null")
    return c.select("chunk_uuid", extraction.together("before", F.coalesce("content", F.lit(""))).alias("together"))


def extract_mentions(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "novel_hash", "vol_num", "scene_index", "content").where("content is not null")
    return extraction.extract_mentions(c).groupBy("novel_hash", "vol_num", "keyword").agg(F.count("*").alias("scenes"), F.sum("times").alias("times"))


def merge_decisions(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.similar_entities(questions(spark, d), searched(spark, d))
    return extraction.decide(out)


def entity_slim(spark: SparkSession, d: str) -> DataFrame:
    out = extraction.slim(entities(spark, d))
    return out.withColumns({c: F.array_join(c, "|") for c in ("aliases", "categories")}).withColumn("description", F.md5("description"))


def tenants(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "novels").select("folder", tenant_hash("folder").alias("hash"))


def volume_prune(spark: SparkSession, d: str) -> DataFrame:
    """Scenes per novel of volumes 1 to 4."""
    return chunks(spark, d, "novel_hash", "vol_num").where("vol_num between 1 and 4").groupBy("novel_hash").agg(F.count("*").alias("scenes"))


QUERIES = {
    f.__name__: f
    for f in (
        near_vector_topk, bm25_scores, dual_track_gate, gate_rules, literal_overlap, universal_search_semantic, universal_search_ranked, search_scenes_semantic,
        universal_search_list, search_scenes_list, category_contains_any, scene_point_lookup, no_future_leak, list_novels, novel_profile_volumes, novel_profile_types,
        novel_profile_top, entity_types, max_volume, find_entity_scenes, chunk_uuid5, chunk_upsert_latest, rechunk_resets_refs, entity_refs_backfill, chunk_to_entities,
        entity_to_chunks, link_consistency, volume_delete, orphan_cleanup, structural_split, sentence_split, volume_number, truncate_tokens, identity_text, content_text,
        json_blob_agrees, mention_filter, final_guard, token_buckets, merge_canonical_name, merge_alias_union, merge_type_lock, merge_status_changes, taint_detect, taint_versions,
        mention_fold, label_cosine, boundary_fold_cap, fragment_merge, semantic_breaks, tenants, volume_prune, boundary_decisions,
        extract_mentions, merge_decisions, entity_slim,
    )
}
