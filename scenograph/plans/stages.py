"""Queries of whole stages: tools with their envelopes, validators, folds by decisions, summaries with stored state, backups, and the question loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenograph.functions import predicates as P
from scenograph.functions import text as X
from scenograph.config import Settings
from scenograph.operators import catalog, extraction, links, merge, process, references, retrieval, scenes, summary
from scenograph.plans.knowledge import chunks, entities, questions, searched
from scenograph.plans.knowledge_sql import ASKED, CUR, SEARCHED, _bm25, _fold_by, _list, _near, _scaled, _seams, _SHOWN, _VERSIONS, _vectors
from scenograph.session import scratch_path
from scenograph.sources import keyvalue
from scenograph.tables import read

STATE = "novel_hash string, vol_num int, updated_scenes array<int>, outline string, compacted boolean"
PROMPT = "Entity $keyword of type ${mention_type} in scene $scene_index costs $$0."


# text and names


def embed_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """What the embedder is given: entities' identity texts as documents, questions as queries."""
    e = entities(spark, d, "keyword", "aliases").select(F.col("entity_uuid").alias("id"), X.document_text(X.identity_text("keyword", "aliases")).alias("text"))
    return e.unionByName(questions(spark, d).select(F.col("mention_id").alias("id"), X.query_text("keyword").alias("text")))


def reasoning_split(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions told as a thought before the keyword: what is thought, and what is said."""
    e = entities(spark, d, "keyword", "description").withColumn("t", F.concat(F.lit("so <think> "), F.coalesce("description", F.lit("")), F.lit("\n</think>\n "), F.coalesce("keyword", F.lit(""))))
    thought, said = X.reasoning("t")
    return e.select("entity_uuid", F.md5(thought).alias("thought"), said.alias("said"))


def tool_calls_stripped(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d, "keyword", "description").withColumn("t", F.concat(F.lit("<tool_call>"), F.coalesce("keyword", F.lit("")), F.lit("\n</tool_call> "), F.coalesce("description", F.lit("")), F.lit("<|tool_call>x<tool_call|>")))
    return e.select("entity_uuid", F.md5(X.strip_tool_calls("t")).alias("text"))


def lenient_flags(spark: SparkSession, d: str) -> DataFrame:
    """The flag `tainted` of an entity's JSON copy, read leniently."""
    return entities(spark, d, "content").select("entity_uuid", X.lenient_flag("content", "tainted").alias("flag"))


def rendered_prompts(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "mentions").select("novel_hash", "vol_num", "scene_index", "ordinal", X.rendered(PROMPT, keyword=F.col("keyword"), mention_type=F.col("mention_type"), scene_index=F.col("scene_index")).alias("prompt"))
    return m.distinct()


def log_names(spark: SparkSession, d: str) -> DataFrame:
    """The log's name of each written version: the first of an entity is new, later ones are merges."""
    v = merge.versions(read(spark, d, "entities").where("entity_uuid is not null")).withColumn("scene", F.coalesce(F.get("appeared_in", F.lit(0)), F.lit(0)))
    return v.select("entity_uuid", "version", X.log_name(F.col("scene"), F.coalesce("keyword", F.lit("")), F.when(F.col("version") > 1, F.col("entity_uuid"))).alias("file"))


# filters and validators


def scoped_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of one type up to the second volume, per novel and volume."""
    e = entities(spark, d, "novel_hash", "vol_num", "entity_type").where(P.scope(max_vol=2, kind="character"))
    return e.groupBy("novel_hash", "vol_num").agg(F.count("*").alias("entities"))


def validated_merges(spark: SparkSession, d: str) -> DataFrame:
    """Every written version under the validators of its step: of a new entity, or of a merge with the one version before."""
    v = merge.versions(read(spark, d, "entities").where("entity_uuid is not null")).withColumn("description", F.get_json_object("content", "$.description"))
    v = v.withColumns({"chosen": F.when(F.col("version") > 1, 0).otherwise(-1), "candidates": F.when(F.col("version") > 1, 1).otherwise(0), "asked": F.coalesce("old_keyword", "keyword")})
    return v.select("entity_uuid", "version", P.create_valid("asked", "keyword", "description").alias("create_valid"), P.merge_valid("chosen", "candidates", "asked", "keyword", "description").alias("merge_valid"))


def extended_types(spark: SparkSession, d: str) -> DataFrame:
    """The types offered for each novel: base types, and those in use that are base types."""
    e = entities(spark, d, "novel_hash", "entity_type").groupBy("novel_hash").agg(F.collect_set(F.lower(F.trim("entity_type"))).alias("used"))
    return e.select("novel_hash", F.array_join(extraction.extended_types("used"), ",").alias("types"))


# storage


def kv_keys(spark: SparkSession, d: str) -> DataFrame:
    """Scenes stored under novel and volume: the namespaces and, in each, the keys in order."""
    base = scratch_path(spark, "keys")
    c = chunks(spark, d, "novel_hash", "vol_num", "scene_index")
    keyvalue.put(c.select("novel_hash", "vol_num", "scene_index"), base, ["novel_hash", "vol_num"])
    keys = keyvalue.list_keys(spark, base, c.select("novel_hash", "vol_num", "scene_index").schema, ["novel_hash", "vol_num"])
    return keys.groupBy("novel_hash").agg(F.array_join(F.array_sort(F.collect_list("vol_num")), ",").alias("keys"))


def history_summary(spark: SparkSession, d: str) -> DataFrame:
    """The last three scene titles of each novel."""
    c = chunks(spark, d, "novel_hash", "vol_num", "scene_index", "title")
    return keyvalue.history(c, ["novel_hash"], [F.col("vol_num"), F.col("scene_index"), F.col("chunk_uuid")], "title", 3)


def entity_backups(spark: SparkSession, d: str) -> DataFrame:
    """Entities stored by novel, volume and type; those whose type changed leave the old place, as a cleaning of misfiled rows finds them."""
    base = scratch_path(spark, "world")
    rows = read(spark, d, "entities").where("entity_uuid is not null").select("novel_hash", "vol_num", F.coalesce("entity_type", F.lit("none")).alias("entity_type"), "entity_uuid", "keyword").distinct()
    keyvalue.put(rows, base, ["novel_hash", "vol_num", "entity_type"])
    stored = keyvalue.get(spark, base, rows.schema)
    wrong = links.misfiled(stored.select("entity_uuid", F.col("entity_type").alias("folder_type")).distinct(), entities(spark, d, "entity_type").withColumn("entity_type", F.coalesce("entity_type", F.lit("none"))))
    kept = stored.join(wrong.select("entity_uuid", F.col("folder_type").alias("entity_type")), ["entity_uuid", "entity_type"], "left_anti")
    return kept.groupBy("novel_hash", "vol_num", "entity_type").agg(F.countDistinct("entity_uuid").alias("entities"))


def step_logs(spark: SparkSession, d: str) -> DataFrame:
    """Logs of two runs in one place, new entities first and merges after them: records per novel and kind."""
    base = scratch_path(spark, "logs")
    v = merge.versions(read(spark, d, "entities").where("entity_uuid is not null")).select("novel_hash", "entity_uuid", "version", F.when(F.col("version") > 1, "merge").otherwise("new").alias("step"))
    keyvalue.append_log(v.where("version = 1"), base)
    keyvalue.append_log(v.where("version > 1"), base)
    return spark.read.schema("novel_hash string, step string").json(base).groupBy("novel_hash", "step").agg(F.count("*").alias("records"))


def cleaned_states(spark: SparkSession, d: str) -> DataFrame:
    """Summary states left, and begun anew, after those of the first volumes are cleaned."""
    now = chunks(spark, d, "novel_hash", "vol_num", "scene_index", "content")
    state = summary.resume(spark.createDataFrame([], STATE), now)
    left = links.delete_volumes(state, now.where("vol_num = 1"))
    again = summary.resume(left, now.where("scene_index % 2 = 0"))
    return again.select("novel_hash", "vol_num", F.size("updated_scenes").alias("scenes"))


def augmented_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with the entities found in them: how many, and their keywords in order."""
    found = links.to_entities(chunks(spark, d, "entity_refs"), entities(spark, d, "keyword"))
    names = found.groupBy("chunk_uuid").agg(F.count("*").alias("entities"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("keyword", F.lit("")).alias("k")))), lambda x: x.k), "|").alias("keywords"))
    return chunks(spark, d, "novel_hash").select("chunk_uuid").join(names, "chunk_uuid", "left").select("chunk_uuid", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("keywords", F.lit("")).alias("keywords"))


def scene_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Appearances of entities after each mention of their keyword in their volume is added, in order of scenes."""
    e = entities(spark, d, "novel_hash", "vol_num", "keyword", "appeared_in").where("keyword is not null")
    m = read(spark, d, "mentions").where("keyword is not null").groupBy("novel_hash", "vol_num", "keyword").agg(F.array_sort(F.collect_set("scene_index")).alias("more"))
    both = e.join(m, ["novel_hash", "vol_num", "keyword"])
    had = F.coalesce("appeared_in", F.array().cast("array<int>"))
    return both.select("entity_uuid", F.array_join(F.array_union(had, F.filter("more", lambda s: s > 0)).cast("array<string>"), ",").alias("appeared_in"))


# scenes and summaries


def decided_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes joined where the words at their seam say so and the cap allows it; fragments join a neighbour."""
    w = Window.partitionBy("novel_hash", "vol_num").orderBy("scene_index")
    c = chunks(spark, d, "novel_hash", "vol_num", "scene_index", "token_count", "content").withColumn("after", F.coalesce("content", F.lit("")))
    c = c.withColumn("before", F.lag("after").over(w)).withColumn("j", F.when(F.col("before").isNotNull(), extraction.together("before", "after")).otherwise(True))
    return scenes.fold_pieces(c.withColumn("t", F.coalesce("token_count", F.lit(0))), ["novel_hash", "vol_num"], ["scene_index"], "t", "j")


def oversized_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Folded scenes over the hard limit, which the ingest refuses."""
    return decided_scenes(spark, d).where("tokens > 8192").select("novel_hash", "vol_num", "scene_index", "tokens")


def resumed_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over the volumes with the state stored between them: first the scenes that were first written in 2024's first half of the log, then all."""
    base = scratch_path(spark, "summary")
    log = read(spark, d, "chunks").where("chunk_uuid is not null")
    middle = log.agg(F.percentile_approx("written_at", 0.5, 100_000).alias("middle"))  # one row
    early = log.groupBy("chunk_uuid").agg(F.min("written_at").alias("first")).crossJoin(F.broadcast(middle)).where("first < middle").select("chunk_uuid")
    now = chunks(spark, d, "novel_hash", "vol_num", "scene_index", "content")
    empty = spark.createDataFrame([], STATE)
    state = summary.compacted(summary.resume(empty, now.join(early, "chunk_uuid", "left_semi")), now)
    keyvalue.put(state, base, ["novel_hash", "vol_num"])
    stored = keyvalue.get(spark, base, empty.schema).select(*empty.columns)
    out = summary.compacted(summary.resume(stored, now), now)
    return out.select("novel_hash", "vol_num", F.size("updated_scenes").alias("scenes"), "compacted", F.md5("outline").alias("outline"))


# tools: a question may be empty, then they list


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select(F.col("mention_id").alias("query_id"), "novel_hash", "vol_num", F.trim("keyword").alias("query_text"))


def _dispatched(asked: DataFrame, docs: DataFrame, key: str, text: str, words: str, listed: DataFrame, limit: int) -> DataFrame:
    """(query_id, place, key): the search's best for questions with text, else the list's first of the novel."""
    found = retrieval.search(asked.where("query_text <> ''"), docs, key, text, words, limit)
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("hybrid", 9).desc(), key)))
    return found.select("query_id", "place", key).unionByName(asked.where("query_text = ''").join(listed, "novel_hash").select("query_id", "place", key))


def _envelope(asked: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """(query_id, hits, items): every question has one, those without hits an empty list."""
    per = items.groupBy("query_id").agg(F.count("*").alias("hits"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce(item, F.lit("")).alias("i")))), lambda x: x.i), "; ").alias("items"))
    return asked.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("items", F.lit("")).alias("items"))


def find_entity_scenes_tool(spark: SparkSession, d: str) -> DataFrame:
    """Entities for each question, with how often and in which of their first eight scenes they appear."""
    e = searched(spark, d).where(P.not_tainted()).withColumn("seen", catalog.appearances())
    listed = retrieval.top_k(e, ["novel_hash"], [F.col("seen").desc(), F.col("entity_uuid")], 5).withColumn("place", F.row_number().over(Window.partitionBy("novel_hash").orderBy(F.col("seen").desc(), "entity_uuid")))
    hits = _dispatched(asked := _asked(spark, d), e, "entity_uuid", "searched", "words", listed.select("novel_hash", "place", "entity_uuid"), 5)
    scenes_ = links.previews(e, chunks(spark, d, "novel_hash", "vol_num", "scene_index", "title")).groupBy("entity_uuid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "scene_index"))), lambda x: x.scene_index.cast("string")), ",").alias("scenes"))
    shown = hits.join(e.select("entity_uuid", "keyword", "seen"), "entity_uuid").join(scenes_, "entity_uuid", "left")
    return _envelope(asked, shown.withColumn("item", F.concat(F.coalesce("keyword", F.lit("")), F.lit(" x"), F.col("seen").cast("string"), F.lit(": "), F.coalesce("scenes", F.lit("")))), "item")


def search_scenes_tool(spark: SparkSession, d: str) -> DataFrame:
    """Scenes for each question by title and content, with title and the length of an excerpt of 400 characters."""
    c = chunks(spark, d, "novel_hash", "vol_num", "scene_index", "title", "content").withColumn("words", F.concat_ws("\n", "title", "content"))
    order = [F.col("vol_num"), F.col("scene_index"), F.col("chunk_uuid")]
    listed = retrieval.top_k(c, ["novel_hash"], order, 5).withColumn("place", F.row_number().over(Window.partitionBy("novel_hash").orderBy(*order)))
    hits = _dispatched(asked := _asked(spark, d), c, "chunk_uuid", "title", "words", listed.select("novel_hash", "place", "chunk_uuid"), 5)
    shown = hits.join(c.select("chunk_uuid", "title", F.length(F.left(F.coalesce("content", F.lit("")), F.lit(400))).alias("n")), "chunk_uuid")
    return _envelope(asked, shown.withColumn("item", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("n").cast("string"))), "item")


def get_scene_content_tool(spark: SparkSession, d: str) -> DataFrame:
    """The whole scene of each question and the one after it, found or not."""
    asked = read(spark, d, "mentions").where("scene_index % 20 = 0").select("novel_hash", "vol_num", F.explode(F.array("scene_index", F.col("scene_index") + 1)).alias("scene_index")).distinct()
    there = chunks(spark, d, "novel_hash", "vol_num", "scene_index", "content", "token_count")
    out = asked.join(there, ["novel_hash", "vol_num", "scene_index"], "left")
    return out.select("novel_hash", "vol_num", "scene_index", F.col("chunk_uuid").isNotNull().alias("found"), "token_count", F.md5("content").alias("content"))


def get_vol_summary_tool(spark: SparkSession, d: str) -> DataFrame:
    """The summary of each volume that is mentioned and of the one after its last, or why there is none."""
    asked = read(spark, d, "mentions").groupBy("novel_hash").agg(F.max("vol_num").alias("last")).select("novel_hash", F.explode(F.sequence(F.lit(1), F.col("last") + 1)).alias("vol_num"))
    state = summary.resume(spark.createDataFrame([], STATE), chunks(spark, d, "novel_hash", "vol_num", "scene_index", "content"))
    out = asked.join(state, ["novel_hash", "vol_num"], "left")
    found = F.col("updated_scenes").isNotNull()
    return out.select("novel_hash", "vol_num", found.alias("found"), F.when(~found, "summary_not_generated").alias("reason"), F.md5("outline").alias("summary"))


# the entity flow


def process_steps(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each mention when entities are found by any of their names, names that earlier mentions added included."""
    steps = process.resolution_steps(read(spark, d, "mentions"), process.ByName, Settings.of(spark))
    return steps.select("mention_id", "entity", "merged", "tainted")


def process_gated_steps(spark: SparkSession, d: str) -> DataFrame:
    """The same with candidates by vectors and the gate."""
    return process.resolution_steps(read(spark, d, "mentions"), process.ByGate, Settings.of(spark))


def process_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entities that the gated flow leaves."""
    e = process.resolved_entities(read(spark, d, "mentions"), process.ByGate, Settings.of(spark))
    return e.select("novel_hash", "entity", "entity_type", "keyword", F.array_join("aliases", "|").alias("aliases"), F.array_join("categories", "|").alias("categories"), F.size("appeared_in").alias("scenes"), F.size("chunk_refs").alias("chunks"), "tainted", "reason", "mentions")


# references with partly null keys


def _volume_refs(spark: SparkSession, d: str, match: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "novel_hash", "vol_num")
    return references.orphans(docs, chunks(spark, d, "novel_hash", "vol_num"), ["novel_hash", "vol_num"], match).select("doc_id", "novel_hash", "vol_num", "reason")


def p5_documents_simple(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose novel and volume have no scene; a key with a null refers to nothing."""
    return _volume_refs(spark, d, "simple")


def p5_documents_partial(spark: SparkSession, d: str) -> DataFrame:
    """The same; what is given of a key must agree with some scene."""
    return _volume_refs(spark, d, "partial")


def p5_documents_full(spark: SparkSession, d: str) -> DataFrame:
    """The same; a key is wholly null or wholly given."""
    return _volume_refs(spark, d, "full")


QUERIES = {
    f.__name__: f
    for f in (
        embed_prefixes, reasoning_split, tool_calls_stripped, lenient_flags, rendered_prompts, log_names, scoped_entities, validated_merges, extended_types, kv_keys,
        history_summary, entity_backups, step_logs, cleaned_states, augmented_scenes, scene_upkeep, decided_scenes, oversized_scenes, resumed_summaries, find_entity_scenes_tool,
        search_scenes_tool, get_scene_content_tool, get_vol_summary_tool, process_steps, process_gated_steps, process_entities, p5_documents_simple, p5_documents_partial, p5_documents_full,
    )
}

_ID = "concat(coalesce(keyword, ''), case when len(list_filter(coalesce(aliases, []), lambda a: a is not null)) > 0 then ' | ' || array_to_string(list_filter(aliases, lambda a: a is not null), ', ') else '' end)"
_EDGES = r"'^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$'"
_WRITTEN = """with v as (select *, row_number() over w as version, lag(keyword) over w as old_keyword from (select distinct on (entity_uuid, written_at) * from entities where entity_uuid is not null)
  window w as (partition by entity_uuid order by written_at))"""
_NONE = f"upper(trim(coalesce({{0}}, ''))) in ({_list(P.NO_CONTEXT)})"
_NAMELESS = f"upper(trim(coalesce({{0}}, ''))) in ({_list(P.NO_KEYWORD)})"
_LINE_ = r"trim(regexp_replace(left(content, 50), '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ')"
_TOOL = ", asked_ as (select mention_id, novel_hash, vol_num, trim(keyword) as keyword from asked), q as (select * from asked_ where keyword <> '')"


def _dispatch(docs: str, key: str, text: str, words: str, listed: str) -> str:
    return (
        CUR + ASKED + _TOOL + f", docs as ({docs})" + _vectors("qv", "q", "mention_id", "keyword") + _vectors("dv", "docs", key, text) + _near("near_", "qv", "dv", key) + _bm25("bm", "q", "docs", key, "keyword", words)
        + f""", v as (select mention_id, {key}, {_scaled('cosine')} as s from near_), k as (select mention_id, {key}, {_scaled('bm25')} as s from bm),
f as (select coalesce(v.mention_id, k.mention_id) as mention_id, coalesce(v.{key}, k.{key}) as {key}, 0.5 * coalesce(v.s, 0) + 0.5 * coalesce(k.s, 0) as hybrid from v full join k on v.mention_id = k.mention_id and v.{key} = k.{key}),
hits as (select mention_id, {key}, row_number() over (partition by mention_id order by round(hybrid, 9) desc, {key}) as place from f qualify place <= 5
  union all select mention_id, {key}, place from asked_ join (select novel_hash, {key}, row_number() over (partition by novel_hash order by {listed}) as place from docs qualify place <= 5) using (novel_hash) where keyword = '')"""
    )


def _volume_sql(given: str) -> str:
    return CUR + ", t as (select distinct novel_hash, vol_num from chunks_), r as (select doc_id, novel_hash, vol_num from documents) " + given


_WHOLE = "select r.*, 'missing' as reason from r anti join t using (novel_hash, vol_num) where novel_hash is not null and vol_num is not null"
SQL = {
    "embed_prefixes": CUR + ASKED + f" select entity_uuid as id, 'passage: ' || {_ID} as text from entities_ union all select mention_id, 'query: ' || keyword from asked",
    "reasoning_split": CUR + f" select entity_uuid, md5(regexp_replace(coalesce(description, ''), {_EDGES}, '', 'g')) as thought, regexp_replace(coalesce(keyword, ''), {_EDGES}, '', 'g') as said from entities_",
    "tool_calls_stripped": CUR + f" select entity_uuid, md5(regexp_replace(coalesce(description, ''), {_EDGES}, '', 'g')) as text from entities_",
    "lenient_flags": CUR + " select entity_uuid, case when json_valid(content) and json_type(content, '$.tainted') = 'BOOLEAN' then (content->>'$.tainted')::boolean when contains(lower(coalesce(content, '')), 'tainted') then contains(lower(content), 'true') else true end as flag from entities_",
    "rendered_prompts": "select distinct novel_hash, vol_num, scene_index, ordinal, concat('Entity ', keyword, ' of type ', mention_type, ' in scene ', scene_index, ' costs $0.') as prompt from mentions",
    "log_names": _WRITTEN + """ select entity_uuid, version, concat('scene_', case when coalesce(appeared_in[1], 0) > 999 then coalesce(appeared_in[1], 0)::varchar else lpad(coalesce(appeared_in[1], 0)::varchar, 3, '0') end, '_extraction_', case when version > 1 then 'merge' else 'new' end,
  '_', coalesce(keyword, ''), '_', left(md5(case when version > 1 then entity_uuid else '' end), 8), '.json') as file from v""",
    "scoped_entities": CUR + " select novel_hash, vol_num, count(*) as entities from entities_ where vol_num <= 2 and entity_type = 'character' group by all",
    "validated_merges": _WRITTEN + f""", k as (select *, content->>'$.description' as told, coalesce(old_keyword, keyword) as asked from v)
select entity_uuid, version, asked is not distinct from keyword and not {_NONE.format('told')} as create_valid,
  (version > 1 or asked is not distinct from keyword) and not {_NAMELESS.format('keyword')} and not {_NONE.format('told')} as merge_valid from k""",
    "extended_types": CUR + f" select distinct novel_hash, '{','.join(P.TYPES)}' as types from entities_",
    "kv_keys": CUR + " select novel_hash, string_agg(vol_num, ',' order by vol_num) as keys from (select distinct novel_hash, vol_num from chunks_) group by all",
    "history_summary": CUR + """, l as (select novel_hash, title, row_number() over (partition by novel_hash order by vol_num desc, scene_index desc, chunk_uuid desc) as n from chunks_ qualify n <= 3)
select novel_hash, string_agg(coalesce(title, ''), chr(10) order by n desc) as history from l group by all""",
    "entity_backups": CUR + """, s as (select distinct e.novel_hash, e.vol_num, coalesce(e.entity_type, 'none') as entity_type, e.entity_uuid from entities e join entities_ c using (entity_uuid) where coalesce(e.entity_type, 'none') = coalesce(c.entity_type, 'none'))
select novel_hash, vol_num, entity_type, count(distinct entity_uuid) as entities from s group by all""",
    "step_logs": _WRITTEN + " select novel_hash, case when version > 1 then 'merge' else 'new' end as step, count(*) as records from v group by all",
    "cleaned_states": CUR + " select novel_hash, vol_num, count(*)::int as scenes from chunks_ where trim(content) <> '' and (vol_num <> 1 or scene_index % 2 = 0) group by all",
    "augmented_scenes": CUR + """, r as (select chunk_uuid, unnest(range(len(entity_refs))) as p, unnest(entity_refs) as entity_uuid from chunks_), f as (select chunk_uuid, entity_uuid, min(p) as p from r group by all),
n as (select chunk_uuid, count(*) as c, string_agg(coalesce(keyword, ''), '|' order by p) as k from f join entities_ using (entity_uuid) group by all)
select chunk_uuid, coalesce(c, 0) as entities, coalesce(k, '') as keywords from chunks_ left join n using (chunk_uuid)""",
    "scene_upkeep": CUR + """, m as (select novel_hash, vol_num, keyword, list_sort(list(distinct scene_index)) as more from mentions where keyword is not null group by all),
c as (select entity_uuid, list_concat(coalesce(appeared_in, []), list_filter(more, lambda s: s > 0)) as l from entities_ join m using (novel_hash, vol_num, keyword))
select entity_uuid, array_to_string(list_filter(l, lambda x, i: x is not null and list_position(l, x) = i), ',') as appeared_in from c""",
    "decided_scenes": _fold_by(128, _seams()),
    "oversized_scenes": f"with s as ({_fold_by(128, _seams())}) select novel_hash, vol_num, scene_index, tokens from s where tokens > 8192",
    "resumed_summaries": CUR + f""", told as (select * from chunks_ where trim(content) <> ''), mid as (select quantile_disc(written_at, 0.5) as middle from chunks where chunk_uuid is not null),
early as (select chunk_uuid from chunks, mid where chunk_uuid is not null group by chunk_uuid, middle having min(written_at) < middle),
o as (select novel_hash, vol_num, scene_index, (chunk_uuid in (select chunk_uuid from early)) as first_, {_LINE_} as line from told),
a as (select novel_hash, vol_num, count(*) as n, count(*) filter (first_) as ne, string_agg(nullif(line, ''), ' → ' order by scene_index) filter (first_) as early_, string_agg(nullif(line, ''), ' → ' order by scene_index) filter (not first_) as late_ from o group by all)
select novel_hash, vol_num, n::int as scenes, true as compacted, md5(left(case when n = ne then coalesce(early_, '') else concat_ws(' → ', early_, late_) end, 300)) as outline from a""",
    "find_entity_scenes_tool": _dispatch(f"select *, {_SHOWN} as seen, {SEARCHED} as searched, concat_ws(chr(10), description, content) as words from entities_ where not coalesce(tainted, false)", "entity_uuid", "searched", "words", "seen desc, entity_uuid") + """,
sc as (select entity_uuid, string_agg(scene_index, ',' order by pos) as scenes from (select entity_uuid, novel_hash, vol_num, unnest(range(len(appeared_in[1:8]))) as pos, unnest(appeared_in[1:8]) as scene_index from docs) join chunks_ using (novel_hash, vol_num, scene_index) group by all),
i as (select mention_id, count(*) as hits, string_agg(concat(keyword, ' x', seen, ': ', scenes), '; ' order by place) as items from hits join (select entity_uuid, keyword, seen from docs) using (entity_uuid) left join sc using (entity_uuid) group by all)
select mention_id as query_id, coalesce(hits, 0) as hits, coalesce(items, '') as items from asked_ left join i using (mention_id)""",
    "search_scenes_tool": _dispatch("select *, concat_ws(chr(10), title, content) as words from chunks_", "chunk_uuid", "title", "words", "vol_num, scene_index, chunk_uuid") + """,
i as (select mention_id, count(*) as hits, string_agg(concat(title, ' ', length(left(coalesce(content, ''), 400))), '; ' order by place) as items from hits join (select chunk_uuid, title, content from docs) using (chunk_uuid) group by all)
select mention_id as query_id, coalesce(hits, 0) as hits, coalesce(items, '') as items from asked_ left join i using (mention_id)""",
    "get_scene_content_tool": CUR + """, a as (select distinct novel_hash, vol_num, scene_index + k as scene_index from mentions, (select unnest([0, 1]) as k) where scene_index % 20 = 0)
select novel_hash, vol_num, scene_index, chunk_uuid is not null as found, token_count, md5(content) as content from a left join chunks_ using (novel_hash, vol_num, scene_index)""",
    "get_vol_summary_tool": CUR + f""", a as (select novel_hash, unnest(range(1, max(vol_num) + 2))::int as vol_num from mentions group by novel_hash),
s as (select novel_hash, vol_num, coalesce(string_agg(nullif({_LINE_}, ''), ' → ' order by scene_index), '') as outline from chunks_ where trim(content) <> '' group by all)
select novel_hash, vol_num, outline is not null as found, case when outline is null then 'summary_not_generated' end as reason, md5(outline) as summary from a left join s using (novel_hash, vol_num)""",
    "process_steps": f"""with recursive k as (select * from mentions where upper(trim(coalesce(keyword, ''))) not in ({_list(P.NO_KEYWORD)}) and not regexp_matches(trim(coalesce(keyword, '')), '{P.PLACEHOLDER}') and not {_NONE.format('context_summary')} and novel_hash is not null),
o as (select novel_hash, vol_num, scene_index, ordinal, min({{'k': keyword, 't': coalesce(mention_type, ''), 'c': context_summary, 'a': coalesce(array_to_string(aliases, '|'), ''), 'g': coalesce(array_to_string(categories, '|'), '')}}) as v from k group by all),
m as (select novel_hash, concat_ws(':', novel_hash, vol_num, scene_index, ordinal) as id, row_number() over (partition by novel_hash order by vol_num, scene_index, ordinal) as i, lower(trim(v.k)) as name, length(v.c) as c,
  list_distinct(list_concat([lower(trim(v.k))], list_transform(list_filter(string_split(v.a, '|'), lambda x: x <> ''), lambda x: lower(trim(x))))) as names from o),
r as (select novel_hash, id, i, [{{'n': names, 'd': c, 't': len(names) - 1 > 8 or c > 800}}] as s, 1 as entity, false as merged, len(names) - 1 > 8 or c > 800 as tainted from m where i = 1
  union all select novel_hash, id, i, case when hit > 0 then list_transform(s, lambda x, j: case when j = hit then {{'n': list_distinct(list_concat(x.n, names)), 'd': x.d + c + 1, 't': len(list_distinct(list_concat(x.n, names))) - 1 > 8 or x.d + c + 1 > 800}} else x end)
      else list_append(s, {{'n': names, 'd': c, 't': len(names) - 1 > 8 or c > 800}}) end as s, case when hit > 0 then hit else len(s) + 1 end as entity, hit > 0 as merged,
      case when hit > 0 then len(list_distinct(list_concat(s[hit].n, names))) - 1 > 8 or s[hit].d + c + 1 > 800 else len(names) - 1 > 8 or c > 800 end as tainted
    from (select m.*, r.s, coalesce(list_position(list_transform(r.s, lambda x: not x.t and list_contains(x.n, m.name)), true), 0)::int as hit from r join m on m.novel_hash = r.novel_hash and m.i = r.i + 1))
select id as mention_id, entity::int as entity, merged, tainted from r""",
    "p5_documents_simple": _volume_sql(_WHOLE),
    "p5_documents_partial": _volume_sql(_WHOLE + """ union all select r.*, 'missing' from r where (vol_num is null and novel_hash is not null and novel_hash not in (select novel_hash from t where novel_hash is not null))
  or (novel_hash is null and vol_num is not null and vol_num not in (select vol_num from t where vol_num is not null))"""),
    "p5_documents_full": _volume_sql(_WHOLE + " union all select r.*, 'mixed' from r where (vol_num is null) <> (novel_hash is null)"),
}
