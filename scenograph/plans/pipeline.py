"""Queries of the pipeline's other stages: volumes as files, summaries, the question loop's state, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenograph.functions.predicates import NO_KEYWORD, PLACEHOLDER, not_tainted
from scenograph.operators import agent, summary
from scenograph.plans.knowledge import chunks, entities, questions
from scenograph.plans.knowledge_sql import ASKED, CUR
from scenograph.session import scratch_path
from scenograph.sources import keyvalue, volumes
from scenograph.streaming import ingest
from scenograph.tables import read

SCENE = ["novel_hash", "vol_num", "scene_index", "title", "content", "token_count"]


def ingest_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes joined to volumes, written as text files and read back by the file source."""
    c = chunks(spark, d, *SCENE).where("content is not null")
    whole = c.groupBy("novel_hash", "vol_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scene_index", "content"))), lambda x: x.content), "\n\n\n\n").alias("text"))
    base = scratch_path(spark, "volumes")
    volumes.write_volumes(whole.select(F.col("novel_hash").alias("folder"), "vol_num", "text"), base)
    back = volumes.read_volumes(spark, base)
    return back.select("folder", "novel_hash", "vol_num", F.length("text").alias("chars"))


def keyvalue_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Scenes put as JSON under novel and volume, one volume put again, and all read back."""
    base = scratch_path(spark, "kv")
    c = chunks(spark, d, *SCENE).select("novel_hash", "vol_num", "scene_index", "title")
    keyvalue.put(c, base, ["novel_hash", "vol_num"])
    keyvalue.put(c.where("vol_num = 1"), base, ["novel_hash", "vol_num"])
    return keyvalue.get(spark, base, c.schema).groupBy("novel_hash", "vol_num").agg(F.count("*").alias("scenes"), F.count("title").alias("titles"))


def _state(spark: SparkSession, d: str) -> DataFrame:
    """The state as the mentions show it: scenes with mentions have been read."""
    return read(spark, d, "mentions").groupBy("novel_hash", "vol_num").agg(F.collect_set("scene_index").alias("updated_scenes"))


def pending_scenes(spark: SparkSession, d: str) -> DataFrame:
    return summary.pending(chunks(spark, d, *SCENE), _state(spark, d)).select("novel_hash", "vol_num", "scene_index")


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    scenes = chunks(spark, d, *SCENE).where("trim(coalesce(content, '')) <> ''")
    return summary.fold(scenes, entities(spark, d, "novel_hash", "vol_num", "entity_type", "keyword", "appeared_in", "tainted"))


def volume_summaries(spark: SparkSession, d: str) -> DataFrame:
    s = _summaries(spark, d)
    return s.select("novel_hash", "vol_num", F.size("updated_scenes").alias("scenes"), "protagonist", F.array_join("main_characters", "|").alias("main_characters"), F.array_join("key_locations", "|").alias("key_locations"), F.md5("outline").alias("outline"))


def summary_compact(spark: SparkSession, d: str) -> DataFrame:
    return summary.compact(_summaries(spark, d), chunks(spark, d, *SCENE)).select("novel_hash", "vol_num", "compacted", "background")


def vol_summary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every novel's volumes with whether a summary is there."""
    have = _summaries(spark, d).select("novel_hash", "vol_num").withColumn("found", F.lit(True))
    return chunks(spark, d, *SCENE).select("novel_hash", "vol_num").distinct().join(have, ["novel_hash", "vol_num"], "left").select("novel_hash", "vol_num", F.coalesce("found", F.lit(False)).alias("found"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Every stated question as a conversation: the keyword asked for, and what the tools give to it, first the entities of that name, then the scene's text."""
    q = questions(spark, d).select("mention_id", "novel_hash", "vol_num", F.element_at(F.split("mention_id", ":"), 3).cast("int").alias("scene_index"), "keyword")
    e = entities(spark, d, "novel_hash", "vol_num", "keyword", "description", "tainted").where(not_tainted()).select("entity_uuid", "novel_hash", F.col("vol_num").alias("e_vol"), F.lower(F.trim("keyword")).alias("k"), "description")
    hits = q.withColumn("k", F.lower(F.trim("keyword"))).join(e, ["novel_hash", "k"]).where("e_vol <= vol_num")
    hits = hits.groupBy("mention_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_uuid", F.coalesce("description", F.lit("")).alias("d")))), lambda x: x.d), "\n").alias("found"))
    text = chunks(spark, d, "novel_hash", "vol_num", "scene_index", "content").select("novel_hash", "vol_num", "scene_index", "content")
    all_ = q.join(hits, "mention_id", "left").join(text, ["novel_hash", "vol_num", "scene_index"], "left")
    said = lambda role, name, content: F.struct(F.lit(role).alias("role"), F.lit(name).cast("string").alias("name"), content.alias("content"))
    turns = F.array(
        said("human", None, F.col("keyword")), said("ai", None, F.lit("")), said("tool", "find_entity_scenes", F.coalesce("found", F.lit(""))),
        said("ai", None, F.lit("")), said("tool", "get_scene_content", F.coalesce("content", F.lit(""))), said("ai", None, F.lit("")),
    )
    return all_.select(F.col("mention_id").alias("conversation"), F.posexplode(turns).alias("pos", "m")).select("conversation", "pos", "m.*")


def token_gate(spark: SparkSession, d: str) -> DataFrame:
    return agent.gate_position(messages(spark, d), context=1024, most=50)


def route_decision(spark: SparkSession, d: str) -> DataFrame:
    p = agent.progress(messages(spark, d), context=1024, most=50).where("route is not null")
    return p.groupBy("conversation", "route").agg(F.count("*").alias("plans"), F.max("used").alias("used"))


def trailing_tool_run(spark: SparkSession, d: str) -> DataFrame:
    """The notes that end each conversation as it stands before its last plan."""
    return agent.trailing_notes(messages(spark, d).where("pos < 5")).select("conversation", "pos", F.md5("note").alias("note"))


def notes_accumulate(spark: SparkSession, d: str) -> DataFrame:
    return agent.notes_so_far(messages(spark, d)).groupBy("conversation").agg(F.max("notes").alias("notes"), F.max("chars").alias("chars"))


def history_pack(spark: SparkSession, d: str) -> DataFrame:
    """The questions of a volume as turns of one talk, each with the notes that its tools gave."""
    m = messages(spark, d)
    notes = F.array_sort(F.collect_list(F.when(F.col("role") == "tool", F.struct("pos", agent.note().alias("note")))))
    asked = m.groupBy("conversation").agg(F.max(F.when(F.col("role") == "human", F.col("content"))).alias("question"), F.transform(notes, lambda x: x.note).alias("notes"))
    place = F.split("conversation", ":")
    talk = F.concat_ws(":", place[0], place[1])
    turn = F.row_number().over(Window.partitionBy(talk).orderBy(place[2].cast("int"), place[3].cast("int"), "conversation"))
    packed = agent.packed_history(asked.select(talk.alias("conversation"), turn.alias("turn"), "question", "notes", F.lit(None).cast("string").alias("answer")))
    return packed.select("conversation", "pos", "role", "name", F.length("content").alias("chars"))


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The scenes' log read as a stream; the same table as latest-wins over all rows."""
    path, columns = scratch_path(spark, "stream"), ["novel_hash", "vol_num", "scene_index", "token_count", "written_at"]
    ingest.upsert_stream(ingest.rows_stream(spark, f"{d}/chunks.parquet"), "chunk_uuid", columns, f"{path}/rows", f"{path}/checkpoint")
    return ingest.upserted(spark, "chunk_uuid", columns, f"{path}/rows").groupBy("novel_hash", "vol_num").agg(F.count("*").alias("scenes"), F.sum("token_count").alias("tokens"))


def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """Scenes per volume as keyed state of the stream."""
    path = scratch_path(spark, "progress")
    ingest.run_progress(ingest.rows_stream(spark, f"{d}/chunks.parquet"), f"{path}/rows", f"{path}/checkpoint")
    last = spark.read.parquet(f"{path}/rows").groupBy("novel_hash", "vol_num").agg(F.max_by(F.struct("scenes", "last_scene"), "number").alias("r"))
    return last.select("novel_hash", "vol_num", "r.scenes", "r.last_scene")


QUERIES = {
    f.__name__: f
    for f in (
        ingest_volumes, keyvalue_roundtrip, pending_scenes, volume_summaries, summary_compact, vol_summary_lookup, token_gate, route_decision, trailing_tool_run,
        notes_accumulate, history_pack, stream_upsert, stream_progress,
    )
}

_CUR = """with chunks_ as (select * from chunks where chunk_uuid is not null qualify row_number() over (partition by chunk_uuid order by written_at desc) = 1),
entities_ as (select * from entities where entity_uuid is not null qualify row_number() over (partition by entity_uuid order by written_at desc) = 1),
told as (select * from chunks_ where trim(content) <> '')"""
_MESSAGES = CUR + ASKED + """, q as (select mention_id, novel_hash, vol_num, split_part(mention_id, ':', 3)::int as scene_index, keyword from asked),
found as (select mention_id, string_agg(coalesce(description, ''), chr(10) order by entity_uuid) as found from q join (select entity_uuid, novel_hash, vol_num as e_vol, lower(trim(keyword)) as k, description from entities_ where not coalesce(tainted, false)) e
  on q.novel_hash = e.novel_hash and lower(trim(q.keyword)) = e.k and e_vol <= q.vol_num group by all),
t as (select q.mention_id, keyword, coalesce(found, '') as found, coalesce(content, '') as content from q left join found using (mention_id) left join chunks_ using (novel_hash, vol_num, scene_index)),
g as (select mention_id as conversation, pos, (['human', 'ai', 'tool', 'ai', 'tool', 'ai'])[pos + 1] as role, case pos when 2 then 'find_entity_scenes' when 4 then 'get_scene_content' end as name,
  case pos when 0 then keyword when 2 then found when 4 then content else '' end as content from t, (select unnest(range(6))::int as pos)),
r as (select *, floor(sum(length(content) + case when role = 'tool' then length(name) + 3 + length(content) else 0 end) over w / 2)::bigint as used, sum((role = 'ai')::int) over w as iteration,
  coalesce(lead(role) over (partition by conversation order by pos) = 'tool', false) as calls from g window w as (partition by conversation order by pos rows unbounded preceding)),
d as (select *, case when role = 'ai' then case when least(1.0, used / 1024) >= 0.7 or iteration >= 50 then 'answer' when calls then 'tool' else 'answer' end end as route from r)"""
_NOTE = "'[' || coalesce(name, '') || '] ' || coalesce(content, '')"
_LINE = r"trim(regexp_replace(left(content, 50), '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ')"
_OUTLINE = f"string_agg({_LINE}, ' → ' order by scene_index)"
_CAST = """, cast_ as (select *, lower(trim(entity_type)) as kind, coalesce(len(appeared_in), 0) as seen from entities_ where not coalesce(tainted, false)
  and upper(trim(coalesce(keyword, ''))) not in ({0}) and not regexp_matches(trim(coalesce(keyword, '')), '{1}')),
ranked as (select *, row_number() over (partition by novel_hash, vol_num, kind order by seen desc, entity_uuid) as n from cast_ where kind in ('character', 'location')),
who as (select novel_hash, vol_num, max(case when kind = 'character' and n = 1 then keyword end) as protagonist, string_agg(case when kind = 'character' and n between 2 and 11 then keyword end, '|' order by n) as c,
  string_agg(case when kind = 'location' and n <= 10 then keyword end, '|' order by n) as l from ranked where n <= 11 group by all)""".format(", ".join(f"'{v}'" for v in NO_KEYWORD), PLACEHOLDER)

SQL = {
    "ingest_volumes": _CUR + r""" select novel_hash as folder, substr(md5(novel_hash), 1, 8) as novel_hash, vol_num, (sum(length(regexp_replace(content, '\r\n?', chr(10), 'g'))) + 4 * (count(*) - 1) + 1)::int as chars
from chunks_ where content is not null group by chunks_.novel_hash, vol_num""",
    "keyvalue_roundtrip": _CUR + " select novel_hash, vol_num, count(*) as scenes, count(title) as titles from chunks_ group by all",
    "pending_scenes": _CUR + " select novel_hash, vol_num, scene_index from told anti join mentions using (novel_hash, vol_num, scene_index)",
    "volume_summaries": _CUR + _CAST + f""", s as (select novel_hash, vol_num, count(*) as scenes, md5({_OUTLINE}) as outline from told group by all)
select s.novel_hash, s.vol_num, scenes, protagonist, case when who.novel_hash is not null then coalesce(c, '') end as main_characters, case when who.novel_hash is not null then coalesce(l, '') end as key_locations, outline from s left join who using (novel_hash, vol_num)""",
    "summary_compact": _CUR + f" select novel_hash, vol_num, {_OUTLINE} <> '' as compacted, left({_OUTLINE}, 300) as background from told group by all",
    "vol_summary_lookup": _CUR + " select novel_hash, vol_num, bool_or(coalesce(trim(content) <> '', false)) as found from chunks_ group by all",
    "token_gate": _MESSAGES + " select conversation, min(case when route = 'answer' and calls then pos end) as pos from d group by all",
    "route_decision": _MESSAGES + " select conversation, route, count(*) as plans, max(used)::bigint as used from d where route is not null group by all",
    "trailing_tool_run": _MESSAGES + f" select conversation, pos, md5({_NOTE}) as note from g where pos = 4",
    "notes_accumulate": _MESSAGES + f""", n as (select conversation, coalesce(sum((role = 'tool')::int) over w, 0)::bigint as notes, coalesce(sum(case when role = 'tool' then length({_NOTE}) else 0 end) over w, 0)::bigint as chars
  from g window w as (partition by conversation order by pos rows between unbounded preceding and 1 preceding)) select conversation, max(notes) as notes, max(chars) as chars from n group by all""",
    "history_pack": _MESSAGES + f""", n as (select conversation, max(case when role = 'human' then content end) as question, sum(length({_NOTE})) filter (role = 'tool') + 2 as chars from g group by all),
u as (select split_part(conversation, ':', 1) || ':' || split_part(conversation, ':', 2) as talk, question, chars,
  row_number() over (partition by split_part(conversation, ':', 1), split_part(conversation, ':', 2) order by split_part(conversation, ':', 3)::int, split_part(conversation, ':', 4)::int, conversation) as turn from n)
select talk as conversation, ((turn - 1) * 4 + k)::int as pos, (['human', 'ai', 'tool', 'ai'])[k + 1] as role, case when k in (1, 2) then 'retrieved_notes_turn_' || turn end as name,
  case k when 0 then length(question) when 2 then chars else 0 end::int as chars from u, (select unnest([0, 1, 2, 3]) as k)""",
    "stream_upsert": _CUR + " select novel_hash, vol_num, count(*) as scenes, sum(token_count)::bigint as tokens from chunks_ group by all",
    "stream_progress": "select novel_hash, vol_num, count(distinct scene_index)::int as scenes, max(scene_index) as last_scene from chunks group by all",
}
