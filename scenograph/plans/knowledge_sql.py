"""The results of the knowledge queries in SQL, for comparison."""

from __future__ import annotations

from scenograph.functions.predicates import NO_CONTEXT, NO_KEYWORD, PLACEHOLDER
from scenograph.functions.text import TOKEN
from scenograph.operators.extraction import NAME

CUR = """with chunks_ as (select * from chunks where chunk_uuid is not null qualify row_number() over (partition by chunk_uuid order by written_at desc) = 1),
entities_ as (select * from entities where entity_uuid is not null qualify row_number() over (partition by entity_uuid order by written_at desc) = 1)"""
PLACE = "concat_ws(':', novel_hash, vol_num, scene_index, ordinal)"
ASKED = f""", asked as (select mention_id, novel_hash, vol_num, r.k as keyword, r.t as mention_type, r.s as context_summary from (
  select {PLACE} as mention_id, novel_hash, vol_num, min({{'k': coalesce(keyword, ''), 't': coalesce(mention_type, ''), 's': coalesce(context_summary, '')}}) as r
  from mentions where scene_index % 20 = 0 group by all))"""
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{TOKEN}')"


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _bm25(name: str, queries: str, docs: str, key: str, qtext: str, text: str) -> str:
    return f""", {name}_tf as (select novel_hash, {key}, term, count(*) as tf from (select novel_hash, {key}, unnest({_tokens(text)}) as term from {docs}) group by all),
{name}_dl as (select novel_hash, {key}, sum(tf) as dl from {name}_tf group by all),
{name}_all as (select (select count(*) from {docs}) as n, (select avg(dl) from {name}_dl) as avgdl),
{name}_df as (select term, count(*) as df from {name}_tf group by all),
{name} as (select q.mention_id, t.{key}, t.novel_hash, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) as bm25
  from (select mention_id, novel_hash, unnest(list_distinct({_tokens(qtext)})) as term from {queries}) q
  join {name}_tf t using (novel_hash, term) join {name}_df using (term) join {name}_dl l using (novel_hash, {key}), {name}_all group by all)"""


def _vectors(name: str, rows: str, key: str, text: str) -> str:
    return f""", {name}_c as (select novel_hash, {key}, ('0x' || substr(md5(t), 1, 8))::bigint % 64 as bucket, count(*)::double as c
  from (select novel_hash, {key}, unnest({_tokens(text)}) as t from {rows}) group by all),
{name} as (select novel_hash, {key}, bucket, c / sqrt(sum(c * c) over (partition by novel_hash, {key})) as w from {name}_c)"""


def _near(name: str, q: str, d: str, key: str) -> str:
    return f""", {name} as (select q.mention_id, d.{key}, q.novel_hash, sum(q.w * d.w) as cosine from {q} q join {d} d using (novel_hash, bucket) group by all)"""


def _scaled(c: str) -> str:
    w = "over (partition by mention_id)"
    return f"case when max({c}) {w} > min({c}) {w} then ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) else 1.0 end"


def _search(docs: str, key: str, text: str, words: str, ranked: bool = False) -> str:
    rank = lambda c: f"1 / (60 + row_number() over (partition by mention_id order by round({c}, 9) desc, {key}))"
    value = rank if ranked else _scaled
    share = ("coalesce(v.s, 0) + coalesce(k.s, 0)") if ranked else "0.5 * coalesce(v.s, 0) + 0.5 * coalesce(k.s, 0)"
    return (
        CUR + ASKED + ", q as (select * from asked where trim(keyword) <> '')" + f", docs as ({docs})" + _vectors("qv", "q", "mention_id", "keyword") + _vectors("dv", "docs", key, text)
        + _near("near_", "qv", "dv", key) + _bm25("bm", "q", "docs", key, "keyword", words)
        + f""", v as (select mention_id, {key}, {value('cosine')} as s from near_), k as (select mention_id, {key}, {value('bm25')} as s from bm),
f as (select coalesce(v.mention_id, k.mention_id) as query_id, coalesce(v.{key}, k.{key}) as {key}, {share} as hybrid from v full join k on v.mention_id = k.mention_id and v.{key} = k.{key})
select query_id, {key}, round(hybrid, 6) as hybrid from f qualify row_number() over (partition by query_id order by round(hybrid, 9) desc, {key}) <= 5"""
    )


_CHANGES = lambda c: f"coalesce(json_extract({c}, '$.major_status_changes')::struct(scene_index int, event varchar)[], [])"
SEARCHED = f"concat(coalesce(description, ''), case when len({_CHANGES('content')}) > 0 then chr(10) || array_to_string(list_transform({_CHANGES('content')}, lambda c: '- ' || c.event), chr(10)) else '' end)"
FOUND = f"select entity_uuid, novel_hash, {SEARCHED} as searched, concat_ws(chr(10), description, content) as words from entities_ where not coalesce(tainted, false)"
_IDENTITY = "concat(coalesce(keyword, ''), case when len(list_filter(coalesce(aliases, []), lambda a: a is not null)) > 0 then ' | ' || array_to_string(list_filter(aliases, lambda a: a is not null), ', ') else '' end)"
_LETTERS = lambda c: f"list_filter(string_split(lower(coalesce({c}, '')), ''), lambda x: trim(x) <> '')"
_GATE = (
    CUR + ASKED
    + f""", m as (select mention_id, novel_hash, vol_num as m_vol, keyword as m_keyword, lower(trim(mention_type)) as m_type, keyword || ' ' || left(context_summary, 400) as m_text from asked where trim(keyword) <> ''),
e as (select entity_uuid, novel_hash, vol_num as e_vol, lower(trim(entity_type)) as e_type, keyword as e_keyword, {_IDENTITY} as e_identity, {SEARCHED} as searched, concat_ws(chr(10), description, content) as words from entities_ where not coalesce(tainted, false))"""
    + _vectors("mi", "m", "mention_id", "m_keyword") + _vectors("ei", "e", "entity_uuid", "e_identity") + _near("near_i", "mi", "ei", "entity_uuid")
    + _vectors("mc", "m", "mention_id", "m_text") + _vectors("ec", "e", "entity_uuid", "searched") + _near("near_c", "mc", "ec", "entity_uuid")
    + _bm25("bm", "m", "e", "entity_uuid", "m_text", "words")
    + f""", a0 as (select n.mention_id, n.entity_uuid, cosine, coalesce(m_type = e_type, false) as same from near_i n join m using (mention_id) join e using (entity_uuid) where e_vol <= m_vol),
a1 as (select * from a0 qualify same or not max(same::int) over (partition by mention_id)::boolean),
ta as (select mention_id, entity_uuid, greatest(0, 1 - (1 - cosine) / 2) as id_sim from a1 qualify row_number() over (partition by mention_id order by round(greatest(0, 1 - (1 - cosine) / 2), 9) desc, entity_uuid) <= 5),
v as (select n.mention_id, n.entity_uuid, {_scaled('cosine')} as s from near_c n join m using (mention_id) join e using (entity_uuid) where e_vol <= m_vol and m_type = e_type),
k as (select n.mention_id, n.entity_uuid, {_scaled('bm25')} as s from bm n join m using (mention_id) join e using (entity_uuid) where e_vol <= m_vol and m_type = e_type),
f as (select coalesce(v.mention_id, k.mention_id) as mention_id, coalesce(v.entity_uuid, k.entity_uuid) as entity_uuid, 0.5 * coalesce(v.s, 0) + 0.5 * coalesce(k.s, 0) as content_sim
  from v full join k on v.mention_id = k.mention_id and v.entity_uuid = k.entity_uuid),
tb as (select * from f qualify row_number() over (partition by mention_id order by round(content_sim, 9) desc, entity_uuid) <= 5),
u as (select coalesce(ta.mention_id, tb.mention_id) as mention_id, coalesce(ta.entity_uuid, tb.entity_uuid) as entity_uuid, coalesce(id_sim, 0) as id_sim, coalesce(content_sim, 0) as content_sim
  from ta full join tb on ta.mention_id = tb.mention_id and ta.entity_uuid = tb.entity_uuid),
o as (select u.*, coalesce(len(list_intersect({_LETTERS('m_keyword')}, {_LETTERS('e_keyword')})) > 0, false) as overlap from u join m using (mention_id) join e using (entity_uuid)),
g as (select *, case when id_sim >= 0.75 then 1 when overlap and id_sim >= 0.62 then 2 when overlap and content_sim >= 0.10 then 3 when content_sim >= 0.35 then 4 end as rule from o),
s as (select *, case when rule <= 2 then id_sim else content_sim end as score from g where rule is not null),
t as (select mention_id, entity_uuid, round(id_sim, 6) as id_sim, round(content_sim, 6) as content_sim, rule, round(score, 6) as score from s
  qualify row_number() over (partition by mention_id order by round(score, 9) desc, entity_uuid) <= 5)
"""
)

_VERSIONS = """with v as (select *, row_number() over w as version, lag(keyword) over w as old_keyword, lag(aliases) over w as old_aliases, lag(entity_type) over w as old_type,
  lag(categories) over w as old_categories, lag(content) over w as old_content
  from (select distinct on (entity_uuid, written_at) * from entities) window w as (partition by entity_uuid order by written_at)), n as (select * from v where version > 1)"""
_VALUE = lambda c: f"upper(trim(coalesce({c}, '')))"
_SHOWN = "len(list_filter(coalesce(appeared_in, []), lambda x: x is not null))"
_TRUNCATED = "case when ceil(length({x}) / 2) <= 100 then {x} else substr({x}, 1, floor(length({x}) * 0.85)::int) end"


def _seams() -> str:
    """Current scenes with j: whether the words at the seam to the scene before say that both belong together."""
    return f""", seam as (select *, lag(coalesce(content, '')) over (partition by novel_hash, vol_num order by scene_index) as before from chunks_),
words as (select *, list_distinct({_tokens('right(before, 400)')}) as a, list_distinct({_tokens("left(coalesce(content, ''), 400)")}) as b from seam),
joined as (select *, before is null or coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0) >= 0.05, true) as j from words)"""


def _fold(floor: int, joins: bool) -> str:
    return _fold_by(floor, f", joined as (select *, {str(joins).lower()} as j from chunks_)")


def _fold_by(floor: int, joined: str) -> str:
    """The fold as a recursive walk over the pieces of every volume; joined(.., j) says which join the one before."""
    return CUR + joined + f""" , p as (select novel_hash, vol_num, row_number() over w - 1 as i, coalesce(token_count, 0) as t, j from joined window w as (partition by novel_hash, vol_num order by scene_index, token_count)),
walk as (with recursive r as (select novel_hash, vol_num, i, t as total, 0 as grp from p where i = 0
  union all select p.novel_hash, p.vol_num, p.i, case when p.j and r.total + p.t <= 4096 then r.total + p.t else p.t end, case when p.j and r.total + p.t <= 4096 then r.grp else r.grp + 1 end
  from r join p on p.novel_hash = r.novel_hash and p.vol_num = r.vol_num and p.i = r.i + 1) select * from r),
f as (select w.novel_hash, w.vol_num, grp, min(w.i) as first, count(*) as n, sum(p.t) as t from walk w join p using (novel_hash, vol_num, i) group by all),
ab as (with recursive r as (select novel_hash, vol_num, grp, t as total, 0 as scene from f where grp = 0
  union all select f.novel_hash, f.vol_num, f.grp, case when f.t < {floor} or (r.scene = 0 and r.total < {floor}) then r.total + f.t else f.t end,
    case when f.t < {floor} or (r.scene = 0 and r.total < {floor}) then r.scene else r.scene + 1 end
  from r join f on f.novel_hash = r.novel_hash and f.vol_num = r.vol_num and f.grp = r.grp + 1) select * from r)
select novel_hash, vol_num, (scene + 1)::int as scene_index, min(first)::int as first, sum(n)::int as pieces, sum(t)::int as tokens from ab join f using (novel_hash, vol_num, grp) group by novel_hash, vol_num, scene"""


SQL = {
    "near_vector_topk": """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
s as (select q.vec_id as query_id, r.vec_id as row_id, round(list_cosine_similarity(q.e, r.e), 12) as c from v q join v r on q.vec_id % 20 = 0 and q.vec_id <> r.vec_id)
select query_id, row_id, round(greatest(0, 1 - (1 - c) / 2), 6) as certainty from s qualify row_number() over (partition by query_id order by c desc, row_id) <= 5""",
    "bm25_scores": CUR + ASKED + ", q as (select * from asked where trim(keyword) <> '')" + _bm25("bm", "q", "entities_", "entity_uuid", "keyword", "description") + " select mention_id, entity_uuid, round(bm25, 6) as bm25 from bm",
    "dual_track_gate": _GATE + "select * from t",
    "gate_rules": _GATE + "select rule, count(*) as candidates, count(distinct mention_id) as mentions from t group by all",
    "literal_overlap": CUR + f""", m as (select distinct {PLACE} as mention_id, novel_hash, vol_num, scene_index, keyword as mk from mentions),
e as (select novel_hash, vol_num, entity_uuid, keyword, unnest(list_distinct(appeared_in)) as scene_index from entities_)
select novel_hash, vol_num, count(*) as pairs, sum(coalesce(len(list_intersect({_LETTERS('mk')}, {_LETTERS('keyword')})) > 0, false)::int)::bigint as overlapping from m join e using (novel_hash, vol_num, scene_index) group by all""",
    "universal_search_semantic": _search(FOUND, "entity_uuid", "searched", "words"),
    "universal_search_ranked": _search(FOUND, "entity_uuid", "searched", "words", True),
    "search_scenes_semantic": _search("select chunk_uuid, novel_hash, title, concat_ws(chr(10), title, content) as words from chunks_", "chunk_uuid", "title", "words"),
    "universal_search_list": CUR + f" select novel_hash, entity_uuid, keyword, {_SHOWN} as appearances from entities_ where not coalesce(tainted, false) qualify row_number() over (partition by novel_hash order by {_SHOWN} desc, entity_uuid) <= 15",
    "search_scenes_list": CUR + " select novel_hash, vol_num, scene_index, title, left(content, 400) as excerpt from chunks_ qualify row_number() over (partition by novel_hash order by vol_num, scene_index, chunk_uuid) <= 5",
    "category_contains_any": CUR + " select novel_hash, count(*) as entities from entities_ where list_has_any(categories, ['guild', '公會', 'noble']) group by all",
    "scene_point_lookup": CUR + " select c.chunk_uuid, c.novel_hash, c.vol_num, c.scene_index, c.title from chunks_ c semi join mentions m on c.novel_hash = m.novel_hash and c.vol_num = m.vol_num and c.scene_index = m.scene_index and m.vol_num > 0",
    "no_future_leak": CUR + ", p as (select novel_hash, vol_num, count(*) as n from entities_ where not coalesce(tainted, false) group by all) select novel_hash, vol_num, (sum(n) over (partition by novel_hash order by vol_num))::bigint as visible from p",
    "list_novels": CUR + """, p as (select novel_hash, vol_num, count(*) as n from chunks_ group by all), v as (select novel_hash, string_agg(vol_num || ':' || n, ',' order by vol_num) as vols, sum(n)::bigint as scene_count from p group by all),
e as (select novel_hash, count(*) as c from entities_ group by all) select v.novel_hash, coalesce(title, 'untitled') as title, vols, scene_count, coalesce(c, 0) as entity_count from v left join e using (novel_hash) left join novels using (novel_hash)""",
    "novel_profile_volumes": CUR + " select novel_hash, vol_num, count(*) as scenes from chunks_ group by rollup (novel_hash, vol_num) having grouping(novel_hash) = 0",
    "novel_profile_types": CUR + " select novel_hash, coalesce(entity_type, 'unknown') as entity_type, count(*) as entities from entities_ where not coalesce(tainted, false) group by all",
    "novel_profile_top": CUR + f" select novel_hash, entity_uuid, keyword, {_SHOWN} as appearances from entities_ where not coalesce(tainted, false) qualify row_number() over (partition by novel_hash order by {_SHOWN} desc, entity_uuid) <= 8",
    "entity_types": CUR + " select distinct entity_type from entities_ where trim(entity_type) <> ''",
    "max_volume": CUR + " select novel_hash, coalesce(max(vol_num), 1) as max_vol from chunks_ group by all",
    "find_entity_scenes": CUR + """, s as (select entity_uuid, novel_hash, vol_num, unnest(range(len(appeared_in[1:8]))) as pos, unnest(appeared_in[1:8]) as scene_index from entities_ where not coalesce(tainted, false))
select entity_uuid, pos::int as pos, scene_index, title from s join chunks_ using (novel_hash, vol_num, scene_index)""",
    "chunk_uuid5": "select distinct novel_hash, vol_num, scene_index, lower(chunk_uuid) as uuid from chunks",
    "chunk_upsert_latest": CUR + " select novel_hash, vol_num, count(*) as scenes, sum(token_count)::bigint as tokens, max(written_at) as last_written from chunks_ group by all",
    "rechunk_resets_refs": CUR + " select novel_hash, vol_num, count(*) as scenes, sum(case when vol_num = 1 then 0 else coalesce(len(entity_refs), 0) end)::bigint as refs from chunks_ group by all",
    "entity_refs_backfill": CUR + """, b as (select chunk_uuid, string_agg(entity_uuid, ',' order by entity_uuid) as r from (select distinct unnest(chunk_refs) as chunk_uuid, entity_uuid from entities_) group by all)
select chunk_uuid, coalesce(r, '') as entity_refs from chunks_ left join b using (chunk_uuid)""",
    "chunk_to_entities": CUR + """, r as (select chunk_uuid, unnest(range(len(entity_refs))) as p, unnest(entity_refs) as entity_uuid from chunks_), f as (select chunk_uuid, entity_uuid, min(p) as p from r group by all),
o as (select chunk_uuid, entity_uuid, row_number() over (partition by chunk_uuid order by p) - 1 as pos from f) select chunk_uuid, pos::int as pos, entity_uuid, keyword from o join entities_ using (entity_uuid)""",
    "entity_to_chunks": CUR + """, r as (select entity_uuid, unnest(range(len(chunk_refs))) as p, unnest(chunk_refs) as chunk_uuid from entities_), f as (select entity_uuid, chunk_uuid, min(p) as p from r group by all),
o as (select entity_uuid, chunk_uuid, row_number() over (partition by entity_uuid order by p) - 1 as pos from f) select entity_uuid, pos::int as pos, chunk_uuid, title from o join chunks_ using (chunk_uuid)""",
    "link_consistency": CUR + """, f as (select distinct chunk_uuid, unnest(entity_refs) as entity_uuid from chunks_), b as (select distinct unnest(chunk_refs) as chunk_uuid, entity_uuid from entities_),
f1 as (select * from f where entity_uuid is not null), b1 as (select * from b where chunk_uuid is not null)
select *, 'chunk' as side from (select * from f1 except select * from b1) union all select *, 'entity' from (select * from b1 except select * from f1)""",
    "volume_delete": CUR + """, fr as (select novel_hash from novels where lang = 'fr'), doomed as (select distinct novel_hash, vol_num from chunks_ where novel_hash in (select novel_hash from fr))
select 'chunks' as layer, novel_hash, count(*) as left_rows from chunks_ c anti join doomed d on c.novel_hash = d.novel_hash and c.vol_num = d.vol_num group by all
union all select 'entities', novel_hash, count(*) from entities_ c anti join doomed d on c.novel_hash = d.novel_hash and c.vol_num = d.vol_num group by all""",
    "orphan_cleanup": CUR + " select distinct f.entity_uuid, f.entity_type as folder_type from entities f join entities_ e using (entity_uuid) where coalesce(f.entity_type <> e.entity_type, true)",
    "sentence_split": rf"select doc_id, len(list_filter(string_split(regexp_replace(text, '([。！？\n])', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '{BLANK}', '', 'g') <> '')) as sentences from documents where text is not null",
    "volume_number": r"select novel_hash, coalesce(try_cast(regexp_extract(folder, '(\d+)', 1) as int), 0) as number from novels",
    "truncate_tokens": CUR + f""", a as (select chunk_uuid, content, case when ceil(length(content) / 2) <= 100 then content else substr(content, 1, floor(length(content) * 100 * 0.9 / ceil(length(content) / 2))::int) end as x from chunks_ where content is not null),
b as (select chunk_uuid, content, {_TRUNCATED.format(x='x')} as x from a), c as (select chunk_uuid, content, {_TRUNCATED.format(x='x')} as x from b), d as (select chunk_uuid, content, {_TRUNCATED.format(x='x')} as x from c)
select chunk_uuid, length(content) as chars, length(x) as kept, md5(x) as digest from d""",
    "identity_text": CUR + f" select entity_uuid, {_IDENTITY} as identity from entities_",
    "content_text": CUR + f" select entity_uuid, md5(concat(coalesce(description, ''), case when len({_CHANGES('content')}) > 0 then chr(10) || array_to_string(list_transform({_CHANGES('content')}, lambda c: '- ' || c.event), chr(10)) else '' end)) as digest from entities_",
    "json_blob_agrees": CUR + " select entity_uuid, keyword is not distinct from json_extract_string(content, '$.keyword') as keyword_same, description is not distinct from json_extract_string(content, '$.description') as description_same from entities_",
    "mention_filter": f"""select coalesce(lower(trim(mention_type)), 'concept') as mention_type, {_VALUE('keyword')} not in ({_list(NO_KEYWORD)}) and not regexp_matches(trim(coalesce(keyword, '')), '{PLACEHOLDER}') as named,
{_VALUE('context_summary')} not in ({_list(NO_CONTEXT)}) as told, count(*) as mentions from mentions group by all""",
    "final_guard": CUR + f" select entity_uuid from entities_ where {_VALUE('keyword')} in ({_list(NO_CONTEXT)}) or {_VALUE('description')} in ({_list(NO_CONTEXT)})",
    "token_buckets": CUR + f", t as (select unnest({_tokens('description')}) as t from entities_) select (('0x' || substr(md5(t), 1, 8))::bigint % 64)::int as bucket, count(*) as tokens, count(distinct t) as distinct_tokens from t group by all",
    "merge_canonical_name": _VERSIONS + " select entity_uuid, version, case when contains(coalesce(old_keyword, ''), '未知') then keyword else coalesce(old_keyword, '') end as name from n",
    "merge_alias_union": _VERSIONS + """, u as (select entity_uuid, version, list_concat(coalesce(aliases, []), coalesce(old_aliases, []), case when not contains(coalesce(old_keyword, ''), '未知') and keyword is not null and coalesce(old_keyword, '') <> keyword then [keyword] else [] end) as a from n)
select entity_uuid, version, coalesce(array_to_string(list_sort(list_distinct(a)), '|'), '') as aliases from u""",
    "merge_type_lock": _VERSIONS + """, k as (select *, trim(coalesce(old_type, '')) as o from n), c as (select *, list_concat(coalesce(categories, []), case when o <> '' and coalesce(entity_type, '') <> '' and entity_type <> o then [entity_type] else [] end) as cs from k)
select entity_uuid, version, case when o <> '' then o else entity_type end as entity_type,
  case when len(cs) > len(coalesce(categories, [])) then array_to_string(list_filter(cs, lambda x, i: x is not null and list_position(cs, x) = i), '|') else coalesce(array_to_string(list_filter(cs, lambda x: x is not null), '|'), '') end as categories from c""",
    "merge_status_changes": _VERSIONS + f""", c as (select entity_uuid, version, 0 as side, unnest({_CHANGES('old_content')}) as c, unnest(range(len({_CHANGES('old_content')}))) as i from n
union all select entity_uuid, version, 1, unnest({_CHANGES('content')}), unnest(range(len({_CHANGES('content')}))) from n),
k as (select *, row_number() over (partition by entity_uuid, version, side, c.scene_index order by i) as nth, max((side = 0)::int) over (partition by entity_uuid, version, c.scene_index) as had from c),
s as (select entity_uuid, version, string_agg(c.scene_index || ':' || c.event, '|' order by c.scene_index, side, i) as changes from k where side = 0 or (nth = 1 and had = 0) group by all)
select n.entity_uuid, n.version, coalesce(changes, '') as changes from n left join s using (entity_uuid, version)""",
    "taint_detect": CUR + """, r as (select entity_uuid, coalesce(tainted, false) as marked, concat_ws(', ', case when len(coalesce(aliases, [])) > 8 then 'aliases ' || len(aliases) end, case when length(coalesce(description, '')) > 800 then 'description ' || length(description) end) as reason from entities_)
select entity_uuid, reason <> '' as found, marked, reason from r where found or marked""",
    "label_cosine": """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e, list_transform(lead(embedding) over (partition by label order by vec_id), lambda x: x::double) as n from embeddings)
select vec_id, round(list_cosine_similarity(e, n), 6) as cosine, round(greatest(0, 1 - (1 - list_cosine_similarity(e, n)) / 2), 6) as certainty from v where n is not null""",
    "mention_fold": f"""with m as (select distinct * from mentions where {_VALUE('keyword')} not in ({_list(NO_KEYWORD)}) and not regexp_matches(trim(coalesce(keyword, '')), '{PLACEHOLDER}')),
g as (select novel_hash, vol_num, keyword, count(*)::int as mentions, coalesce(array_to_string(list_sort(list(distinct scene_index) filter (where scene_index > 0)), '|'), '') as appeared_in from m group by all),
t as (select novel_hash, vol_num, keyword, lower(trim(mention_type)) as ty, min((coalesce(scene_index, -1), coalesce(ordinal, -1), coalesce(mention_type, ''))) as place from m where trim(mention_type) <> '' group by all),
tl as (select novel_hash, vol_num, keyword, list(ty order by place) as types from t group by all),
a as (select novel_hash, vol_num, keyword, string_agg(distinct x, '|' order by x) as aliases from (select novel_hash, vol_num, keyword, unnest(aliases) as x from m) group by all),
c as (select novel_hash, vol_num, keyword, string_agg(distinct x, '|' order by x) as categories from (select novel_hash, vol_num, keyword, unnest(categories) as x from m union all select novel_hash, vol_num, keyword, unnest(types[2:]) from tl) group by all)
select g.novel_hash, g.vol_num, g.keyword, types[1] as entity_type, coalesce(aliases, '') as aliases, coalesce(categories, '') as categories, appeared_in, mentions
from g left join tl using (novel_hash, vol_num, keyword) left join a using (novel_hash, vol_num, keyword) left join c using (novel_hash, vol_num, keyword)""",
    "boundary_fold_cap": _fold(0, True),
    "fragment_merge": _fold(128, False),
    "boundary_decisions": CUR + f""", p as (select chunk_uuid, coalesce(content, '') as content, lag(coalesce(content, '')) over (partition by novel_hash, vol_num order by scene_index) as before from chunks_),
t as (select chunk_uuid, list_distinct({_tokens('right(before, 400)')}) as a, list_distinct({_tokens('left(content, 400)')}) as b from p where before is not null)
select chunk_uuid, coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0) >= 0.05, true) as together from t""",
    "extract_mentions": CUR + f""", n as (select novel_hash, vol_num, scene_index, unnest(regexp_extract_all(content, '{NAME}')) as keyword, content from chunks_ where content is not null),
k as (select * from n where {_VALUE('keyword')} not in ({_list(NO_KEYWORD)}) and not regexp_matches(keyword, '{PLACEHOLDER}'))
select novel_hash, vol_num, keyword, count(distinct scene_index) as scenes, count(*) as times from k group by all""",
    "merge_decisions": _GATE + ", b as (select * from s qualify row_number() over (partition by mention_id order by round(score, 9) desc, entity_uuid) = 1) select mention_id, case when rule <= 2 then 0 else -1 end as selected_index, case when rule <= 2 then entity_uuid end as entity_uuid from b",
    "entity_slim": CUR + """, j as (select *, content::json as j from entities_) select entity_uuid, coalesce(nullif(j->>'$.keyword', ''), keyword, '') as keyword, coalesce(nullif(j->>'$.type', ''), entity_type, '') as type,
  md5(coalesce(nullif(j->>'$.description', ''), description, '')) as description,
  coalesce(array_to_string(list_filter(case when json_array_length(j, '$.aliases') > 0 then (j->'$.aliases')::varchar[] else coalesce(aliases, []) end, lambda x: x is not null), '|'), '') as aliases,
  coalesce(array_to_string(list_filter(case when json_array_length(j, '$.categories') > 0 then (j->'$.categories')::varchar[] else coalesce(categories, []) end, lambda x: x is not null), '|'), '') as categories from j""",
    "tenants": "select folder, substr(md5(folder), 1, 8) as hash from novels",
    "volume_prune": CUR + " select novel_hash, count(*) as scenes from chunks_ where vol_num between 1 and 4 group by all",
}
