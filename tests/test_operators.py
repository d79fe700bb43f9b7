from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scenograph.config import Settings
from scenograph.operators import agent, catalog, links, merge, process, ranking, retrieval, scenes, scoring, summary
from scenograph.sources import keyvalue, volumes
from scenograph.tables import current_rows

T = datetime(2024, 1, 1)


def test_gate_rules(spark):
    cases = [("anna", "bob", 0.75, 0.0, 1), ("anna", "hanna", 0.62, 0.0, 2), ("anna", "hanna", 0.61, 0.10, 3), ("xyz", "bob", 0.62, 0.35, 4), ("xyz", "bob", 0.62, 0.34, None), ("a b", "c d", 0.7, 0.1, None), (None, "a", 0.74, 0.3, None)]
    df = spark.createDataFrame(cases, "a string, b string, i double, c double, want int")
    rule, score = retrieval.gate(retrieval.literal_overlap("a", "b"), F.col("i"), F.col("c"))
    for r in df.select("*", rule.alias("rule"), score.alias("score")).collect():
        assert r.rule == r.want and r.score == (None if r.want is None else r.i if r.want <= 2 else r.c)


def test_near_vectors_against_all_pairs(spark):
    import numpy as np

    m = np.random.default_rng(1).normal(size=(60, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "row_id long, vec array<double>").repartition(3)
    q = rows.where("row_id % 10 = 0").select(F.col("row_id").alias("query_id"), "vec")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    expected = {}
    for i in range(0, 60, 10):
        c = unit @ unit[i]
        c[i] = -9
        expected[i] = np.argsort(-c)[:5].tolist()
    for block in (2, 100):
        got = {}
        for r in retrieval.near_vectors(q, rows, 5, block).orderBy("query_id", F.desc("certainty")).collect():
            got.setdefault(r.query_id, []).append(r.row_id)
        assert got == expected
    assert retrieval.near_vectors(q.where("false"), rows).count() == 0


def test_merge_rules(spark):
    df = spark.createDataFrame(
        [("Anna", "Ann", ["x"], ["y", None], "object", "character"), ("未知人物", "Ann", None, ["y"], "", "character"), (None, "Ann", None, None, None, None)],
        "o string, n string, oa array<string>, na array<string>, ot string, nt string",
    )
    got = df.select(merge.canonical_name("o", "n"), merge.merged_aliases("oa", "na", "o", "n"), merge.locked_type("ot", "nt"), merge.categories_after_lock("na", "ot", "nt")).collect()
    assert [tuple(r) for r in got] == [("Anna", ["Ann", "x", "y"], "object", ["y", None, "character"]), ("Ann", ["y"], "character", ["y"]), ("", ["Ann"], None, [])]


def test_status_changes_keep_old_and_first_new(spark):
    c = "array<struct<scene_index:int,event:string>>"
    df = spark.createDataFrame([([(5, "a"), (2, "b")], [(5, "c"), (3, "d"), (3, "e")]), (None, [(1, "x")]), (None, None)], f"o {c}, n {c}")
    got = [[tuple(x) for x in r[0]] for r in df.select(merge.merged_changes("o", "n")).collect()]
    assert got == [[(2, "b"), (3, "d"), (5, "a")], [(1, "x")], []]


def test_taint_is_strict(spark):
    df = spark.createDataFrame([(8, 800, 0.75), (9, 800, 0.75), (8, 801, 0.75), (8, 800, 0.7449), (9, 801, 0.1)], "a int, d int, c double")
    bad, reason = merge.taint(F.array_repeat(F.lit("x"), F.col("a")), F.repeat(F.lit("x"), F.col("d")), F.col("c"))
    assert [tuple(r) for r in df.select(bad, reason).collect()] == [(False, ""), (True, "aliases 9"), (True, "description 801"), (True, "cosine 0.74"), (True, "aliases 9, description 801, cosine 0.10")]


def test_fold_pieces(spark):
    def run(sizes, joins, **how):
        df = spark.createDataFrame([("v", i, t, j) for i, (t, j) in enumerate(zip(sizes, joins))], "k string, i int, t int, j boolean")
        return [(r["first"], r.pieces, r.tokens) for r in scenes.fold_pieces(df, ["k"], ["i"], "t", "j", **how).orderBy("scene_index").collect()]

    assert run([10, 20, 30, 40], [True] * 4, cap=60, floor=0) == [(0, 3, 60), (3, 1, 40)]
    assert run([10, 20], [True, None], cap=60, floor=0) == [(0, 2, 30)]
    assert run([200, 5, 300, 7], [False] * 4, floor=10) == [(0, 2, 205), (2, 2, 307)]
    assert run([5, 300, 300], [False] * 3, floor=10) == [(0, 2, 305), (2, 1, 300)]
    assert run([5], [False], floor=10) == [(0, 1, 5)]


def test_semantic_pieces_lose_nothing(spark):
    text = "The bell rang. 雨落在港灣。他走了！" * 5 + "\nA new court sat.\nThe verdict fell.\n"
    df = spark.createDataFrame([(1, text), (2, "one"), (3, "")], "id int, t string")
    got = {}
    for r in scenes.semantic_pieces(df, ["id"], "t").orderBy("id", "piece").collect():
        got[r.id] = got.get(r.id, "") + r.piece_text
    assert got == {1: text, 2: "one"}


def test_links(spark):
    chunks = spark.createDataFrame([("c1", "n", 1, 1, "t1", ["e1", "e2", "e1"], T), ("c2", "n", 1, 2, "t2", None, T)], "chunk_uuid string, novel_hash string, vol_num int, scene_index int, title string, entity_refs array<string>, written_at timestamp")
    entities = spark.createDataFrame([("e1", "n", 1, "k1", ["c1", "c2"], [2, 9, 1]), ("e2", "n", 1, "k2", [], None)], "entity_uuid string, novel_hash string, vol_num int, keyword string, chunk_refs array<string>, appeared_in array<int>")
    assert {tuple(r) for r in links.to_entities(chunks, entities).collect()} == {("c1", 0, "e1", "k1"), ("c1", 1, "e2", "k2")}
    assert {tuple(r) for r in links.consistency(chunks, entities).collect()} == {("c1", "e2", "chunk"), ("c2", "e1", "entity")}
    assert {tuple(r) for r in links.previews(entities, chunks).collect()} == {("e1", 0, 2, "t2"), ("e1", 2, 1, "t1")}
    assert {r.chunk_uuid: r.entity_refs for r in links.backfill(chunks, entities).collect()} == {"c1": ["e1"], "c2": ["e1"]}
    twice = links.upsert(links.upsert(chunks, chunks.where("scene_index = 1"), "chunk_uuid", "entity_refs"), chunks.where("scene_index = 1"), "chunk_uuid", "entity_refs")
    assert {r.chunk_uuid: r.entity_refs for r in twice.collect()} == {"c1": [], "c2": None}
    rows = chunks.unionByName(chunks.withColumn("title", F.lit("old")).withColumn("written_at", F.lit(datetime(2023, 1, 1))))
    assert {r.title for r in current_rows(rows, "chunk_uuid", ["title"]).collect()} == {"t1", "t2"}


def test_catalog(spark):
    c = spark.createDataFrame([("n", 1), ("n", 1), ("n", 2)], "novel_hash string, vol_num int")
    e = spark.createDataFrame([("n", None, True), ("m", "x", False), ("n", None, None)], "novel_hash string, entity_type string, tainted boolean")
    t = spark.createDataFrame([], "novel_hash string, title string")
    (row,) = catalog.list_novels(c, e, t).collect()
    assert (row.novel_hash, row.title, [tuple(v) for v in row.vols], row.scene_count, row.entity_count) == ("n", "untitled", [(1, 2), (2, 1)], 3, 2)
    assert {tuple(r) for r in catalog.profile_types(e).collect()} == {("n", "unknown", 1), ("m", "x", 1)}


def test_question_loop(spark):
    rows = [("q", 0, "human", None, "x" * 20), ("q", 1, "ai", None, ""), ("q", 2, "tool", "find", "y" * 100), ("q", 3, "ai", None, ""), ("q", 4, "tool", "find", None)]
    m = spark.createDataFrame(rows, "conversation string, pos int, role string, name string, content string")
    routes = {r.pos: r.route for r in agent.progress(m, context=80).collect()}
    assert routes == {0: None, 1: "tool", 2: None, 3: "answer", 4: None}
    assert agent.gate_position(m, context=80).first().pos == 3 and agent.gate_position(m).first().pos is None
    assert [tuple(r) for r in agent.trailing_notes(m).collect()] == [("q", 4, "[find] ")]
    turns = spark.createDataFrame([("c", 2, "q?", ["a", "b"], None)], "conversation string, turn int, question string, notes array<string>, answer string")
    assert [(r.pos, r.role, r.name, r.content) for r in agent.packed_history(turns).orderBy("pos").collect()] == [(4, "human", None, "q?"), (5, "ai", "retrieved_notes_turn_2", ""), (6, "tool", "retrieved_notes_turn_2", "a\n\nb"), (7, "ai", None, "")]
    steps = iter([("find", {}), None])
    out = agent.answer_loop("who", lambda q, n: next(steps), {"find": lambda: turns.select("question")}, lambda q, n: f"{len(n)} notes")
    assert out["answer"] == "1 notes" and out["notes"] == ['[find] {"question":"q?"}'] and out["iterations"] == 2


def test_summary(spark):
    s = spark.createDataFrame([("n", 1, 2, "two\nlines", 1), ("n", 1, 1, "one", 1), ("n", 1, 3, " ", 1)], "novel_hash string, vol_num int, scene_index int, content string, token_count int")
    state = spark.createDataFrame([("n", 1, [1])], "novel_hash string, vol_num int, updated_scenes array<int>")
    assert [r.scene_index for r in summary.pending(s, state).collect()] == [2]
    e = spark.createDataFrame([("e1", "n", 1, "character", "A", [1], None), ("e2", "n", 1, "character", "B", [1, 2], None), ("e3", "n", 1, "location", "L", [1], None), ("e4", "n", 1, "character", "T", [1, 2, 3], True)], "entity_uuid string, novel_hash string, vol_num int, entity_type string, keyword string, appeared_in array<int>, tainted boolean")
    whole = summary.fold(s.where("trim(content) <> ''"), e)
    r = summary.compact(whole, s).first()
    assert (r.updated_scenes, r.outline, r.protagonist, r.main_characters, r.key_locations, r.compacted) == ([1, 2], "one → two lines", "B", ["A"], ["L"], True)
    assert summary.compact(summary.fold(s.where("scene_index = 1"), e), s).first().compacted is False


def test_sources(spark, tmp_path):
    (tmp_path / "novel").mkdir()
    (tmp_path / "novel" / "vol2.txt").write_bytes("a\r\nb".encode())
    (tmp_path / "novel" / "vol10.txt").write_bytes("第一章".encode())
    got = {(r.folder, r.vol_num, r.text) for r in volumes.read_volumes(spark, str(tmp_path)).collect()}
    assert got == {("novel", 2, "a\nb"), ("novel", 10, "第一章")}
    assert [r.vol_num for r in volumes.list_volumes(spark, str(tmp_path), 3, 20).collect()] == [10]
    base = str(tmp_path / "kv")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    keyvalue.put(df, base, ["k"])
    keyvalue.put(df.where("k = 2").withColumn("v", F.lit("c")), base, ["k"])
    assert {tuple(r) for r in keyvalue.get(spark, base, df.schema).select("k", "v").collect()} == {(1, "a"), (2, "c")}
    assert keyvalue.get(spark, base, df.schema, k=1).count() == 1 and keyvalue.get(spark, base + "-none", df.schema).count() == 0
    assert [r.k for r in keyvalue.list_keys(spark, base, df.schema, ["k"]).collect()] == [1, 2]


def test_extraction_and_decisions(spark):
    from scenograph.operators import extraction

    s = spark.createDataFrame([("n", 1, 1, "He met Anna Lorne. Anna Lorne left.\nRain fell on Zoé Pell."), ("n", 1, 2, None)], "novel_hash string, vol_num int, scene_index int, content string")
    got = {(r.keyword, r.times, r.context_summary) for r in extraction.extract_mentions(s).collect()}
    assert got == {("Anna Lorne", 2, "He met Anna Lorne."), ("Zoé Pell", 1, "Rain fell on Zoé Pell.")}
    c = spark.createDataFrame([("m", "e2", 3, 0.9), ("m", "e1", 1, 0.95), ("k", "e1", 3, 0.5)], "mention_id string, entity_uuid string, rule int, score double")
    assert {tuple(r) for r in extraction.decide(c).collect()} == {("m", 0, "e1"), ("k", -1, None)}
    seams = spark.createDataFrame([("the bell rang", "a bell fell", True), ("a b c", "x y z", False), ("", "", True)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in seams.select("want", extraction.together("a", "b").alias("got")).collect())
    e = spark.createDataFrame([("u", '{"keyword": "K", "aliases": [], "description": ""}', "C", ["a"], None, "t", "d")], "entity_uuid string, content string, keyword string, aliases array<string>, categories array<string>, entity_type string, description string")
    assert tuple(extraction.slim(e).first()) == ("u", "K", "t", "d", ["a"], [])
    assert extraction.shown(e.withColumn("_x", F.lit(1)).withColumn("uuid", F.lit(2))).columns == e.columns


def test_settings_tables_and_appearances(spark, tmp_path):
    from scenograph.config import Settings
    from scenograph.schemas import create_tables

    spark.conf.set("spark.scenograph.top_k", "7")
    assert Settings.of(spark) == Settings(top_k=7)
    spark.conf.unset("spark.scenograph.top_k")
    for _ in range(2):
        create_tables(spark, "layers", str(tmp_path / "db"))
    assert {r.tableName for r in spark.sql("show tables in layers").collect()} == {"chunks", "entities"}
    spark.sql("drop database layers cascade")
    df = spark.createDataFrame([([3], 5), ([3, 5], 5), (None, 5), ([3], 0)], "a array<int>, s int")
    assert [r[0] for r in df.select(links.append_scene("a", "s")).collect()] == [[3, 5], [3, 5], [5], [3]]


def test_taint_of_merges_under_another_name(spark, tmp_path):
    from scenograph.plans.knowledge import QUERIES

    names = {"a": ["Meteor Rain", "Lucid Dream"], "b": ["Old Harbour", " Old Harbour "], "c": ["Lucid Dream", None, "Meteor"], "d": ["old harbour town gate", "Old Harbour Town"], "e": ["Meteor Rain", "Meteor Rain", "rain METEOR"]}
    rows = [(u, i, k, ["x"], "person", [], "{}", "short") for u, each in names.items() for i, k in enumerate(each)] + [("f", 0, "Long", [], "person", [], "{}", "y" * 801)]
    df = spark.createDataFrame(rows, "entity_uuid string, written_at int, keyword string, aliases array<string>, entity_type string, categories array<string>, content string, description string")
    df.write.parquet(f"{tmp_path}/entities.parquet")
    got = {(r.entity_uuid, r.version): r.reason for r in QUERIES["taint_versions"](spark, str(tmp_path)).collect()}
    assert got == {("a", 2): "cosine 0.00", ("f", 1): "description 801"}


def test_cells_of_any_size_score_alike(spark, monkeypatch):
    words = ["bell", "song", "winter", "lantern", "quiet", "mist", "rain", "door"]
    text = lambda i: " ".join(words[(i * k) % 8] for k in range(1, 2 + i % 5))
    docs = spark.createDataFrame([(f"d{i:02}", "n" if i % 4 else "m", i % 3, "a" if i % 2 else None, text(i), f"name {words[i % 8]}") for i in range(40)] + [("e", "n", None, "a", None, None), ("x", None, 1, "a", "bell", "bell")], "key string, scope string, vol int, type string, text string, name string")
    asked = spark.createDataFrame([(f"q{i}", "n" if i % 2 else "m", i % 3, "a", text(i + 3), f"{words[i]} name") for i in range(8)] + [("z", "none", 1, "a", "bell", "bell"), ("y", "n", 1, None, "", None)], "key string, scope string, vol int, type string, text string, name string")
    ready = lambda df: scoring.prepared(df, "key", "scope", F.col("text"), F.col("text"), F.col("name"), F.col("vol"), F.col("type"))
    got = []
    for parts, block in ((4096, 1024), (7, 2)):
        monkeypatch.setattr(scoring, "DOCUMENTS", parts)
        monkeypatch.setattr(scoring, "QUESTIONS", block)
        got.append([sorted((r.qid, r.key, round(r.score, 9)) for r in df.collect()) for df in scoring.scored(ready(docs), ready(asked), 3)])
    assert got[0] == got[1] and len(got[0][0]) > 15 and len(got[0][1]) > 5
    assert not {q for q, _, _ in got[0][0] + got[0][1]} & {"z", "y"}
    assert [df.count() for df in scoring.scored(ready(docs.where("false")), ready(asked), 3)] == [0, 0]


def test_resumed_state(spark):
    s = spark.createDataFrame([("n", 1, 1, "one"), ("n", 1, 2, "two"), ("n", 2, 1, None), ("m", 1, 1, "x")], "novel_hash string, vol_num int, scene_index int, content string")
    empty = spark.createDataFrame([], "novel_hash string, vol_num int, updated_scenes array<int>, outline string, compacted boolean")
    show = lambda df: {(r.novel_hash, r.vol_num): (r.updated_scenes, r.outline, r.compacted) for r in df.collect()}
    first = summary.compacted(summary.resume(empty, s.where("scene_index = 2")), s)
    assert show(first) == {("n", 1): ([2], "two", False)}
    assert show(summary.compacted(summary.resume(first, s), s)) == {("n", 1): ([1, 2], "two → one", True), ("m", 1): ([1], "x", True)}
    assert show(summary.compacted(summary.resume(first, s), s, most=4))[("n", 1)] == ([1, 2], "two ", True)


MENTION = "novel_hash string, vol_num int, scene_index int, ordinal int, keyword string, aliases array<string>, categories array<string>, mention_type string, context_summary string"


def test_each_mention_sees_what_was_written_before(spark):
    rows = [
        ("n", 1, 1, 1, "Anna Berg", ["Annie"], ["cook"], "character", "She cooks."),  # 1
        ("n", 1, 1, 2, "Annie", ["The Spoon", None], None, "person", "She sings."),  # by the alias of the first
        ("n", 1, 1, 2, "Annie", ["The Spoon", None], None, "person", "She sings."),  # a copy
        ("n", 1, 2, 1, "the spoon", None, None, "character", "x" * 800),  # by the alias of the second; the description taints
        ("n", 1, 3, 1, "Anna Berg", None, None, "character", "She is back."),  # the tainted one is not found: new
        ("n", 2, 1, 1, "annie", None, None, "character", "Nobody."),  # the new one is not called so
        ("n", 2, 1, 2, "N/A", None, None, "character", "Nothing."),
        ("n", 2, 1, 3, "Bob", None, None, "character", "none"),
        ("m", 1, 1, 1, "Anna Berg", None, None, None, "Another novel."),
        (None, 1, 1, 1, "Anna Berg", None, None, None, "No novel."),
    ]
    df = spark.createDataFrame(rows, MENTION)
    steps = {r.mention_id: (r.entity, r.merged, r.tainted) for r in process.resolution_steps(df, process.ByName).collect()}
    assert steps == {"n:1:1:1": (1, False, False), "n:1:1:2": (1, True, False), "n:1:2:1": (1, True, True), "n:1:3:1": (2, False, False), "n:2:1:1": (3, False, False), "m:1:1:1": (1, False, False)}
    first = next(r for r in process.resolved_entities(df, process.ByName).collect() if r.novel_hash == "n" and r.entity == 1)
    assert (first.keyword, first.aliases, first.categories, first.appeared_in, first.mentions) == ("Anna Berg", ["Annie", "The Spoon"], ["cook", "person"], [1, 2], 3)
    assert first.reason.startswith("description 8") and len(first.chunk_refs) == 2
    assert process.resolution_steps(df.where("false")).count() == 0


def test_the_gate_merges_and_taints(spark):
    rows = [
        ("n", 1, 1, 1, "Anna Berg", None, None, "character", "She cooks in the harbour."),
        ("n", 1, 2, 1, "Anna Berg", None, None, "character", "She cooks again."),  # rule 1
        ("n", 1, 3, 1, "Anna", None, None, "character", "Who cooks?"),  # rule 1, names lie apart: cosine 0.71
        ("n", 1, 4, 1, "Quartz", None, None, "object", "A stone."),
    ]
    got = [(r.entity, r.merged, r.reason) for r in process.resolution_steps(spark.createDataFrame(rows, MENTION)).orderBy("mention_id").collect()]
    assert got == [(1, False, ""), (1, True, ""), (1, True, "cosine 0.71"), (2, False, "")]


def test_the_gate_holds_only_what_may_still_be_found():
    """Against a search that keeps every entity and filters tainted ones each time."""
    random = np.random.default_rng(7)
    words = [f"w{i}" for i in range(30)]
    name = lambda n: " ".join(random.choice(words, n))
    told = [process.Mention(str(i), 1, i, name(2), [name(2)] * (i % 3), [], f"t{i % 2}", name(12), "c") for i in range(400)]
    told += [process.Mention(str(i), 1, i, "lone", [], [], "t0", "x" * 801, "c") for i in range(50)]  # tainted when made
    told += [process.Mention("z", 1, 1, "lone", [], [], "t0", "again", "c")]  # so there is nothing to find
    s = Settings()

    class Every(process.ByGate):
        every: dict = {}

        def written(self, e):
            self.every[e.number] = e
            self.__init__(self.s)
            for x in self.every.values():
                super().written(x)

    runs = []
    for search in (process.ByGate(s), Every(s)):
        count, steps = 0, []
        for m in told:
            e, merged, candidates = process.step(m, search, count, s, True)
            count += not merged
            steps.append((e.number, merged, candidates, e.tainted))
        runs.append(steps)
        assert all(not e.tainted for e in search.entities) and len(search.entities) < count - 50
    assert runs[0] == runs[1] and any(m for _, m, _, _ in runs[0]) and not runs[0][-1][1]


def test_entities_leave_once(spark):
    rows = [(n, 1, i, 1, "Anna Berg", None, None, "character", "x" * (801 if i % 2 else 5)) for n in "abcdefgh" for i in range(1, 5)]
    df = spark.createDataFrame(rows, MENTION)
    got = sorted((r.novel_hash, r.entity, r.tainted, r.mentions) for r in process.resolved_entities(df).collect())
    assert got == sorted((n, *x) for n in "abcdefgh" for x in ((1, True, 1), (2, True, 2), (3, False, 1)))


def test_novels_are_spread_by_a_stated_number_of_tasks(spark):
    df = spark.createDataFrame([(n, 1, 1, 1, "Anna Berg", None, None, "character", "She cooks.") for n in "abcdefgh"], MENTION)
    assert process.resolution_steps(df).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ranks_are_exact_without_whole_lists(spark, monkeypatch):
    random = np.random.default_rng(3)
    words = [f"w{i}" for i in range(25)]
    some = lambda n: " ".join(random.choice(words, n))
    docs = spark.createDataFrame([(f"d{i:04}", "mn"[i % 2], some(i % 9), some(3 + i % 7)) for i in range(700)] + [("e", "n", None, None), ("x", None, "w1", "w1 w2")], "key string, scope string, text string, words string")
    asked = spark.createDataFrame([(f"q{i:02}", "mno"[i % 3], some(1 + i % 4)) for i in range(40)] + [("y", "n", "")], "query_id string, scope string, query_text string")
    vector = retrieval.sparse_near(asked, docs, ["scope"], ["key"], ["query_id"], "query_text", "text")
    keyword = retrieval.bm25(asked, docs, ["scope"], ["key"], ["query_id"], "query_text", "words")
    whole = retrieval.top_k(retrieval.ranked_fuse(vector, keyword, ["query_id", "key"], ["query_id"]), ["query_id"], [F.round("hybrid", 9).desc(), F.col("key")], 3)
    show = lambda df: sorted((r.query_id, r.key, round(r.hybrid, 9)) for r in df.collect())
    want = show(whole)
    for documents, questions in ((4096, 4096), (50, 7)):
        monkeypatch.setattr(ranking, "DOCUMENTS", documents)
        monkeypatch.setattr(ranking, "QUESTIONS", questions)
        assert show(retrieval.ranked_search(asked, docs, "key", "text", "words", 3, "scope")) == want
    assert len(want) > 70
    assert show(retrieval.ranked_search(asked, docs.where("false"), "key", "text", "words", 3, "scope")) == []
    plan = retrieval.ranked_search(asked, docs, "key", "text", "words", 3, "scope")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # no list is sorted whole


def test_open_ranks_are_counted():
    """Lists in opposite order, longer than what is kept: the best of one list is deep in the other."""
    n = 1000
    text, words = pa.ListArray.from_arrays(np.arange(0, 2, dtype=np.int32), pa.array([1], pa.int8())), pa.ListArray.from_arrays(np.arange(2, dtype=np.int32), pa.array([7], pa.int64()))
    asked = pa.RecordBatch.from_arrays([pa.array(["q"]), text, words, pa.ListArray.from_arrays(np.arange(2, dtype=np.int32), pa.array([1.0]))], names=["key", "text", "words", "idf"])
    keys = pa.array([f"d{i:04}" for i in range(n)])
    texts = pa.array([[1] * 10 + [2] * (i // 3) for i in range(n)], pa.list_(pa.int8()))  # falls, by threes
    docs = pa.RecordBatch.from_arrays([keys, texts, pa.array([[7]] * n, pa.list_(pa.int64())), pa.array([2 * n - i for i in range(n)], pa.int32())], names=["key", "text", "words", "length"])  # shorter is better: rises
    for size in (n, 64):
        out = ranking._cell(asked, (docs.slice(a, size) for a in range(0, n, size)), 4, 60, 1000.0, 1.2, 0.75)
        want = sorted((-round(1 / (61 + i) + 1 / (60 + n - i), 9), f"d{i:04}") for i in range(n))[:4]
        assert [(-round(s, 9), k) for k, s in zip(out.column("key").to_pylist(), out.column("score").to_pylist())] == want
