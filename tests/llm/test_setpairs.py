import random
from itertools import combinations

from scenograph.llm.setpairs import linked_classes, similar_rows, trees_needed, value_sets
from scenograph.llm.terms import plain

SCHEMA = "id string, tags array<string>, more array<string>, key string, values string"


def data(seed, n, hot=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.5:
            base = list(rnd.choice(rows)[1] or [])
            if base and rnd.random() < 0.8:
                base[rnd.randrange(len(base))] = f"t{rnd.randrange(40)}"
            if rnd.random() < 0.3:
                base = [x.upper() for x in base]
        else:
            base = [f"t{rnd.randrange(200)}" for _ in range(rnd.randrange(3, 10))]
        rows.append((f"e{i:04}", base, ["magic", "human", "noble"] if hot else [" Magic ", None, ""], "k", "v"))
    rows += [("null", None, None, None, None), ("empty", [], [], None, None), (None, ["a"] * 6, [], None, None)]
    return rows


def brute(rows, threshold=0.6, least=5):
    sets = [(r[0], {plain(v) for x in r[1:3] if x for v in x if v and plain(v)}) for r in rows if r[0]]
    sets = [x for x in sets if len(x[1]) >= least]
    out = {}
    for (a, s), (b, t) in combinations(sets, 2):
        i = len(s & t)
        if i * 10 >= 6 * len(s | t):
            out[min(a, b), max(a, b)] = i / len(s | t)
    return out


def test_pairs_against_brute_force(spark):
    for seed, hot in ((1, False), (2, True)):
        rows = data(seed, 250, hot)
        expected = brute(rows)
        assert len(expected) > 50 and any(abs(v - 0.6) < 1e-9 for v in expected.values())
        df = spark.createDataFrame(rows, SCHEMA)
        out = similar_rows(df, "id", ["tags", "more"], small=8).collect()
        got = {(r.key_a, r.key_b): r.similarity for r in out}
        assert len(got) == len(out) and got.keys() == expected.keys()
        assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_used_up_sets_still_meet(spark):
    # all sets share their tokens, so no node is ever small
    rows = [(f"e{i}", [f"t{k}" for k in range(5)] + ([f"u{i}"] if i else []), None, None, None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert similar_rows(df, "id", ["tags"], small=4, most_depth=3).count() == 60 * 59 // 2


def test_classes_and_empty(spark):
    rows = [(f"e{i}", list("abcde"), None, None, None) for i in range(5)] + [("f", list("abcdf"), None, None, None), ("g", list("vwxyz"), None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.key: (r.class_id, r.links) for r in linked_classes(df, "id", ["tags"]).collect()}
    assert got == {f"e{i}": ("e0", 1) for i in range(5)} | {"f": ("f", 1), "g": ("g", 0)}
    assert similar_rows(df.where("false"), "id", ["tags"]).count() == 0
    assert {r.key: r["values"] for r in value_sets(df.limit(1), "id", ["key"]).collect()} == {"e0": []}
    assert trees_needed(0.6, 2, 2, 0.9999) < 12


def test_deep_nodes_lose_no_pair(spark):
    # sets of six beside sets of ten with four values more, similar by 0.6 exactly; all values are common, so nodes stay large far down
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        ten = rnd.sample([f"t{k:02}" for k in range(22)], 10)
        rows += [(f"a{i:03}", ten, None, None, None), (f"b{i:03}", ten[:6], None, None, None)]
    expected = brute(rows)
    assert sum(abs(v - 0.6) < 1e-9 for v in expected.values()) >= 300
    got = {(r.key_a, r.key_b) for r in similar_rows(spark.createDataFrame(rows, SCHEMA), "id", ["tags"], small=4).collect()}
    assert got == expected.keys()
