from collections import Counter

from scenograph.llm.terms import partial_counts, plain, radix_partitions, term_frequencies

ROWS = [(["Magic", " magic ", None, ""], "Person"), (["ＭＡＧＩＣ", "war"], None), (None, "person"), ([], ""), (["a  b", "a b"], "person")] * 3
SCHEMA = "tags array<string>, kind string"


def brute(rows, i):
    occ, rec = Counter(), Counter()
    for r in rows:
        values = r[i] if isinstance(r[i], list) else [r[i]]
        got = [plain(v) for v in values if plain(v)]
        occ.update(got)
        rec.update(set(got))
    return occ, rec


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = term_frequencies(df, {"tags": "tags", "kind": "kind"}, **how).collect()
    got = {(r.field, r.term): (r.occurrences, r.records, r.mark) for r in out}
    assert len(got) == len(out)
    expected = {}
    for i, f in enumerate(("tags", "kind")):
        occ, rec = brute(rows, i)
        for t in occ:
            expected[f, t] = (occ[t], rec[t], "rare" if rec[t] < 3 else "common" if rec[t] > 0.1 * len(rows) else None)
    assert got == expected


def test_counts(spark):
    check(spark, ROWS)


def test_splitting_changes_nothing(spark):
    rows = ROWS + [([f"t{i % 97}", f"u{i % 11}"], f"k{i % 5}") for i in range(300)]
    check(spark, rows, bits=2, most_rows=20)


def test_hot_term_and_empty_table(spark):
    check(spark, [(["hot"], "hot")] * 500 + [(["cold"], None)], bits=3, most_rows=1)
    assert term_frequencies(spark.createDataFrame([], SCHEMA), {"tags": "tags"}).count() == 0


def test_partitions_split_twice_and_fit(spark):
    rows = [([f"t{i}"], f"k{i}") for i in range(400)]
    partials = partial_counts(spark.createDataFrame(rows, SCHEMA), {"tags": "tags"}).where("field is not null")
    split, n = radix_partitions(partials, bits=2, most_rows=30)
    sizes = {r["_p"]: r["count"] for r in split.groupBy("_p").count().collect()}
    assert len(sizes) == n and max(sizes.values()) <= 30 and sum(sizes.values()) == 400
    assert max(int(p[0]) for p in sizes) >= 1
    split, _ = radix_partitions(partials, bits=1, most_rows=60)
    assert max(int(r["_p"][0]) for r in split.select("_p").distinct().collect()) >= 2
    check(spark, rows, bits=1, most_rows=60)
