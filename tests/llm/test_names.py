import random
from itertools import combinations

from pyspark.sql import functions as F

from scenograph.llm.components import components
from scenograph.llm.names import _body, _class_word, _one_edit, forms, linked_pairs, linked_rows, radius_join

SCHEMA = "id string, grp string, type string, keyword string, aliases array<string>, entity string"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_radius_join_finds_every_pair(spark):
    rnd = random.Random(2)
    rows = []
    for g in ("a", "b"):
        words = {"".join(rnd.choices("abc", k=rnd.randint(3, 7))) for _ in range(120)}
        long = ["".join(rnd.choices("abc", k=k)) for k in (60, 64, 65, 66, 67, 68, 70, 90)]
        for w in long:  # long names, about where their cells change, with up to three edits
            for _ in range(4):
                x = list(w)
                for _ in range(rnd.randint(1, 3)):
                    k = rnd.randrange(len(x))
                    x[k : k + 1] = rnd.choice(["", "a", "b" + x[k], x[k] + "c"])
                words.add("".join(x))
        rows += [(g, "s", w, rnd.random() < 0.7) for w in sorted(words)]
    df = spark.createDataFrame(rows + rows[:5], "grp string, space string, key string, found boolean")
    for r in (1, 2):
        got = {(x.grp, x.a, x.b): x.distance for x in radius_join(df, F.lit(r)).collect()}
        expected = {(g, a, b): d for g, _, a, _ in rows for h, _, b, found in rows if g == h and a != b and found and (d := levenshtein(a, b)) <= r}
        assert got == expected and len(expected) > 50
    assert radius_join(df.where("false"), F.lit(1)).count() == 0


def test_one_edit():
    for a, b in (("abc", "abd"), ("abc", "ab"), ("abc", "acb"), ("abc", "xabc"), ("abc", "abc")):
        assert _one_edit(a, b) and _one_edit(b, a)
    assert not _one_edit("abc", "cba") and not _one_edit("abcd", "badc")


def test_components(spark):
    edges = [("a", "b"), ("c", "b"), ("d", "c"), ("x", "y"), ("z", "z")] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "p string, q string")).collect()}
    assert {got[k] for k in "abcd"} == {"a"} and {got["x"], got["y"]} == {"x"} and got["z"] == "z"
    assert {v for k, v in got.items() if k[0] == "p"} == {"p000"}


def groups(spark, rows, with_pairs=False):
    df = spark.createDataFrame([(str(i), g, t, k, a, None) for i, (g, t, k, a) in enumerate(rows)], SCHEMA)
    out = linked_rows(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.entity, set()).add(int(r.id))
    assert sum(len(s) for s in by.values()) == len({r.id for r in out})
    if with_pairs:
        pairs = {tuple(sorted((int(r.a), int(r.b)))) for r in linked_pairs(df).collect()}
        assert pairs == {p for s in by.values() for p in combinations(sorted(s), 2)}
    return {frozenset(s) for s in by.values() if len(s) > 1}, {i for s in by.values() for i in s}


def test_people_and_organisations(spark):
    v = "n|1"
    rows = [
        (v, "character", "Dorothea Chelbrugrave", None),  # 0
        (v, "Character", "Chelbrugrave, Dorothea", []),  # 1 reordered
        (v, "character", "Dr. Dorotea Chelbrugrave", [None, ""]),  # 2 title, slip
        (v, "unknown", "D.Chelbrugrave", []),  # 3 initial
        (v, "character", "Old Dolly", ["dorothea chelbrugrave"]),  # 4 short name with full alias
        (v, "character", "Everard Chelbrugrave", ["the Captain"]),  # 5 of the family
        (v, "character", "Isadora Morfiquist", ["the Captain"]),  # 6 title shared only
        (v, "character", "Ｉsadora​ Morf iquist", None),  # 7 odd characters, split
        ("n|2", "character", "Dorothea Chelbrugrave", None),  # 8 another volume
        (v, "character", "戚如琴", None),  # 9
        (v, "character", "戚 如琴將軍", None),  # 10
        (v, "character", "小琴", ["戚如琴"]),  # 11
        (v, "character", "戚如海", None),  # 12 of the family
        (v, "concept", "Order of the Umber Bell", None),  # 13
        (v, "concept", "Umber Bell, Order of the", None),  # 14
        (v, "concept", "Ord. of hte Umber Bell", None),  # 15
        (v, "concept", "OUB", None),  # 16
        (v, "concept", "溺水獵鷹教團", None),  # 17
        (v, "concept", "溺獵教團", None),  # 18
        (v, "concept", "Iskjeeli Style", None),  # 19
        (v, "concept", "Iskjeeli Style", None),  # 20
        (v, "location", "Dorothea Chelbrugrave", None),  # 21
        (v, "character", "N/A", ["Dorothea Chelbrugrave"]),  # 22
        (v, "character", None, ["Dorothea Chelbrugrave"]),  # 23
        (v, "character", "角色3", None),  # 24
        (v, None, "Isadora Morfiquist", None),  # 25
        (v, None, "Brandoli Downs", None),  # 26
        (v, None, "Brandoli Downs", None),  # 27
        (v, "character", "Isadora Chelbrugrave", None),  # 28
        (v, "character", "x" * 20000 + " Long", None),  # 29
    ]
    linked, named = groups(spark, rows, with_pairs=True)
    assert linked == {frozenset({0, 1, 2, 3, 4}), frozenset({6, 7, 25}), frozenset({9, 10, 11}), frozenset({13, 14, 15, 16}), frozenset({17, 18})}
    assert not named & {19, 20, 21, 22, 23, 24, 26, 27}


def test_known_words_are_no_slips_and_ambiguous_initials_stay_apart(spark):
    rows = []
    for g in range(6):
        rows += [(f"n|{g}", "concept", "Order of the Umber Bell", None), (f"n|{g}", "concept", "Order of the Amber Bell", None)]
    rows += [("m|1", "character", "Dorothea Vasnova", None), ("m|1", "character", "Desmond Vasnova", None), ("m|1", "character", "D. Vasnova", None)]
    linked, _ = groups(spark, rows)
    assert linked == set()


def test_repeated_slips_and_copies_are_no_known_words(spark):
    people = [f"{a * 5}{b * 4}" for a in "bcdfghjklmnpqrs" for b in "tvwx"]
    rows = [(f"n|{i}", "character", f"Hezekiah {s}", None) for i, s in enumerate(people)]
    rows += [(f"n|{i}", "character", f"Hezeeiah {people[i]}", None) for i in range(5)]  # one slip, five times
    rows += [(f"o|{g}", "character", f"Josephine {people[g]}", None) for g in range(6)]
    rows += [("o|0", "character", f"Josephin {people[0]}", None)] * 6  # a slip in copies of one row
    linked, _ = groups(spark, rows, with_pairs=True)
    assert linked == {frozenset({i, 60 + i}) for i in range(5)} | {frozenset({65, *range(71, 77)})}


def test_signs_and_nicknames_need_a_share(spark):
    rows = [(f"n|{g}", "character", "柳白國", ["柳白藥"]) for g in range(2)] + [(f"o|{g}", "character", f"{chr(0x5F20 + g)}千{s}", None) for g in range(100) for s in "國藥"]
    rows += [(f"p|{g}", "character", "Augustine Mordomark", ["Gus Mordomark"]) for g in range(1)] * 3  # copies of one person
    rows += [(f"q|{g}", "character", f"Augustine {'abcdefghijklmn'[g] * 9}", None) for g in range(14)]
    rows += [("m|1", "character", "Gus Stenvale", None), ("m|1", "character", "Augustine Stenvale", None), ("m|1", "character", "宋千國", None), ("m|1", "character", "宋千藥", None)]
    linked, _ = groups(spark, rows)
    assert linked == {frozenset({202, 203, 204})}


def test_mined_nicknames_and_signs(spark):
    rows = [(f"n|{g}", "character", "Augustine Mordomark", ["Gus Mordomark"]) for g in range(3)]
    rows += [(f"o|{g}", "character", f"Augustine {'abcdefghijklmn'[g] * 9}", None) for g in range(14)]
    rows += [(f"n|{g}", "character", "柳白璃", ["柳白離"]) for g in range(3)]
    rows += [("m|1", "character", "Gus Stenvale", None), ("m|1", "character", "Augustine Stenvale", None), ("m|1", "character", "宋千璃", None), ("m|1", "character", "宋千離", None), ("m|1", "character", "宋千河", None)]
    linked, _ = groups(spark, rows, with_pairs=True)
    assert linked == {frozenset({20, 21}), frozenset({22, 23})}


def test_short_class_words_are_read_by_rule():
    for t, french, want in (("gld", False, "guild"), ("acad", True, "academie"), ("acad", False, "academy"), ("ord", True, "ordre"), ("cmpy", False, "company"), ("cie", True, "compagnie"), ("socy", False, "society"), ("guld", False, "guild"), ("bell", False, "bell"), ("brother", False, "brother")):
        assert _class_word(t, french) == want
    assert _body("Tad Corwin".lower(), sure=False) == []
    key = lambda s: _body(s)[0][1]
    assert key("ordre dl plumier sale") == key("plumier sale, ordre du") == key("ord. du plumier sale")


def test_forms_of_blank_names():
    for name in ("", "  ", "None", "角色 12", "未知", "?"):
        assert forms(name, "P", set()) == []
    assert forms("the Captain", "P", set()) == [] and forms("Hound of Elsnopu", "P", set()) == []
