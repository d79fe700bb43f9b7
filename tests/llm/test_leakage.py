import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scenograph.llm import leakage
from scenograph.llm.leakage import Rule, leaked

DOCS, ITEMS = "doc_id long, text string, item_id long", "item_id long, passage string, text string"


def text_of(s):
    return "".join(map(chr, leakage.stream(pa.array([s]))[0].tolist()))


def brute(docs, items, words=13, han=24):
    out = set()
    for i, p in items:
        s = text_of(p)
        zh = sum("一" <= c <= "鿿" for c in s) * 2 > len(s)
        a = s if zh else s.split(" ")
        n = han if zh else words
        grams = {tuple(a[k : k + n]) for k in range(len(a) - n + 1)}
        for d, t in docs:
            u = text_of(t)
            b = u if zh else u.split(" ")
            if any(tuple(b[k : k + n]) in grams for k in range(len(b) - n + 1)):
                out.add((d, i))
    return out


def test_stream_form():
    assert text_of("Ｈello, WORLD!\n文，字​。 l'été") == "hello world 文字 l été"
    assert text_of("") == "" and text_of(None) == "" and text_of(" .. ") == ""


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = ["a", "the", "bell", "song", "winter", "lantern", "zorvemaorel", "quiet", "of", "it"]
    han = "之下羽毛變得陌生走了把河帶過門睡著時硬幣旁低鳴只有能讓打開地圖"
    items = [(i, " ".join(rnd.choices(vocabulary, k=30))) for i in range(6)] + [(i, "".join(rnd.choices(han, k=60))) for i in range(6, 10)] + [(10, "too short"), (11, None), (12, "")]
    docs = []
    for d in range(60):
        i = rnd.randrange(10)
        p = items[i][1]
        parts = p.split(" ") if i < 6 else list(p)
        k = rnd.choice([12, 13, 14, 23, 24, 25])
        at = rnd.randrange(0, max(1, len(parts) - k))
        piece = (" , " if i < 6 else "，").join(parts[at : at + k])
        docs.append((d, " ".join(rnd.choices(vocabulary, k=20)) + " " + piece.upper() + rnd.choice(["", "x", " end", "。"])))
    docs += [(100, items[0][1] + " " + "noise words " * 50000), (101, None), (102, ""), (0, docs[0][1])]
    expected = brute([x for x in docs if x[1]], [x for x in items if x[1]])
    assert expected
    a = spark.createDataFrame([(d, t, 7) for d, t in docs], DOCS)
    b = spark.createDataFrame([(i, p, "z") for i, p in items + items[:1]], ITEMS)
    for rule in (Rule(), Rule(block_chars=100)):
        got = [tuple(r) for r in leaked(a, b, rule=rule).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    assert leaked(a.where("false"), b).count() == 0 and leaked(a, b.where("false")).count() == 0


def test_edit_budget(spark):
    p = "under jhulemaian the mirror turned cold so jhulemaamar left before the restless evening bell rang again twice"
    near = p.replace("turned", "turnd")
    a = spark.createDataFrame([(1, p, 0), (2, near, 0), (3, p[:30], 0)], DOCS)
    b = spark.createDataFrame([(1, p, "")], ITEMS)
    rule = Rule(words=17, q=8, edits=1)
    assert {r.doc_id for r in leaked(a, b, rule=rule, exact=False).collect()} == {1, 2}
    assert {r.doc_id for r in leaked(a, b, rule=Rule(words=17, q=8)).collect()} == {1}


def within(doc, window, edits):
    """Whether some part of doc is at most so many edits from window."""
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(window, 1):
        last, row = row, [i]
        for j, y in enumerate(doc, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return min(row) <= edits


def test_one_edit_against_brute_force(spark):
    rnd = random.Random(5)
    words = ["a", "bell", "song", "lantern", "quiet", "of", "it", "zorve", "mist"]
    line = "read the passage and answer the question that follows it now please"
    items = [(i, line + " " + " ".join(rnd.choices(words, k=22))) for i in range(24)]  # more passages share the line than a posting list is read for
    docs = [(900, line), (901, line + " " + line)]
    for d in range(80):
        p = items[rnd.randrange(24)][1].split(" ")
        at = rnd.randrange(12, 22)
        piece = list(" ".join(p[at : at + rnd.randint(8, 13)]))
        for _ in range(rnd.randint(0, 2)):
            k = rnd.randrange(len(piece))
            piece[k : k + 1] = rnd.choice(["", "x", piece[k] + "y"])
        docs.append((d, "before this " + "".join(piece) + " and after"))
    rule = Rule(words=9, edits=1)
    expected = set()
    for i, p in items:
        starts = [0, *[k + 1 for k, c in enumerate(p) if c == " "], len(p) + 1]
        length = min(b - 1 - a for a, b in zip(starts, starts[9:]))
        windows = {p[k : k + length] for k in range(len(p) - length + 1)}
        expected |= {(d, i) for d, t in docs if any(within(text_of(t), w, 1) for w in windows)}
    a, b = spark.createDataFrame([(d, t, 0) for d, t in docs], DOCS), spark.createDataFrame([(i, p, "") for i, p in items], ITEMS)
    got = {tuple(r) for r in leaked(a, b, rule=rule, exact=False).collect()}
    assert got == expected and len({d for d, _ in got if d < 900}) > 20


def test_anchors_hit_every_window():
    rnd = random.Random(1)
    for n, window, most in ((50, 10, 1), (50, 10, 4), (9, 10, 2), (5, 3, 3), (1, 1, 1)):
        marks = leakage._anchors(np.array([rnd.randint(1, 5) for _ in range(n)]), window, most)
        assert all(marks[k : k + window].sum() >= min(most, n) for k in range(max(1, n - window + 1)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(97, 100), min_size=1, max_size=60), st.integers(1, 9))
def test_equal_grams_have_equal_hashes(cps, q):
    x = np.array(cps, np.uint32)
    h = leakage.gram_hashes(x, q)
    grams = [tuple(cps[i : i + q]) for i in range(len(cps) - q + 1)]
    assert len(h) == len(grams)
    assert len(set(zip(grams, h.tolist()))) == len(set(grams)) == len(set(h.tolist()))
