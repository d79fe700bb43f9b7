import random

import numpy as np
import pyarrow as pa

from scenograph.llm import subjects as S
from scenograph.llm.leakage import stream

AREAS = {"law": ["verdict", "jury bench", "plaintiff", "magistrate", "testimony"], "music": ["cadence", "lute string", "counterpoint", "metronome", "chorus"], "cooking": ["麵團配方", "香料架", "烤箱石", "醃料罐", "食譜卡"]}
FILLER = ["The river lay warm beneath the bell.", "Rain fell on the hollow again.", "She laughed and set the stone down.", "雨落在港灣，他數著窗。"]


def sentence(rnd, area):
    a, b = rnd.sample(AREAS[area], 2)
    return f"他們為{a}爭論，直到她提起{b}。" if area == "cooking" else rnd.choice([f"They argued about the {a} until Ann brought up the {b}.", f"Every {a} in town depends on its {b}."])


def document(rnd, areas, n=12):
    out = [sentence(rnd, rnd.choice(areas)) if areas and rnd.random() < 0.8 else rnd.choice(FILLER) for _ in range(n)]
    if not areas:
        out[0] = "It had been a verdict of sorts."
    return " ".join(out)


def corpus(seed, n):
    rnd = random.Random(seed)
    names = sorted(AREAS)
    rows = []
    for i in range(n):
        areas = rnd.choice([[], ["law"], ["music"], ["cooking"], ["law", "music"]])
        rows.append((i, document(rnd, areas), areas))
    return names, rows


def test_held_out_accuracy(spark):
    names, rows = corpus(5, 600)
    rnd = random.Random(1)
    labels = [(i, a if rnd.random() > 0.05 else rnd.choice(names), "r1") for i, _, areas in rows[:300] for a in areas] + [(5, None, "r1"), (None, "law", "r1"), (7, "unknown", "r1")]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (1002, "...", "x"), (1003, rows[0][1] + " " + "long " * 100000, "x")], "doc_id long, text string, subject string")
    subj = spark.createDataFrame([(n, "") for n in names], "subject string, description string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    got = {(r.doc_id, r.subject) for r in S.subjects_of(docs, subj, lab).collect()}
    truth = {(i, a) for i, _, areas in rows[300:] for a in areas}
    found = {x for x in got if 300 <= x[0] < 1000}
    assert len(found & truth) / len(truth) > 0.95 and len(found & truth) / len(found) > 0.95
    assert not any(d in (1000, 1001, 1002) for d, _ in got)
    assert S.subjects_of(docs.where("false"), subj, lab).count() == 0
    assert S.subjects_of(docs, subj, lab.where("false")).count() == 0


def test_sentences_and_words():
    text = 'Dr.Who paid 3.14 coins! "Is it?" she said. 「好。」他說。走了。\n\nEnd'
    from scenograph.llm import textform

    cps, offs = textform.points(pa.array([text, "", "One. Two"]))
    number, doc = S.sentences(cps, offs)
    parts = ["".join(map(chr, cps[number == k].tolist())).strip() for k in range(number.max() + 1)]
    assert [p for p in parts if p] == ['Dr.Who paid 3.14 coins!', '"Is it?', '" she said.', "「好。」他說。", "走了。", "End", "One.", "Two"]
    assert set(doc.tolist()) == {0, 2}


def test_features_do_not_depend_on_place():
    a = S.features(pa.array(["Every jury bench depends. 香料架好。"]))
    b = S.features(pa.array([None, "noise " * 999, "EVERY jury  bench depends. 香料架好。"]))
    mine = b[0][b[2][b[1]] == 2]
    assert sorted(a[0].tolist()) == sorted(mine.tolist())
    assert len(a[0]) == 4 + 3 + 3 + 2
    assert stream(pa.array(["x"]))[0].tolist() == [120] and np.array_equal(S.features(pa.array([], pa.string()))[0], np.zeros(0))
