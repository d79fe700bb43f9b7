import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scenograph.llm import textform
from scenograph.llm.lookalikes import changed_forms, rows_with_cases, with_form

CASES = {
    "Ａnchor": "Anchor", "ét": "ét", "a‍b": "ab", "a b": "a b", "ﬁn": "fin", "⼈": "人", "羅": "羅", "Guild­": "Guild",
    "pаge": "page", "𝐇all": "Hall", "１": "1",
}
PLAIN = ["", "Anchor", "ключ", "тихая вода", "　雨，落。", "a・b·c", "line\r\nend\t", "œuvre", "ἄδω", "ユキノ", "…"]


@pytest.mark.parametrize("text,form", CASES.items())
def test_cases(text, form):
    out, flag = textform.normalize(pa.array([text]))
    assert out.to_pylist() == [form] and flag.tolist() == [True]


def test_plain_texts_stay():
    out, flag = textform.normalize(pa.array([*PLAIN, None]))
    assert out.to_pylist() == [*PLAIN, None] and not flag.any()


def test_sliced_and_empty_arrays():
    assert textform.normalize(pa.array([], pa.string()))[0].to_pylist() == []
    out, _ = textform.normalize(pa.array(["Ａ", "Ｂ", "Ｃ"]).slice(1, 1))
    assert out.to_pylist() == ["B"]


MARKED = st.text(alphabet="aeocnA éêạ̧̣́̀̂̄̈क़ো각ガ", max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(MARKED, min_size=1, max_size=6))
def test_marks_are_composed_as_unicode_says(texts):
    out, _ = textform.normalize(pa.array(texts))
    assert out.to_pylist() == [unicodedata.normalize("NFC", x) for x in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=5))
def test_form_is_stable_and_independent_of_neighbours(texts):
    out, _ = textform.normalize(pa.array(texts))
    again, _ = textform.normalize(out)
    assert again.to_pylist() == out.to_pylist()
    assert out.to_pylist() == [textform.normalize(pa.array([x]))[0].to_pylist()[0] for x in texts]


def test_rows(spark):
    from datetime import datetime

    a, b = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [("x", a, "Ａ"), ("x", b, "A"), ("y", a, "A"), ("y", b, "Ａ"), ("y", b, "Ａ"), ("z", a, None), ("w", a, ""), (None, a, "Ａ"), ("long", a, "ab " * 300000 + "Ｚ")]
    df = spark.createDataFrame(rows, "id string, written_at timestamp, t string")
    assert {r.id for r in rows_with_cases(df, "id", "t").collect()} == {"y", "long"}
    assert {r.id: r.form[-1] for r in changed_forms(df, "id", "t").collect()} == {"y": "A", "long": "Z"}
    assert rows_with_cases(df.where("false"), "id", "t").count() == 0
    clash = df.withColumnRenamed("written_at", "form")
    assert with_form(clash, "t").columns == ["id", "t", "form", "has_case"]


def test_katakana_among_ideographs():
    forms, flags = textform.normalize(pa.array(["渡ロ那邊", "サクラ ユキノ", "カ", "ロ", "人ロ", "渡ロロ", "碑文は力トカ"]))
    assert forms.to_pylist() == ["渡口那邊", "サクラ ユキノ", "カ", "ロ", "人口", "渡ロロ", "碑文は力トカ"]
    assert list(flags) == [True, False, False, False, True, False, False]
