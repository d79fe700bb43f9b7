import uuid

import pytest
from pyspark.sql import functions as F

from scenograph.functions import predicates as P
from scenograph.functions import text as X
from scenograph.functions.ids import scene_key, tenant_hash, uuid5
from scenograph.functions.vectors import certainty, cosine


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "text,parts",
    [
        ("a\n第三章 \nb", ["a", "\n第三章 \nb"]),
        ("a\n第 ３ 回\nb", ["a", "\n第 ３ 回\nb"]),
        ("a\n第三章風起\nb", ["a\n第三章風起\nb"]),  # a heading that runs on is none
        ("a\nCHAPTER 2\nb\n  Epilogue \nc", ["a", "\nCHAPTER 2\nb", "\n  Epilogue \nc"]),
        ("a\n◆◇\nb", ["a", "\n◆◇\nb"]),
        ("a\n----\nb\n--\nc", ["a", "\n----\nb\n--\nc"]),
        ("a\n\n\nb", ["a", "\n\n\nb"]),
        ("a\n\nb", ["a\n\nb"]),
        ("", []),
        (" \n ", []),
    ],
)
def test_structural_split(spark, text, parts):
    assert one(spark, X.structural_split("t"), t=text) == parts


def test_sentences_keep_every_character(spark):
    text = "他來了。走了！真的？\nMr. X left."
    assert one(spark, X.sentence_split("t"), t=text) == ["他來了。", "走了！", "真的？", "\n", "Mr. X left."]


def test_numbers_and_ids(spark):
    assert [one(spark, X.number_in("t"), t=t) for t in ("vol12_3.txt", "none", "", None, "99999999999")] == [12, 0, 0, 0, 999999999]
    df = spark.createDataFrame([("5d8532fe", 1, 7)], "novel_hash string, vol_num int, scene_index int")
    assert df.select(uuid5(scene_key())).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "5d8532fe:vol1:scene7"))
    assert one(spark, tenant_hash("t"), t="x") == "9dd4e461"


def test_model_output(spark):
    assert one(spark, X.json_narrow("t"), t='so: {"a": {"b": 1}} ok') == '{"a": {"b": 1}}'
    flags = {'{"combine": false}': False, '{"combine": true}': True, "combine: TRUE maybe": True, "combine: no": False, "garbled": True, None: True}
    assert {t: one(spark, X.lenient_flag("t"), t=t) for t in flags} == flags
    assert one(spark, X.reasoning("t")[1], t="<think>a\nb</think> yes") == "yes"
    assert one(spark, X.reasoning("t")[1], t="before <think>a</think>\u3000after") == "after" and one(spark, X.reasoning("t")[0], t="x<think> a </think>") == "a"
    assert one(spark, X.reasoning("t")[1], t=" <think>open") == " <think>open"
    for t in ("<tool_call>{}\n</tool_call>", "<|tool_call>x<tool_call|>", "<|tool_call|>x<|/tool_call|>"):
        assert one(spark, X.strip_tool_calls("t"), t=f" a{t} b {t}") == "a b"
    assert one(spark, X.rendered("${t}: $t costs $$1", t=F.col("t")), t="x") == "x: x costs $1"
    assert one(spark, X.front_matter("t"), t="---\na: b\n---\nbody") == "body"


def test_truncation(spark):
    assert one(spark, F.length(X.truncate_tokens("t", 100)), t="x" * 1000) == 180
    assert one(spark, X.truncate_tokens("t", 100), t="short") == "short" and one(spark, X.truncate_tokens("t"), t=None) is None


def test_filters(spark):
    words = {"Anna": True, " ": False, None: False, "none": False, "未知人物A": False, "角色 3": False, "男子": False, "男子漢": True, "n/a": False}
    assert {w: one(spark, P.valid_keyword("t"), t=w) for w in words} == words
    assert one(spark, P.valid_context("t"), t="無資料") is False and one(spark, P.any_category("t", ["a"]), t=[None, "b"]) is False
    df = spark.createDataFrame([(-1, 2, "a", "a", "x"), (-1, 2, "a", "b", "x"), (2, 2, "a", "a", "x"), (1, 2, "a", "b", "x"), (1, 2, "a", "N/A", "x"), (None, 2, "a", "a", "x")], "i int, n int, k string, r string, d string")
    assert [r[0] for r in df.select(P.merge_valid("i", "n", "k", "r", "d")).collect()] == [True, False, False, True, False, False]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [tuple(round(x, 6) for x in r) for r in df.select(cosine("a", "b"), certainty(cosine("a", "b"))).collect()]
    assert got == [(0.707107, 0.853553), (0.0, 0.5)]
    assert df.select(certainty(F.lit(None).cast("double"))).first()[0] == 0.0
