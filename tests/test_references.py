from datetime import datetime, timedelta

import pytest


from scenograph.operators.references import layer_orphans, orphans

REFS = "id int, a string, b int, extra string"
TARGETS = "a string, b int, extra string"


@pytest.mark.parametrize(
    "match,expected",
    [
        ("simple", {(2, "missing")}),
        ("partial", {(2, "missing"), (4, "missing")}),
        ("full", {(2, "missing"), (3, "mixed"), (4, "mixed")}),
    ],
)
def test_match_semantics(spark, match, expected):
    refs = spark.createDataFrame([(1, "x", 1, None), (2, "x", 2, "e"), (3, "x", None, "e"), (4, None, 7, "e"), (5, None, None, "e")], REFS)
    targets = spark.createDataFrame([("x", 1, "other"), ("x", 1, "other"), (None, 3, "other")], TARGETS)
    for hot_rows in (1_000_000, 0):  # all by the join, all by the broadcast for hot keys
        got = orphans(refs, targets, ["a", "b"], match, hot_rows=hot_rows)
        assert {(r.id, r.reason) for r in got.collect()} == expected
    assert got.columns == ["id", "a", "b", "extra", "reason"]


def test_empty_sides_and_repeats(spark):
    refs = spark.createDataFrame([(1, "x", 1, None)] * 2, REFS)
    none = spark.createDataFrame([], TARGETS)
    assert orphans(refs, none, ["a", "b"]).count() == 2
    assert orphans(refs.where("false"), none, ["a", "b"]).count() == 0


def test_layers(spark):
    t = datetime(2024, 1, 1)
    hour = timedelta(hours=1)
    chunk = "chunk_uuid string, vol_num int, entity_refs array<string>, written_at timestamp"
    entity = "entity_uuid string, vol_num int, chunk_refs array<string>, written_at timestamp"
    chunks = spark.createDataFrame(
        [
            ("c1", 1, ["e1", " E1 ", None, "", "nope", "e2", "e3", "e4"], t),
            ("c1", 1, ["nope"], t - hour),
            ("c2", 2, None, t),
            ("c3", 2, ["nope"], t),  # removed, refers to nothing
        ],
        chunk,
    )
    entities = spark.createDataFrame(
        [("e1", 1, [], t), ("e2", 1, ["c1\n"], t), ("e3", 1, ["c3"], t + 24 * hour), ("e4", 1, None, t + 25 * hour)],
        entity,
    )
    removals = spark.createDataFrame([("entities", "E2", t), ("chunks", "c3", t + hour), ("entities", "ghost", t), ("entities", "e3", t), ("entities", "nope", t)], "layer string, row_uuid string, removed_at timestamp")
    got = {tuple(r) for r in layer_orphans(chunks, entities, removals).collect()}
    assert got == {("chunks", 1, "c1", "nope", "missing"), ("chunks", 1, "c1", "e2", "deleted"), ("chunks", 1, "c1", "e4", "late"), ("entities", 1, "e3", "c3", "deleted")}
