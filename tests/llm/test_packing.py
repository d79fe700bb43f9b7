from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scenograph.llm.packing import best_two_fit, fill, pack, packed_documents, token_counts


def first_fit_decreasing(sizes: list[int], capacity: int) -> int:
    """The plain baseline for tests: number of containers."""
    gaps: dict[int, int] = defaultdict(int)
    for s in sorted(sizes, reverse=True):
        g = next((g for g in sorted(gaps) if g >= s and gaps[g]), None)
        if g is None:
            g = capacity
        else:
            gaps[g] -= 1
        gaps[g - s] += 1
    return sum(gaps.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_two_fit(sizes):
    at = best_two_fit(np.array(sizes, np.int64), 40)
    used = np.bincount(at, weights=sizes) if sizes else np.zeros(0)
    assert (used <= 40).all() and (used > 0).all()
    assert len(used) <= first_fit_decreasing(sizes, 40) * 1.25 + 1


def test_two_replace_one():
    # greedy puts 60 + 30 (gap 10); 30 gives way to 25 + 15, which fill the gap
    at = best_two_fit(np.array([60, 30, 25, 15]), 100)
    assert at.tolist() == [0, 1, 0, 0]


def test_pack(spark):
    rng = np.random.default_rng(4)
    sizes = [int(x) for x in rng.lognormal(4, 1, 3000).clip(1, 2500)] + [0, 512, 1024, 512 * 3 + 7]
    df = spark.createDataFrame(list(enumerate(sizes)) + [(5, sizes[5])], "item long, n_tokens long")
    for bins in (32, 1000):
        out = pack(df, capacity=512, shard_bins=bins).toPandas()
        per_item = out.groupby("item").n_tokens.sum()
        assert per_item.drop(5).to_dict() == {i: s for i, s in enumerate(sizes) if i != 5} and per_item[5] == 2 * sizes[5]
        assert out[out.container_id.isna()].item.tolist() == [3000]
        used = out[out.container_id.notna()].groupby("container_id").n_tokens.sum()
        assert used.max() <= 512
        assert len(used) <= np.ceil(sum(sizes) / 512) * 1.02 + 1
        cut = out[out.item.isin(out[out.piece > 0].item)]
        assert set(cut.item) == {i for i, s in enumerate(sizes) if s > 512}
        assert ((out.first_token == out.piece * 512) | out.container_id.isna()).all()


def test_texts(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (4, "long text " * 20000, "x"), (3, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    assert {(r.item, r.n_tokens > 0) for r in token_counts(df, "doc_id", "text").collect()} == {(1, False), (2, False), (3, True), (4, True)}
    out = packed_documents(df)
    assert out.count() >= 5 + 4096 * 0
    assert {r.unused >= 0 for r in fill(out).collect()} == {True}
    assert packed_documents(df.where("false")).count() == 0
