"""Exact scores of stated questions against all documents of their scope, in cells of bounded size.

Documents of a scope (a novel) are dealt to parts and its questions to blocks by their numbers, so that a cell, one part against one block, holds at most about
DOCUMENTS rows against QUESTIONS, however large a scope is. A cell scores all its pairs as matrices, filters by volume and type first, and passes on only the k
best of each question and the range of its scores. So what is shuffled grows with the questions, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenograph.functions.text import tokens
from scenograph.functions.vectors import BUCKETS, bucket
from scenograph.session import materialize

DOCUMENTS, QUESTIONS, STEP = 4096, 1024, 64
SAME, ANY, LOW, HIGH, LEAST, MOST, HYBRID = range(7)  # kinds of rows that a cell passes on
OUT = "qid string, key string, kind int, score double"


def prepared(df: DataFrame, key: str, scope: str, text: Column, words: Column, name: Column | None = None, vol: Column | None = None, kind: Column | None = None, unscoped: bool = False) -> DataFrame:
    """Rows as cells take them: buckets of the hashed tokens of name and text, hashes of the words for BM25. Missing vol and kind: no filter. unscoped: rows without scope stay."""
    buckets = lambda c: F.transform(tokens(c), lambda t: bucket(t))
    none = F.array().cast("array<int>")
    return df.where(F.col(key).isNotNull() & (F.lit(unscoped) | F.col(scope).isNotNull())).select(
        F.col(key).cast("string").alias("key"), F.col(scope).alias("scope"), (vol if vol is not None else F.lit(0)).cast("int").alias("vol"),
        (kind if kind is not None else F.lit("")).alias("type"), (buckets(name) if name is not None else none).alias("name"), buckets(text).alias("text"),
        F.transform(tokens(words), lambda t: F.xxhash64(t)).alias("words"),
    )


def _unit(lists: pa.Array) -> np.ndarray:
    n = len(lists)
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    m = np.bincount(row * BUCKETS + lists.flatten().to_numpy(zero_copy_only=False), minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _scores(docs: pa.Table, asked: pa.Table, mean: float, k1: float, b: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each STEP questions: (which, name cosines, text cosines, BM25, whether the volume allows it, whether the types agree)."""
    n = docs.num_rows
    name, text = _unit(_column(docs, "name")), _unit(_column(docs, "text"))
    lists = _column(docs, "words")
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    known, inverse = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    length = np.bincount(row, minlength=n)
    posts, tf = np.unique(inverse.astype(np.int64) * n + row, return_counts=True)
    at, doc = posts // n, posts % n
    weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
    vol, kind = docs.column("vol").to_pandas().to_numpy(float), docs.column("type").to_numpy()
    q_name, q_text = _unit(_column(asked, "name")), _unit(_column(asked, "text"))
    q_vol, q_kind = asked.column("vol").to_pandas().to_numpy(float), asked.column("type").to_numpy()
    lists = _column(asked, "words")
    q_at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten()
    term, idf = flat.field("t").to_numpy(zero_copy_only=False), flat.field("idf").to_numpy(zero_copy_only=False)
    place = np.searchsorted(known, term)
    hit = place < len(known)
    hit[hit] = known[place[hit]] == term[hit]
    first, last = np.searchsorted(at, place, "left"), np.searchsorted(at, place, "right")
    for a in range(0, asked.num_rows, STEP):
        z = min(asked.num_rows, a + STEP)
        own = np.flatnonzero(hit[q_at[a] : q_at[z]]) + q_at[a]
        count = last[own] - first[own]
        posting = np.repeat(first[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        question = np.repeat(np.searchsorted(q_at, own, "right") - 1 - a, count)
        bm = np.bincount(question * n + doc[posting], weights=np.repeat(idf[own], count) * weight[posting], minlength=(z - a) * n).reshape(z - a, n)
        same = (q_kind[a:z, None] == kind[None, :]) & (kind != None)[None, :]  # noqa: E711
        yield slice(a, z), q_name[a:z] @ name.T, q_text[a:z] @ text.T, bm, vol[None, :] <= q_vol[a:z, None], same


def _best(score: np.ndarray, ok: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best valid entries of each row by the rounded score, ties by rank."""
    key = np.where(ok, -np.round(score, 9), np.inf)
    if key.shape[1] > k:
        kth = np.partition(key, k - 1, axis=1)[:, k - 1 : k]
        r, c = np.nonzero((key <= kth) & np.isfinite(key))
    else:
        r, c = np.nonzero(np.isfinite(key))
    order = np.lexsort((rank[c], key[r, c], r))
    r, c = r[order], c[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    return r[nth < k], c[nth < k]


def _cells(docs: DataFrame, asked: DataFrame) -> tuple:
    parts = docs.groupBy("scope").agg(F.ceil(F.count("*") / DOCUMENTS).alias("nd"))
    blocks = asked.groupBy("scope").agg(F.ceil(F.count("*") / QUESTIONS).alias("nq"))
    sizes = parts.join(blocks, "scope")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    d = docs.join(sizes, "scope").withColumn("part", F.pmod(F.xxhash64("key"), F.col("nd"))).withColumn("block", every("nq")).drop("nd", "nq")
    q = asked.join(sizes, "scope").withColumn("block", F.pmod(F.xxhash64("key"), F.col("nq"))).withColumn("part", every("nd")).drop("nd", "nq")
    by = ("scope", "part", "block")
    return d.groupBy(*by).cogroup(q.groupBy(*by))


def _table(parts: list[tuple]) -> pa.Table:
    """(qid array, key array or None, kind, scores) -> rows."""
    cols = [[], [], [], []]
    for qid, key, kind, score in parts:
        cols[0].append(qid)
        cols[1].append(key if key is not None else pa.nulls(len(qid), pa.string()))
        cols[2].append(pa.array(np.full(len(qid), kind, np.int32)))
        cols[3].append(pa.array(score.astype(np.float64)))
    types = (pa.string(), pa.string(), pa.int32(), pa.float64())
    return pa.table([pa.chunked_array(c, t) for c, t in zip(cols, types)], names=["qid", "key", "kind", "score"])


def scored(docs: DataFrame, asked: DataFrame, k: int, alpha: float = 0.5, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(by_name, hybrid), the k best documents of each question: (qid, key, score) each, ties by key.

    docs and asked are prepared(). by_name: certainty of the names' vectors, of the same type where the scope has any such document, else of any.
    hybrid: cosine of the texts' vectors and BM25 of the words, both brought to 0..1 over the question's candidates (a constant list is 1), the same type
    only; BM25 statistics are over all docs. Only documents of the question's scope and up to its volume are candidates, and only those that share something.
    """
    docs = materialize(docs, "documents")
    lengths = docs.agg(F.count("*").alias("n"), F.avg(F.when(F.size("words") > 0, F.size("words"))).alias("mean")).first()
    mean = float(lengths.mean or 1.0)
    terms = asked.select("key", F.explode(F.array_distinct("words")).alias("t"))
    held = docs.select(F.explode(F.array_distinct("words")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(lengths.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(held, "t").groupBy("key").agg(F.collect_list(F.struct("t", idf.alias("idf"))).alias("words"))
    none = F.array().cast("array<struct<t:bigint,idf:double>>")
    asked = materialize(asked.drop("words").join(weighted, "key", "left").withColumn("words", F.coalesce("words", none)), "asked")

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            keys, qids = _column(left, "key"), _column(right, "key")
            rank = np.argsort(np.argsort(keys.to_numpy(zero_copy_only=False)))
            for s, name, text, bm, allowed, same in _scores(left, right, mean, k1, b):
                sure = np.maximum(0, 1 - (1 - name) / 2)
                for kind, ok in ((SAME, allowed & same & (name > 0)), (ANY, allowed & (name > 0))):
                    r, c = _best(sure, ok, rank, k)
                    parts.append((qids.take(pa.array(r + s.start)), keys.take(pa.array(c)), kind, sure[r, c]))
                for low, high, m in ((LOW, HIGH, text), (LEAST, MOST, bm)):
                    ok = allowed & same & (m > 0)
                    r = np.flatnonzero(ok.any(1))
                    for kind, v in ((low, np.where(ok, m, np.inf).min(1)), (high, np.where(ok, m, -np.inf).max(1))):
                        parts.append((qids.take(pa.array(r + s.start)), None, kind, v[r]))
        return _table(parts)

    one = materialize(_cells(docs, asked).applyInArrow(first, OUT), "ranges")
    value = lambda f, kind, name: f(F.when(F.col("kind") == kind, F.col("score"))).alias(name)
    scale = one.where(F.col("kind") >= LOW).groupBy(F.col("qid").alias("key")).agg(value(F.min, LOW, "v0"), value(F.max, HIGH, "v1"), value(F.min, LEAST, "b0"), value(F.max, MOST, "b1"))

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            keys, qids = _column(left, "key"), _column(right, "key")
            rank = np.argsort(np.argsort(keys.to_numpy(zero_copy_only=False)))
            low, high, least, most = (right.column(c).to_pandas().to_numpy(float)[:, None] for c in ("v0", "v1", "b0", "b1"))

            def scaled(m: np.ndarray, ok: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
                return np.where(ok, np.where(z > a, (m - a) / np.where(z > a, z - a, 1), 1.0), 0.0)

            for s, _, text, bm, allowed, same in _scores(left, right, mean, k1, b):
                fit = allowed & same
                v, w = fit & (text > 0), fit & (bm > 0)
                hybrid = alpha * scaled(text, v, low[s], high[s]) + (1 - alpha) * scaled(bm, w, least[s], most[s])
                r, c = _best(hybrid, v | w, rank, k)
                parts.append((qids.take(pa.array(r + s.start)), keys.take(pa.array(c)), HYBRID, hybrid[r, c]))
        return _table(parts)

    two = _cells(docs, asked.join(scale, "key", "left")).applyInArrow(second, OUT)
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "key")
    best = lambda df: df.select("qid", "key", "score").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    same = one.where(F.col("kind") == SAME)
    relaxed = one.where(F.col("kind") == ANY).join(same.select("qid").distinct(), "qid", "left_anti")
    return best(same.unionByName(relaxed)), best(two)
