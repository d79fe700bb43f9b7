"""Fusion of two exact rankings by reciprocal ranks, without sorting or shuffling whole lists.

A document among the `limit` best by reciprocal ranks is among the first DEEP = 2 x (constant + limit) of one list at least: deeper in both it has at most
2 / (constant + DEEP + 1), less than the 1 / (constant + limit) that the first `limit` of a list have. So a cell, one block of a novel's questions against all
its documents, reads the documents once for the first DEEP of both lists, and a second time, from a local file, for the ranks that the bounds leave open, by
counting what is better. Documents stream in chunks sorted by key; what is held grows with the block and not with the novel.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenograph.functions.vectors import BUCKETS
from scenograph.operators.scoring import DOCUMENTS, STEP
from scenograph.session import materialize

QUESTIONS, BITS = 4096, 20
SLIM = "scope string, key string, text array<tinyint>, words array<bigint>, length int"


def _unit(lists: pa.ListArray) -> np.ndarray:
    n = len(lists)
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    m = np.bincount(row * BUCKETS + lists.flatten().to_numpy(zero_copy_only=False), minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


class _Block:
    """Questions of a cell and their scores of a chunk of documents, both rounded; -inf where nothing is shared."""

    def __init__(self, asked: pa.RecordBatch, mean: float, k1: float, b: float) -> None:
        self.ids, self.mean, self.k1, self.b = asked.column("key"), mean, k1, b
        self.text = _unit(asked.column("text"))
        lists = asked.column("words")
        self.at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        self.known, self.term = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        self.idf = asked.column("idf").flatten().to_numpy(zero_copy_only=False)

    def scores(self, docs: pa.RecordBatch, wanted: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        n, text, lists = docs.num_rows, _unit(docs.column("text")), docs.column("words")
        row, word, length = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False), docs.column("length").to_numpy()
        place = np.searchsorted(self.known, word)
        hit = place < len(self.known)
        hit[hit] = self.known[place[hit]] == word[hit]
        posts, tf = np.unique(place[hit] * n + row[hit], return_counts=True)
        doc = posts % n
        weight = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length[doc] / self.mean))
        first, last = (np.searchsorted(posts // n, self.term, side) for side in ("left", "right"))
        for a in range(0, len(self.ids), STEP):
            z = min(len(self.ids), a + STEP)
            if wanted is not None and not wanted[a:z].any():
                continue
            own = np.arange(self.at[a], self.at[z])
            count = last[own] - first[own]
            posting = np.repeat(first[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            question = np.repeat(np.searchsorted(self.at, own, "right") - 1 - a, count)
            bm = np.bincount(question * n + doc[posting], weights=np.repeat(self.idf[own], count) * weight[posting], minlength=(z - a) * n).reshape(z - a, n)
            yield slice(a, z), *(np.where(m > 0, np.round(m, 9), -np.inf) for m in (self.text[a:z] @ text.T, bm))


class _First:
    """The first `deep` of one list of each question: score, the score in the other list, the document's number; ties by number."""

    def __init__(self, questions: int, deep: int) -> None:
        self.deep = deep
        self.score, self.other, self.number = np.full((questions, deep), -np.inf), np.full((questions, deep), -np.inf), np.zeros((questions, deep), np.int64)

    def add(self, s: slice, score: np.ndarray, other: np.ndarray, start: int) -> None:
        mask = score > self.score[s, -1:]  # numbers ascend: an equal one comes later
        n = score.shape[1]
        many = np.flatnonzero(mask.sum(1) > 2 * self.deep)
        if len(many):
            mask[many] &= score[many] >= np.partition(score[many], n - self.deep, axis=1)[:, n - self.deep, None]
        r, c = np.nonzero(mask)
        if not len(r):
            return
        rows = np.unique(r)
        old = rows + s.start
        row = np.concatenate((np.repeat(rows, self.deep), r))
        cols = [np.concatenate((x[old].ravel(), y)) for x, y in ((self.score, score[r, c]), (self.other, other[r, c]), (self.number, c + start))]
        order = np.lexsort((cols[2], -cols[0], row))
        nth = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        order = order[nth < self.deep]  # each row has `deep` at least
        for x, y in zip((self.score, self.other, self.number), cols):
            x[old] = y[order].reshape(len(rows), self.deep)


def _candidates(first: list[_First], limit: int, constant: int) -> tuple[np.ndarray, ...]:
    """(question, number, scores [2], ranks [2]) of what may be among the best; rank 0: not in the list, -1: to be counted."""
    deep, parts = first[0].deep, []
    for k, f in enumerate(first):
        q, j = np.nonzero(f.score > -np.inf)
        scores, ranks = np.empty((len(q), 2)), np.zeros((len(q), 2), np.int64)
        scores[:, k], scores[:, 1 - k], ranks[:, k] = f.score[q, j], f.other[q, j], j + 1
        parts.append((q, f.number[q, j], scores, ranks))
    q, number, scores, ranks = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((number, q))
    q, number, scores, ranks = q[order], number[order], scores[order], ranks[order]
    again = np.zeros(len(q), bool)
    again[1:] = (q[1:] == q[:-1]) & (number[1:] == number[:-1])
    twice = np.flatnonzero(again)
    ranks[twice - 1] = np.maximum(ranks[twice - 1], ranks[twice])
    q, number, scores, ranks = q[~again], number[~again], scores[~again], ranks[~again]
    open_ = (ranks == 0) & (scores > -np.inf)
    low = np.where(ranks > 0, 1 / (constant + np.maximum(ranks, 1)), 0).sum(1)
    order = np.lexsort((-low, q))
    nth = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    least = np.zeros(int(q.max()) + 1 if len(q) else 0)
    at = order[nth == limit - 1]
    least[q[at]] = low[at]
    kept = low + open_.sum(1) / (constant + deep + 1) >= least[q] - 2e-9  # results are compared by 9 digits
    ranks[open_] = -1
    return q[kept], number[kept], scores[kept], ranks[kept]


def _cell(asked: pa.RecordBatch, chunks: Iterator[pa.RecordBatch], limit: int, constant: int, mean: float, k1: float, b: float) -> pa.RecordBatch:
    block = _Block(asked, mean, k1, b)
    first, start = [_First(len(block.ids), 2 * (constant + limit)) for _ in range(2)], 0
    with tempfile.TemporaryFile() as file:
        writer = None
        for docs in chunks:
            writer = writer or pa.ipc.new_stream(file, docs.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
            writer.write_batch(docs)
            for s, v, w in block.scores(docs):
                first[0].add(s, v, w, start)
                first[1].add(s, w, v, start)
            start += docs.num_rows
        q, number, scores, ranks = _candidates(first, limit, constant)
        keys = np.empty(len(q), object)
        if writer:
            writer.close()
            file.seek(0)
            counted = (ranks < 0).any(1)
            wanted = np.zeros(len(block.ids), bool)
            wanted[q[counted]] = True
            better, start = np.zeros(ranks.shape, np.int64), 0
            for docs in pa.ipc.open_stream(file):
                n = docs.num_rows
                here = np.flatnonzero((number >= start) & (number < start + n))
                keys[here] = docs.column("key").take(pa.array(number[here] - start)).to_pylist()
                for s, *both in block.scores(docs, wanted) if counted.any() else ():
                    for i in np.flatnonzero(wanted[s]) + s.start:
                        own = np.arange(*np.searchsorted(q, (i, i + 1)))
                        for k, m in enumerate(both):
                            mine = own[ranks[own, k] < 0]
                            if len(mine):
                                row = m[i - s.start]
                                line = np.sort(row)
                                value, before = scores[mine, k], number[mine] - start
                                right = np.searchsorted(line, value, "right")
                                ties = right - np.searchsorted(line, value, "left")
                                ties[before <= 0] = 0
                                for j in np.flatnonzero((before > 0) & (before < n) & (ties > 0)):
                                    ties[j] = (row[: before[j]] == value[j]).sum()
                                better[mine, k] += n - right + ties
                start += n
            ranks = np.where(ranks < 0, better + 1, ranks)
    hybrid = np.where(ranks > 0, 1 / (constant + np.maximum(ranks, 1)), 0.0).sum(1)
    order = np.lexsort((number, -np.round(hybrid, 9), q))
    order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < limit]
    return pa.RecordBatch.from_arrays([block.ids.take(pa.array(q[order])), pa.array(keys[order], pa.string()), pa.array(hybrid[order])], names=["qid", "key", "score"])


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """(cell, side, rows): sorted rows cut where the cell or the side changes, and to chunks of `size`, questions whole."""
    held, cell = [], None

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        scope, block, side = (b.column(c).to_pylist() for c in ("scope", "block", "side"))
        a = 0
        while a < b.num_rows:
            now = (scope[a], block[a], side[a])
            if held and (now != cell or (side[a] and sum(x.num_rows for x in held) >= size)):
                yield cell[:2], cell[2], joined()
                held = []
            cell, room, z = now, size - sum(x.num_rows for x in held), a
            while z < b.num_rows and (scope[z], block[z], side[z]) == now and (not side[a] or z - a < room):
                z += 1
            held.append(b.slice(a, z - a))
            a = z
    if held:
        yield cell[:2], cell[2], joined()


def ranked(docs: DataFrame, asked: DataFrame, limit: int, constant: int = 60, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, key, score), the `limit` best documents of each question by reciprocal ranks in the lists by the texts' cosines and by BM25 of the words, ties by key.

    docs and asked are scoring.prepared(), docs without scope included: they count for BM25. Both lists hold what shares something with the question.
    """
    spark, size = docs.sparkSession, DOCUMENTS
    terms = materialize(asked.select("scope", "key", F.explode(F.array_distinct("words")).alias("t")), "terms")
    bits = np.zeros(1 << BITS, bool)  # of the words that questions have: bounded
    bits[[r[0] for r in terms.select(F.pmod("t", F.lit(1 << BITS)).cast("int")).distinct().toLocalIterator()]] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_for = np.unpackbits(shared.value).astype(bool)
        for x in batches:
            lists = x.column("words")
            word, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            kept = asked_for[word & ((1 << BITS) - 1)]
            ends = np.concatenate(([0], np.cumsum(kept)))[offsets - offsets[0]]
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(word[kept]))
            yield pa.RecordBatch.from_arrays([x.column("scope"), x.column("key"), x.column("text"), words, pa.array(np.diff(offsets), pa.int32())], names=["scope", "key", "text", "words", "length"])

    small = docs.select("scope", "key", F.col("text").cast("array<tinyint>").alias("text"), "words")
    docs = materialize(small.mapInArrow(slim, SLIM), "documents")
    whole = docs.agg(F.count("*").alias("n"), F.avg(F.when(F.col("length") > 0, F.col("length"))).alias("mean")).first()
    mean = float(whole.mean or 1.0)
    held = docs.select(F.explode(F.array_distinct("words")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(whole.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(held, "t").groupBy("scope", "key").agg(F.array_sort(F.collect_list(F.struct("t", idf.alias("idf")))).alias("w"))
    asked = asked.drop("words").join(weighted, ["scope", "key"], "left")
    blocks = asked.groupBy("scope").agg(F.ceil(F.count("*") / QUESTIONS).alias("nq"))
    none = F.array().cast("array<double>")
    d = docs.join(blocks, "scope").select("scope", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("block"), F.lit(1).alias("side"), "key", "text", "words", none.alias("idf"), "length")
    q = asked.join(blocks, "scope").select(
        "scope", F.pmod(F.xxhash64("key"), F.col("nq")).alias("block"), F.lit(0).alias("side"), "key", F.col("text").cast("array<tinyint>").alias("text"),
        F.coalesce(F.col("w.t"), F.array().cast("array<bigint>")).alias("words"), F.coalesce(F.col("w.idf"), none).alias("idf"), F.lit(0).alias("length"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _chunks(batches, size)
        now = next(parts, None)
        while now is not None:
            cell, side, rows = now
            if side:  # a block that no question fell to
                now = next(parts, None)
                continue
            after: list = []

            def own(cell: tuple = cell, after: list = after) -> Iterator[pa.RecordBatch]:
                for x in parts:
                    if x[0] != cell:
                        after.append(x)
                        return
                    yield x[2]

            yield _cell(rows, own(), limit, constant, mean, k1, b)
            now = after[0] if after else None

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return q.unionByName(d).repartition(n, "scope", "block").sortWithinPartitions("scope", "block", "side", "key").mapInArrow(run, "qid string, key string, score double")
