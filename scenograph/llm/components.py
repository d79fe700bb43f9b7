"""Connected components of a graph given as edges: contraction inside tasks, then alternating stars; nothing leaves the executors but one count a round."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scenograph.session import materialize, release


def contracted(edges: DataFrame, room: int = 500_000) -> DataFrame:
    """Each task's edges as (p, q) from every node to the least node it is tied to within the task; the components stay the same.

    A task that holds more than `room` nodes puts out what it has and begins anew, so its memory is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[str, str] = {}

        def top(x: str) -> str:
            while (y := up[x]) != x:
                up[x] = up[y]
                x = y
            return x

        def out() -> pa.RecordBatch:
            rows = [(x, top(x)) for x in up]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.string())], names=["p", "q"])

        for b in batches:
            for p, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, q = top(p) if p in up else up.setdefault(p, p), top(q) if q in up else up.setdefault(q, q)
                if p < q:
                    up[q] = p
                elif q < p:
                    up[p] = q
            if len(up) > room:
                yield out()
        yield out()

    return edges.select("p", "q").mapInArrow(run, "p string, q string")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("q").alias("p"), F.col("p").alias("q")))
    least = both.groupBy("p").agg(F.least(F.min("q"), F.col("p")).alias("m"))
    return both.where("q > p").join(least, "p").select(F.col("q").alias("p"), F.col("m").alias("q"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("p", "q").alias("p"), F.least("p", "q").alias("q"))
    least = down.groupBy("p").agg(F.min("q").alias("m"))
    joined = down.join(least, "p")
    return joined.where("q <> m").select(F.col("q").alias("p"), F.col("m").alias("q")).unionByName(least.select("p", F.col("m").alias("q")))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The table and a sign of its edges between different nodes, taken while it is written."""
    seen, apart = Observation(), F.col("p") != F.col("q")
    out = materialize(edges.observe(seen, F.sum(F.when(apart, 1)).alias("n"), F.sum(F.when(apart, F.xxhash64("p", "q").cast("decimal(38,0)"))).alias("h")), "star")
    return out, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, near: Column | str = "p") -> DataFrame:
    """edges(p, q) of strings -> (node, component), the component being its smallest node. Loops and repeated edges do no harm; no edges, no rows.

    Edges that agree in `near` are brought to one task where its size allows (large partitions are split by adaptive execution) and contracted there; a
    large-star and a small-star step a round tie what is left, until a round changes nothing. Rounds grow with the logarithm of the longest path.
    """
    placed = edges.select("p", "q", (F.col(near) if isinstance(near, str) else near).alias("_near")).hint("rebalance", F.col("_near"))
    forest, sign = _written(contracted(placed).distinct())
    alone = forest.where("p = q").select(F.col("p").alias("node"))
    now = forest.where("p <> q")
    last = None
    while True:
        new, now_sign = _written(_small_star(_large_star(now)).distinct())
        if last is not None:
            release(last)
        now, last, same, sign = new, new, now_sign == sign, now_sign
        if same:
            break
    labels = now.select(F.col("p").alias("node"), F.col("q").alias("component")).unionByName(now.select(F.col("q").alias("node"), F.col("q").alias("component")))
    return labels.unionByName(alone.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
