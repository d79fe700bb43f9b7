"""All similar pairs between set-valued records, by recursive chosen-path splitting.

Equal sets are one class first, so copies cost nothing. In every tree each class walks down to the children of its `branches` first tokens under a
random order of its node; two classes with Jaccard similarity t or more take a common step with a known least probability, since at most a share of 1 - t
of either's tokens is foreign to the other. Nodes of one class end; nodes of at most `small` classes are compared pair by pair; larger ones are split
again on the tokens not yet used. All trees go through a level together, in one job a level. The number of trees follows from the target recall at
`typical_depth`; classes still in large nodes there are joined exactly, by prefixes of their rarest tokens. Every pair found is verified on the values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenograph.llm.terms import PlainValues
from scenograph.session import materialize


def value_sets(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, values): the distinct plain values of the columns (strings or arrays of strings) of each row, sorted. Null keys are dropped; no values: an empty array."""
    types = dict(df.dtypes)
    parts = [F.coalesce(F.col(c) if types[c].startswith("array") else F.array(F.col(c)), F.array().cast("array<string>")) for c in columns]
    flat = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.concat(*parts).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = PlainValues()
        for b in batches:
            lists = b.column(1)
            coded = lists.flatten().dictionary_encode()
            values = [plain(x) for x in coded.dictionary.to_pylist()] + [None]
            index = coded.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False)
            offs = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sets = [sorted({v for k in index[a:z] if (v := values[k]) is not None}) for a, z in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.string()))], names=["key", "values"])

    return flat.mapInArrow(run, "key string, values array<string>")


def step_probability(threshold: float, branches: int) -> float:
    """Least probability that two similar sets take a common step: with x and y the foreign shares of the sets, it fails with at most x**branches + y**branches.

    At a given similarity that is greatest where one set contains the other, with a share of 1 - threshold of its tokens foreign.
    """
    return 1 - (1 - threshold) ** branches


def trees_needed(threshold: float, branches: int, depth: int, recall: float) -> int:
    p = step_probability(threshold, branches) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def chosen_path_pairs(classes: DataFrame, threshold: float = 0.6, branches: int = 2, small: int = 32, recall: float = 0.9999, typical_depth: int = 2, most_depth: int = 12) -> DataFrame:
    """classes(id, values array<string> of distinct values) -> distinct verified (id_a < id_b, similarity).

    Pairs of similarity equal to the threshold count. Sets that are empty pair with nothing. The recall holds at typical_depth, where the trees end: a pair
    that meets there in a large node is found by the exact join of the rest, whatever the depth. Nodes of that join still large at most_depth, or whose
    sets are used up, are compared all the same, by an equi-join on the node that adaptive skew handling may split; nothing is left out.
    """
    trees = trees_needed(threshold, branches, typical_depth, recall)
    # a class travels as a 64-bit hash of its id; where two share one, a pair of either is verified for both
    base = classes.select(F.xxhash64("id").alias("id"), F.transform("values", lambda v: F.xxhash64(v)).alias("tokens")).where("size(tokens) > 0")
    level = base.select("id", "tokens", F.array().cast("array<bigint>").alias("path"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(trees).cast("long"))).alias("node"))
    pairs = None
    for depth in range(1, min(typical_depth, most_depth) + 1):
        unused = F.size("path") < F.size("tokens")
        ranked = F.slice(F.array_sort(F.transform(F.array_except("tokens", "path"), lambda t: F.struct(F.xxhash64("node", t).alias("node"), t.alias("t")))), 1, branches)
        # a set whose tokens are used up stays in its node, among those that contain it
        steps = F.when(unused, ranked).otherwise(F.array(F.struct(F.col("node"), F.lit(None).cast("long").alias("t"))))
        taken = F.when(F.col("c.t").isNull(), F.col("path")).otherwise(F.concat("path", F.array("c.t")))
        children = level.select("id", "tokens", "path", F.explode(steps).alias("c")).select("id", "tokens", taken.alias("path"), F.col("c.node").alias("node"))
        counts = children.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        nodes = materialize(children.join(counts, "node"), f"nodes{depth}")
        done = _within(nodes.where(F.col("n") <= small), threshold)
        pairs = done if pairs is None else pairs.unionByName(done)
        level = nodes.where(F.col("n") > small).select("id", "tokens", "path", "node")
        if level.isEmpty():
            break
    else:
        # the trees are enough down to here only, so what is still in large nodes is joined without chance
        rest = materialize(level.select("id", "tokens").dropDuplicates(["id"]), "rest")
        pairs = reduce(DataFrame.unionByName, _prefix_pairs(rest, threshold, small, most_depth), pairs)
    found = materialize(pairs.distinct(), "pairs")
    keyed = classes.withColumn("k", F.xxhash64("id"))
    a = keyed.select(F.col("k").alias("id_a"), F.struct("id", "values").alias("a"))
    b = keyed.select(F.col("k").alias("id_b"), F.struct("id", "values").alias("b"))
    shared = F.size(F.array_intersect("a.values", "b.values"))
    exact = found.join(a, "id_a").join(b, "id_b").withColumn("similarity", shared / (F.size("a.values") + F.size("b.values") - shared))
    return exact.where(F.col("similarity") >= threshold - 1e-12).select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"), "similarity")


def _prefix_pairs(sets: DataFrame, threshold: float, small: int, most_depth: int) -> list[DataFrame]:
    """sets(id, tokens) -> candidates with every similar pair among them, by prefixes that grow with the depth.

    Tokens are ordered by rarity. Of n tokens a similar set shares at least o = ceil(threshold * n), so their first k common tokens are among the first
    n - o + k of either, and the two meet in the node of these k. Large nodes are split by the next common token; a set that may share no more than k
    is compared with all of its node.
    """
    counts = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    rare = sets.select("id", F.explode("tokens").alias("t")).join(counts, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("s"))
    n = F.size("tokens")
    level = rare.select("id", F.col("s.t").alias("tokens")).withColumn("o", F.ceil(threshold * n - 1e-9).cast("int")).withColumns({"node": F.lit(0).cast("long"), "at": F.lit(0)})
    pairs = []
    for depth in range(1, most_depth + 1):
        steps = F.transform(F.sequence(F.col("at") + 1, n - F.col("o") + depth), lambda i: F.struct(F.xxhash64("node", F.element_at("tokens", i)).alias("node"), i.alias("at")))
        children = level.select("id", "tokens", "o", F.explode(steps).alias("c")).select("id", "tokens", "o", "c.*")
        nodes = materialize(children.join(children.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "node"), f"prefixes{depth}")
        pairs.append(_within(nodes.where((F.col("n") <= small) | F.lit(depth == most_depth)), threshold))
        level = nodes.where((F.col("n") > small) & F.lit(depth < most_depth)).drop("n")
        pairs.append(_pairs(level.where(F.col("o") <= depth), level, threshold))
        level = level.where(F.col("o") > depth)
        if depth < most_depth and level.isEmpty():
            break
    return pairs


def _within(nodes: DataFrame, threshold: float) -> DataFrame:
    return _pairs(nodes, nodes, threshold)


def _pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Candidates of one node: sizes first, then the shared token hashes (a collision of 64 bits can only add a pair, which is verified later)."""
    a = left.select("node", F.col("id").alias("x"), F.col("tokens").alias("s"))
    b = right.select("node", F.col("id").alias("y"), F.col("tokens").alias("t"))
    small, large = F.least(F.size("s"), F.size("t")), F.greatest(F.size("s"), F.size("t"))
    order = F.col("x") < F.col("y") if left is right else F.col("x") != F.col("y")
    near = a.join(b, "node").where(order & (small >= threshold * large - 1e-9))
    shared = F.size(F.array_intersect("s", "t"))
    near = near.where(shared * (1 + threshold) >= threshold * (F.size("s") + F.size("t")) - 1e-9)
    return near.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def set_classes(df: DataFrame, key: str, columns: list[str], least_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """(classes(id, values, members), membership(key, class_id)) of the rows with at least so many values; a class is named by its smallest key."""
    sets = materialize(value_sets(df, key, columns).where(F.size("values") >= least_size), "sets").withColumn("h", F.sha2(F.to_json(F.struct("values")), 256))
    ids = sets.groupBy("h").agg(F.min("key").alias("id"), F.count("*").alias("members"), F.any_value("values").alias("values"))
    classes = materialize(ids, "classes")
    membership = sets.select("key", "h").join(classes.select("h", F.col("id").alias("class_id")), "h").select("key", "class_id")
    return classes.drop("h"), membership


def similar_rows(df: DataFrame, key: str, columns: list[str], threshold: float = 0.6, least_size: int = 5, **how) -> DataFrame:
    """(key_a < key_b, similarity) of all rows with similar sets, rows with equal sets included."""
    classes, membership = set_classes(df, key, columns, least_size)
    pairs = chosen_path_pairs(classes, threshold, **how)
    a = membership.select(F.col("class_id").alias("id_a"), F.col("key").alias("p"))
    b = membership.select(F.col("class_id").alias("id_b"), F.col("key").alias("q"))
    apart = pairs.join(a, "id_a").join(b, "id_b").select(F.least("p", "q").alias("key_a"), F.greatest("p", "q").alias("key_b"), "similarity")
    several = classes.where("members > 1").select(F.col("id").alias("id_a"))
    mine = several.join(a, "id_a")
    equal = mine.join(b.withColumnRenamed("id_b", "id_a"), "id_a").where("p < q").select(F.col("p").alias("key_a"), F.col("q").alias("key_b"), F.lit(1.0).alias("similarity"))
    return apart.unionByName(equal)


def linked_classes(df: DataFrame, key: str, columns: list[str], threshold: float = 0.6, least_size: int = 5, **how) -> DataFrame:
    """One row per row of df: its class and the number of other classes the class is similar to; copies are not expanded into pairs."""
    classes, membership = set_classes(df, key, columns, least_size)
    pairs = chosen_path_pairs(classes, threshold, **how)
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return membership.join(ends, "class_id", "left").select("key", "class_id", F.coalesce("links", F.lit(0)).alias("links"))

