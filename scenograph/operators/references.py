"""References to records that do not exist.

References carry a composite key any part of which may be null. They are grouped by null mask (which parts are given), each mask is anti-joined
with the targets on its given columns alone, and the declared match semantics say what a partly null key means:

simple   a key with any null refers to nothing and is satisfied
partial  the given columns must agree with some target
full     a key is either wholly null (satisfied) or wholly given; a mixed one is an orphan

Both sides are hash-partitioned on the key. Targets are reduced to one row a key before the join, so a join never multiplies rows. Keys that very many
references share are found by a pre-aggregated count and met by a broadcast of their few target rows instead, so no task holds all of a hot key.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def orphans(refs: DataFrame, targets: DataFrame, keys: list[str], match: str = "simple", state: dict[str, Column] | None = None, fault: Column | None = None, hot_rows: int = 1_000_000) -> DataFrame:
    """Rows of refs whose key has no target, with a column `reason`.

    keys: columns by the same name in both frames. state: aggregates over the targets of one key, named; the expression `fault` over these names and the
    columns of refs gives the reason of a reference whose target exists but does not serve (null: it serves).
    Without partner the reason is `missing`; a mixed key under full match has `mixed`. Empty refs give no rows; with empty targets every given key is an orphan.
    Repeated references stay repeated. Columns of targets other than the keys and the state never reach the result, so clashing names do no harm.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    state = state or {}
    columns = refs.columns
    fault = fault if fault is not None else F.lit(None).cast("string")
    parts = []
    for given in product((True, False), repeat=len(keys)):
        on = [k for k, g in zip(keys, given) if g]
        if not on or (match == "simple" and not all(given)):
            continue
        mask = reduce(lambda a, b: a & b, [F.col(k).isNotNull() if g else F.col(k).isNull() for k, g in zip(keys, given)])
        mine = refs.where(mask)
        if match == "full" and not all(given):
            parts.append(mine.withColumn("reason", F.lit("mixed")))
            continue
        there = targets.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])).groupBy(*[F.col(k).alias(f"_t_{k}") for k in on])
        aggregates = [v.alias(f"_s_{n}") for n, v in state.items()] + [F.lit(True).alias("_there")]
        there = there.agg(*aggregates)
        # keys of more than hot_rows references: at most one for each hot_rows rows, so they and their targets are small enough to broadcast
        hot = mine.groupBy(*[F.col(k).alias(f"_h_{k}") for k in on]).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).drop("_n")
        same = [F.col(k) == F.col(f"_t_{k}") for k in on]
        is_hot = [F.col(k) == F.col(f"_h_{k}") for k in on]
        cold = mine.join(F.broadcast(hot), is_hot, "left_anti").join(there, same, "left")
        few = there.join(F.broadcast(hot), [F.col(f"_t_{k}") == F.col(f"_h_{k}") for k in on], "left_semi")
        warm = mine.join(F.broadcast(hot), is_hot, "left_semi").join(F.broadcast(few), same, "left")
        joined = cold.unionByName(warm)
        named = joined.select(*columns, "_there", *[F.col(f"_s_{n}").alias(n) for n in state])
        parts.append(named.withColumn("reason", F.when(F.col("_there").isNull(), "missing").otherwise(fault)).where("reason is not null").select(*columns, "reason"))
    if not parts:
        return refs.where(F.lit(False)).withColumn("reason", F.lit("missing"))
    return reduce(DataFrame.unionByName, parts)


def uuid_form(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def layer_orphans(chunks: DataFrame, entities: DataFrame, removals: DataFrame, grace: str = "24 hours") -> DataFrame:
    """Orphan references between the two layers: src_table, vol_num, src_uuid, ref_uuid, reason.

    The current row of a uuid is its latest. A uuid is removed if its last removal is not earlier than its last row; removed rows refer to nothing.
    reason: missing, deleted, or late (the first row of the target came more than `grace` after the referring row). Null and blank elements are skipped,
    repeats within a row count once, null arrays refer to nothing.
    """
    other = {"chunks": "entities", "entities": "chunks"}

    def layer(df: DataFrame, name: str, uuid: str, refs: str) -> tuple[DataFrame, DataFrame]:
        base = df.where(F.col(uuid).isNotNull()).select(F.lit(name).alias("layer"), uuid_form(uuid).alias("uuid"), "written_at", "vol_num", F.col(refs).alias("refs"))
        times = base.select("layer", "uuid", F.col("written_at").alias("first"), F.col("written_at").alias("last"))
        return base, times

    (chunk_rows, chunk_times), (entity_rows, entity_times) = layer(chunks, "chunks", "chunk_uuid", "entity_refs"), layer(entities, "entities", "entity_uuid", "chunk_refs")
    gone = removals.where("row_uuid is not null").groupBy(F.lower(F.trim("layer")).alias("layer"), uuid_form("row_uuid").alias("uuid")).agg(F.max("removed_at").alias("removed"))
    gone_rows = gone.select("layer", "uuid", F.lit(None).cast("timestamp").alias("first"), F.lit(None).cast("timestamp").alias("last"), "removed")
    never = F.lit(None).cast("timestamp")
    targets = chunk_times.union(entity_times).withColumn("removed", never).union(gone_rows)
    # a removal of a uuid that never existed must not make it exist
    targets = targets.groupBy("layer", "uuid").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("removed").alias("removed")).where("last is not null")

    rows = chunk_rows.union(entity_rows)
    current = rows.groupBy("layer", "uuid").agg(F.max_by(F.struct("written_at", "vol_num", "refs"), F.struct("written_at", F.xxhash64("vol_num", "refs"))).alias("r")).select("layer", "uuid", "r.*")
    live = current.join(gone, ["layer", "uuid"], "left").where("removed is null or removed < written_at")
    refs = live.select(
        F.col("layer").alias("src_table"),
        "vol_num",
        F.col("uuid").alias("src_uuid"),
        "written_at",
        F.explode(F.array_distinct(F.transform("refs", lambda x: uuid_form(x)))).alias("uuid"),
    ).where("uuid is not null and uuid <> ''")
    refs = refs.withColumn("layer", F.when(F.col("src_table") == "chunks", other["chunks"]).otherwise(other["entities"]))
    fault = F.when(F.col("removed") >= F.col("last"), "deleted").when(F.col("first") > F.col("written_at") + F.expr(f"interval {grace}"), "late")
    state = {"first": F.min("first"), "last": F.max("last"), "removed": F.max("removed")}
    found = orphans(refs, targets, ["layer", "uuid"], "simple", state, fault)
    return found.select("src_table", "vol_num", "src_uuid", F.col("uuid").alias("ref_uuid"), "reason")
