"""Filling fixed-capacity containers with texts, by best-two-fit.

Texts are measured in tokens where they are read, and only ids and sizes go further. Sizes are dealt to shards of about `shard_bins` containers by a
hash of the row, so no shard depends on how ids are spread. In a shard a container is filled greedily with the largest text that still fits; then its
smallest text gives way to two unpacked ones if together they fill the widened gap more tightly. Containers that a shard leaves less than `full` are
opened and packed again together, in as few shards as their size allows. A text is whole unless it alone exceeds a container; then it is cut into
full containers and a rest, and the rest is packed like any text.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenograph.llm.textform import slices
from scenograph.session import materialize

CAPACITY = 4096
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OPEN, ROUND = 20, 50  # bits of a container's number within its shard, and the place of the round


_encoders: dict[tuple[str, str], object] = {}  # of this worker


def tokenizer(path: str, pattern: str, vocabulary: bytes):
    import tiktoken

    if (path, pattern) not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[path, pattern] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def token_counts(df: DataFrame, item: str, text: str, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(item, n_tokens) of every row; null and empty texts have 0 tokens. The vocabulary is read on the driver and broadcast, so executors need no file."""
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, pattern, shared.value).encode_ordinary
        for b in (x for whole in batches for x in slices(whole, 1)):
            n = [len(encode(x)) if x else 0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64())], names=["item", "n_tokens"])

    return df.select(F.col(item).alias("item"), F.col(text).alias("text")).mapInArrow(run, "item long, n_tokens long")


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, from 0. Sizes lie between 1 and capacity; of equal sizes the earlier item goes first."""
    count = np.bincount(sizes, minlength=capacity + 1)
    members: list[list[int]] = []
    left = int(count.sum())
    avail = np.flatnonzero(count)  # sizes still unpacked, ascending

    def take(size: int) -> None:
        nonlocal avail, left
        count[size] -= 1
        left -= 1
        if not count[size]:
            avail = np.delete(avail, np.searchsorted(avail, size))

    def give(size: int) -> None:
        nonlocal avail, left
        count[size] += 1
        left += 1
        if count[size] == 1:
            avail = np.insert(avail, np.searchsorted(avail, size), size)

    while left:
        own: list[int] = []
        gap = capacity
        while left and gap:
            k = int(np.searchsorted(avail, gap, "right")) - 1
            if k < 0:
                break
            size = int(avail[k])
            take(size)
            own.append(size)
            gap -= size
        if gap and left > 1 and len(own) > 1:
            room = gap + own[-1]  # sizes fall, so the last is the smallest
            small = avail[: np.searchsorted(avail, room, "left")]
            if len(small):
                j = np.searchsorted(small, room - small, "right") - 1
                ok = j >= 0
                a, b = small[ok], small[j[ok]]
                once = (a == b) & (count[a] < 2)
                if once.any():  # one item cannot serve twice: take the next smaller size instead
                    j2 = j[ok] - once
                    keep = j2 >= 0
                    a, b = a[keep], small[j2[keep]]
                if len(a):
                    best = int(np.argmax(a + b))
                    if a[best] + b[best] > own[-1]:
                        give(own.pop())
                        for x in (int(a[best]), int(b[best])):
                            take(x)
                            own.append(x)
        members.append(own)
    order = np.argsort(sizes, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(sizes, minlength=capacity + 1))))
    next_of: dict[int, Iterator[int]] = {}
    out = np.empty(len(sizes), np.int64)
    for c, own in enumerate(members):
        for size in own:
            it = next_of.setdefault(size, iter(order[starts[size] : starts[size + 1]].tolist()))
            out[next(it)] = c
    return out


def _round(pieces: DataFrame, number: int, total: int, capacity: int, shard_bins: int) -> DataFrame:
    shards = max(1, math.ceil(total / (capacity * shard_bins)))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece", F.lit(number)), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        n = table.column("n_tokens").to_numpy()
        at = best_two_fit(n, capacity)
        used = np.bincount(at, weights=n).astype(np.int64)[at]
        container = at + (int(table.column("shard")[0].as_py()) << OPEN) + (number << ROUND)
        return table.select(["row", "item", "piece", "n_tokens"]).append_column("container", pa.array(container)).append_column("used", pa.array(used))

    return dealt.groupBy("shard").applyInArrow(run, "row long, item long, piece int, n_tokens long, container long, used long")


def pack(sizes: DataFrame, capacity: int = CAPACITY, shard_bins: int = 2048, full: float = 0.995) -> DataFrame:
    """sizes(item, n_tokens) -> (item, piece, first_token, n_tokens, container_id).

    piece counts from 0 within an item, first_token is the piece's place in it. Items of 0 tokens take no room: one row without container. Repeated rows
    are items of their own. An empty table gives an empty result. Each shard holds about capacity * shard_bins tokens (items of 1 token at worst).
    """
    rows = materialize(sizes.select("item", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")), "sizes").withColumn("row", F.monotonically_increasing_id())
    empty = rows.where("n_tokens <= 0").select("item", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("container_id"))
    pieces = rows.where("n_tokens > 0").select("row", "item", F.posexplode(F.expr(f"transform(sequence(0L, (n_tokens - 1) div {capacity}), i -> least({capacity}L, n_tokens - i * {capacity}L))")).alias("piece", "n_tokens"))
    total = pieces.agg(F.sum("n_tokens")).first()[0] or 0
    # a piece that fills a container is not packed
    whole = pieces.where(F.col("n_tokens") == capacity).select("row", "item", "piece", "n_tokens", F.monotonically_increasing_id().alias("container"))
    rest = pieces.where(F.col("n_tokens") < capacity)
    first = materialize(_round(rest, 1, total, capacity, shard_bins), "packed")
    loose = first.where(F.col("used") < full * capacity)
    open_total = loose.agg(F.sum("n_tokens")).first()[0] or 0
    second = _round(loose.drop("container", "used"), 2, open_total, capacity, shard_bins)
    packed = whole.withColumn("container", -1 - F.col("container")).unionByName(first.where(F.col("used") >= full * capacity).drop("used")).unionByName(second.drop("used"))
    out = packed.select("item", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), "n_tokens", F.col("container").alias("container_id"))
    return out.unionByName(empty)


def packed_documents(documents: DataFrame, item: str = "doc_id", text: str = "text", path: str = TOKENIZER, **how) -> DataFrame:
    """Documents of any length assigned to containers; see pack()."""
    return pack(token_counts(documents, item, text, path), **how)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per container: items, tokens and unused room."""
    return packed.where("container_id is not null").groupBy("container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens")).withColumn("unused", F.lit(capacity) - F.col("tokens"))
