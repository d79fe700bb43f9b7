"""Cutting volumes into scenes: structure first, then meaning, then the folding of pieces that are too small or belong together."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scenograph.functions.text import SENTENCE_END, TOKEN, estimated_tokens, sentence_split, structural_split
from scenograph.functions.vectors import BUCKETS

CAP, FLOOR = 4096, 128


def sections(volumes: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, section, section_text) of every volume; blank sections are left out."""
    return volumes.select(*keys, F.posexplode(structural_split(text)).alias("section", "section_text"))


def sentences(pieces: DataFrame, keys: list[str], text: str) -> DataFrame:
    return pieces.select(*keys, F.posexplode(sentence_split(text)).alias("pos", "sentence"))


def _cut(text: str, buffer: int, share: float, known: dict[str, int]) -> list[str]:
    """The pieces of one section; `known` remembers the buckets of words."""
    parts = [x for x in re.split(SENTENCE_END, text) if x]
    counts = np.zeros((len(parts), BUCKETS))
    for i, part in enumerate(parts):
        for word in re.findall(TOKEN, part.lower()):
            if word not in known:
                if len(known) > 500_000:
                    known.clear()
                known[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % BUCKETS
            counts[i, known[word]] += 1
    if len(parts) < 2:
        return parts
    sums = np.concatenate((np.zeros((1, BUCKETS)), np.cumsum(counts, 0)))
    at = np.arange(len(parts))
    context = sums[np.minimum(at + buffer + 1, len(parts))] - sums[np.maximum(at - buffer, 0)]
    length = np.linalg.norm(context, axis=1)
    dot, norm = (context[:-1] * context[1:]).sum(1), length[:-1] * length[1:]
    distance = np.round(1 - np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0), 9)
    ends = np.flatnonzero(distance > np.percentile(distance, share * 100) + 1e-9) + 1
    return ["".join(parts[x:y]) for x, y in zip([0, *ends], [*ends, len(parts)])]


def semantic_pieces(pieces: DataFrame, keys: list[str], text: str, buffer: int = 3, share: float = 0.99) -> DataFrame:
    """(keys, piece, piece_text): a piece ends where the distance between neighbouring sentence contexts exceeds the section's percentile.

    A sentence's context is it and `buffer` sentences on each side; distance is 1 - cosine of hashed-token vectors. Pieces joined give the section. A
    section's cuts depend on it alone, so they are found where its text is and nothing is shuffled. Null and empty texts have no pieces.
    """
    rows = pieces.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("piece_text"))
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("piece", T.IntegerType()), T.StructField("piece_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            cut = [_cut(x, buffer, share, known) for x in b.column("piece_text").to_pylist()]
            row = pa.array([i for i, c in enumerate(cut) for _ in c], pa.int64())
            number = pa.array([k for c in cut for k in range(len(c))], pa.int32())
            text = pa.array([x for c in cut for x in c], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in keys), number, text], names=[*keys, "piece", "piece_text"])

    return rows.mapInArrow(run, schema)


def fold_pieces(pieces: DataFrame, keys: list[str], order: list[str], tokens: str, together: str, cap: int = CAP, floor: int = FLOOR) -> DataFrame:
    """(keys, scene_index, first, pieces, tokens): neighbouring pieces become scenes.

    A piece joins the scene before it if `together` says so (null: yes) and both are at most `cap` tokens; then scenes under `floor` tokens join the one
    before, a small first one the one after. Sizes alone stream through the fold in order, so a group of any length takes constant memory and linear time.
    """
    place = [F.col(c) for c in order]
    rows = pieces.select(*keys, *place, F.col(tokens).cast("int").alias("_t"), F.coalesce(F.col(together).cast("boolean"), F.lit(True)).alias("_j"))
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *order, "_t").select(*keys, "_t", "_j")
    schema = T.StructType([*placed.select(*keys).schema.fields, *(T.StructField(n, T.IntegerType()) for n in ("scene_index", "first", "pieces", "tokens"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = None, 0
        scene = last = None  # [first, pieces, tokens] of the scene being joined, and of the one before that may still take in small ones
        number = 0
        out: list[tuple] = []

        def absorb(s: list[int] | None) -> None:
            nonlocal last, number
            if s is not None and last is not None and (s[2] < floor or (number == 0 and last[2] < floor)):
                last[1] += s[1]
                last[2] += s[2]
                return
            if last is not None:
                number += 1
                out.append((*group, number, *last))
            last = s

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * len(schema.fields)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow)], names=arrow.names)

        arrow = to_arrow_schema(schema)
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for *key, t, j in zip(*columns):
                if key != group:
                    if group is not None:
                        absorb(scene)
                        absorb(None)
                    group, at, scene, last, number = key, 0, None, None, 0
                t = t or 0
                if scene is not None and j and scene[2] + t <= cap:
                    scene[1] += 1
                    scene[2] += t
                else:
                    if scene is not None:
                        absorb(scene)
                    scene = [at, 1, t]
                at += 1
            yield batch()
        if group is not None:
            absorb(scene)
            absorb(None)
        yield batch()

    return placed.mapInArrow(run, schema)


def split_volumes(volumes: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, section, piece, piece_text, tokens): structure, then meaning."""
    parts = semantic_pieces(sections(volumes, keys, text), [*keys, "section"], "section_text")
    return parts.withColumn("tokens", estimated_tokens("piece_text"))
