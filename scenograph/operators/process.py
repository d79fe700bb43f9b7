"""The entity flow: mentions of a novel in order, each searched among the entities written so far, merged or made new, guarded and written back.

What one mention writes the next one sees, so the work of a novel is a sequence. Novels are spread over tasks; a task streams its mentions, sorted, and holds
only the entities of the novel it is at that may still change, never the mentions.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenograph.config import Settings
from scenograph.functions.predicates import NO_CONTEXT, valid_context, valid_keyword
from scenograph.functions.text import TOKEN
from scenograph.functions.vectors import BUCKETS
from scenograph.operators.links import chunk_uuid

ORDER = ["vol_num", "scene_index", "ordinal"]
STEPS = "mention_id string, entity int, merged boolean, candidates int, tainted boolean, reason string"
ENTITIES = "novel_hash string, entity int, entity_type string, keyword string, aliases array<string>, categories array<string>, appeared_in array<int>, chunk_refs array<string>, description string, tainted boolean, reason string, mentions int"


@dataclass
class Mention:
    id: str
    vol: int
    scene: int
    keyword: str
    aliases: list[str]
    categories: list[str]
    type: str
    context: str
    chunk: str


@dataclass
class Entity:
    number: int
    type: str
    keyword: str
    aliases: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    appeared_in: list[int] = field(default_factory=list)
    chunk_refs: list[str] = field(default_factory=list)
    description: str = ""
    tainted: bool = False
    reason: str = ""
    mentions: int = 0


def plain(name: str) -> str:
    return name.strip(" ").lower()


class ByName:
    """Candidates are entities that have the mention's keyword, case and blanks aside, among their names; the oldest comes first."""

    def __init__(self, settings: Settings) -> None:
        self.names: dict[str, list[Entity]] = {}

    def find(self, m: Mention) -> list[tuple[Entity, int]]:
        return [(e, 1) for e in self.names.get(plain(m.keyword), []) if not e.tainted]

    def written(self, e: Entity) -> None:
        for name in {plain(x) for x in (e.keyword, *e.aliases)}:
            held = self.names.setdefault(name, [])
            if e not in held:
                held.append(e)
                held.sort(key=lambda x: x.number)


_tokens = re.compile(TOKEN).findall


@lru_cache(1 << 16)
def _bucket(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % BUCKETS


def _vector(text: str) -> np.ndarray:
    v = np.bincount(np.array([_bucket(t) for t in _tokens(text.lower())], np.int64), minlength=BUCKETS).astype(float)
    return v / max(math.sqrt(v.dot(v)), 1e-300)


_name_vector = lru_cache(1 << 12)(_vector)


class ByGate:
    """Candidates by the two tracks: vectors of names, of the same type where there is any, and of the told text, of the same type; the gate decides.

    Only entities that are not tainted are held, in order of creation: a tainted one is never found, so never written again. Word frequencies over a table
    that every step changes are not kept, so the told track is its vector alone.
    """

    def __init__(self, settings: Settings) -> None:
        self.s = settings
        self.entities: list[Entity] = []
        self.numbers: list[int] = []
        self.kinds: dict[str, int] = {}
        self.types, self.name, self.told = np.zeros(64, np.int64), np.zeros((64, BUCKETS)), np.zeros((64, BUCKETS))

    def vector(self, name: str) -> np.ndarray:
        return _name_vector(name)

    def find(self, m: Mention) -> list[tuple[Entity, int]]:
        n = len(self.entities)
        if not n:
            return []
        same = self.types[:n] == self.kinds.get(plain(m.type), -1)
        a, b = self.name[:n] @ self.vector(m.keyword), self.told[:n] @ _vector(f"{m.keyword} {m.context[:400]}")
        near = a > 0
        pool = near & same if (near & same).any() else near
        both = np.stack((np.where(pool, np.maximum(0, 1 - (1 - a) / 2), 0), np.where(same, b, 0)))
        order = np.argsort(-np.round(both, 9), axis=1, kind="stable")[:, : self.s.top_k].tolist()
        sure, content = both.tolist()
        letters, found = set(m.keyword.lower()) - {" "}, []
        for i in {i for i in order[0] if sure[i] > 0} | {i for i in order[1] if content[i] > 0}:
            overlap = not letters.isdisjoint(self.entities[i].keyword.lower())
            rule = 1 if sure[i] >= self.s.identity_strong else 2 if overlap and sure[i] >= self.s.identity_keep else 3 if overlap and content[i] >= self.s.content_least else 4 if content[i] >= self.s.content_strong else 0
            if rule:
                found.append((-round(sure[i] if rule <= 2 else content[i], 9), i, rule))
        return [(self.entities[i], rule) for _, i, rule in sorted(found)[: self.s.top_k]]

    def written(self, e: Entity) -> None:
        n = len(self.entities)
        i = bisect_left(self.numbers, e.number)
        held = i < n and self.numbers[i] == e.number
        if e.tainted:
            if held:
                del self.entities[i], self.numbers[i]
                for x in (self.types, self.name, self.told):
                    x[i : n - 1] = x[i + 1 : n]
            return
        if not held:  # the newest: the last
            self.entities.append(e)
            self.numbers.append(e.number)
            if i == len(self.name):
                self.types, self.name, self.told = (np.concatenate((x, np.zeros_like(x))) for x in (self.types, self.name, self.told))
        self.types[i] = self.kinds.setdefault(plain(e.type), len(self.kinds))
        self.name[i], self.told[i] = _vector(" ".join((e.keyword, *e.aliases))), _vector(e.description)


def _union(*lists: list[str]) -> list[str]:
    return list(dict.fromkeys(x for xs in lists for x in xs if x))


def step(m: Mention, search: ByName | ByGate, count: int, s: Settings, gate_names: bool) -> tuple[Entity | None, bool, int]:
    """(entity, whether it was there before, number of candidates): None where the last guard refuses what would be written.

    The decision: the first candidate by a strict rule (1 or 2) is the entity, else a new one is made. The old name stays unless it is unknown, the old type
    stays and a new one becomes a category, names and categories are united, told text is added. More names, a longer description or a name too far away
    than one entity has taint it, and no later mention finds it.
    """
    candidates = search.find(m)
    old = next((e for e, rule in candidates[:1] if rule <= 2), None)
    e = old or Entity(count + 1, m.type, m.keyword)
    if any(v.strip().upper() in NO_CONTEXT for v in (e.keyword, f"{e.description} {m.context}")):
        return None, False, len(candidates)
    reasons = []
    before = e.keyword
    if old:
        if "未知" in e.keyword:
            e.keyword = m.keyword
        if e.type and m.type and plain(e.type) != plain(m.type):
            e.categories = _union(e.categories, [m.type])
    e.type = e.type or m.type
    known = {plain(e.keyword), *map(plain, e.aliases)}
    for a in (m.keyword, *m.aliases):  # a name that lost to the old one becomes one more
        if a and plain(a) not in known:
            e.aliases.append(a)
            known.add(plain(a))
    e.categories = _union(e.categories, m.categories)
    e.description = f"{e.description} {m.context}" if e.description else m.context
    e.appeared_in = _union(e.appeared_in, [m.scene] if m.scene > 0 else [])
    e.chunk_refs = _union(e.chunk_refs, [m.chunk])
    e.mentions += 1
    if len(e.aliases) > s.most_aliases:
        reasons.append(f"aliases {len(e.aliases)}")
    if len(e.description) > s.longest_description:
        reasons.append(f"description {len(e.description)}")
    if gate_names and old and plain(before) != plain(m.keyword):
        cosine = float(search.vector(before) @ search.vector(m.keyword))
        if cosine < s.least_name_cosine:
            reasons.append(f"cosine {cosine:.2f}")
    e.tainted, e.reason = bool(reasons), ", ".join(reasons)
    search.written(e)
    return e, old is not None, len(candidates)


def _ordered(mentions: DataFrame) -> DataFrame:
    """One row a place, the least by its values; mentions that name or tell nothing are left out."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    many = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
    kept = mentions.where(valid_keyword() & valid_context() & F.col("novel_hash").isNotNull())
    one = kept.groupBy("novel_hash", *ORDER).agg(F.min(F.struct(text("keyword"), text("mention_type"), text("context_summary"), many("aliases"), many("categories"))).alias("r")).select("novel_hash", *ORDER, "r.*")
    rows = one.withColumn("mention_id", F.concat_ws(":", "novel_hash", *ORDER)).withColumn("chunk", chunk_uuid())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number is not coalesced: a task's time goes by novels, not by bytes
    return rows.repartition(parts, "novel_hash").sortWithinPartitions("novel_hash", *ORDER)


def _run(mentions: DataFrame, search: Callable, settings: Settings, schema: str, whole: bool) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", schema)]
    gate_names = search is ByGate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novel, found, count, held, out = None, None, 0, {}, []

        def give(entities: Iterable[Entity]) -> None:
            out.extend((novel, e.number, e.type, e.keyword, e.aliases, e.categories, e.appeared_in, e.chunk_refs, e.description, e.tainted, e.reason, e.mentions) for e in entities)

        def batch() -> pa.RecordBatch:
            strings, ints = pa.list_(pa.string()), pa.list_(pa.int32())
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), strings, strings, ints, strings, pa.string(), pa.bool_(), pa.string(), pa.int32()] if whole else [pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.bool_(), pa.string()]
            rows = list(zip(*out)) or [()] * len(types)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

        for b in batches:
            for r in b.to_pylist():
                if r["novel_hash"] != novel:
                    give(held.values())
                    novel, found, count, held = r["novel_hash"], search(settings), 0, {}
                m = Mention(r["mention_id"], r["vol_num"] or 0, r["scene_index"] or 0, r["keyword"], [x for x in r["aliases"].split("|") if x], [x for x in r["categories"].split("|") if x], r["mention_type"], r["context_summary"], r["chunk"])
                e, merged, candidates = step(m, found, count, settings, gate_names)
                count += e is not None and not merged
                if not whole:
                    out.append((m.id, e.number if e else None, merged, candidates, e.tainted if e else False, e.reason if e else ""))
                elif e is not None and e.tainted:  # nothing finds it again
                    held.pop(e.number, None)
                    give([e])
                elif e is not None:
                    held[e.number] = e
            yield batch()
        give(held.values())
        yield batch()

    return _ordered(mentions).mapInArrow(run, schema)


def resolution_steps(mentions: DataFrame, search: Callable = ByGate, settings: Settings = Settings()) -> DataFrame:
    """What became of each mention: (mention_id, entity, merged, candidates, tainted, reason), entity being a number within the novel in order of creation."""
    return _run(mentions, search, settings, STEPS, whole=False)


def resolved_entities(mentions: DataFrame, search: Callable = ByGate, settings: Settings = Settings()) -> DataFrame:
    """The entities of each novel after its last mention."""
    return _run(mentions, search, settings, ENTITIES, whole=True)
