"""Evaluation texts leaking into training text, by q-gram lemma filtering.

Passages and documents are brought to one stream form: the consistent form of text, lower case, letters and digits only, words apart by one blank, no
blank between ideographs. A run of n characters with at most k edits keeps at least n - q + 1 - kq of its character q-grams, and these lie on diagonals
(place in the document minus place in the passage) at most k apart. So shared q-grams are counted in overlapping diagonal bands of width 2(k + 1);
bands that reach the bound of the passage's shortest run are kept, and verified by a banded alignment. An exact check of runs may follow.
q is at most the run's length over k + 1, so the bound is at least 1 and no run escapes it.

Only passages of which a document holds an anchor are counted: of the q-grams of each run the kq + 1 that the fewest passages hold, one of which survives
k edits. So a line that many passages begin with costs nothing in documents that hold that line alone.

The passages' q-grams are sorted arrays broadcast in blocks of at most `block_chars` characters, one block at a time, so what a broadcast holds is bounded
however many passages there are; each block reads all documents. Documents are never shuffled for the search, and each is searched whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenograph.llm import textform
from scenograph.session import materialize

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BLANK = 0x20


@dataclass(frozen=True)
class Rule:
    """When a passage counts as contained. Runs are in words, or in ideographs for passages in Chinese."""

    words: int = 13
    ideographs: int = 24
    q: int = 24  # of texts in words
    q_ideographs: int = 12
    edits: int = 0  # edits allowed within a run by filter and alignment
    block_chars: int = 4_000_000


@functools.cache
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, BASE, np.uint64))), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    return _powers(1 << max(10, int(n).bit_length()))[:n]


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and offsets of the texts in stream form. Null and blank texts give empty streams."""
    t = textform.tables()
    cps, offs, _ = textform.normalize_points(*textform.points(texts))
    if not len(cps):
        return cps, offs
    row_start = np.zeros(len(cps) + 1, bool)
    row_start[offs] = True
    row_start = row_start[:-1]
    cls = t.cls[cps]
    alnum = ((cls & textform.ALNUM) != 0) | ((cls & textform.MARK) != 0)
    keep = np.flatnonzero(alnum)
    kept = t.lower[cps[keep]]
    gap = np.ones(len(keep), bool)  # whether something stood between a kept character and the one before
    gap[1:] = np.diff(keep) > 1
    han = (cls[keep] & textform.HAN) != 0
    inner = np.zeros(len(keep), bool)
    inner[1:] = han[1:] & han[:-1]
    kept_offs = np.concatenate(([0], np.cumsum(alnum)))[offs]
    first = np.zeros(len(keep) + 1, bool)
    first[kept_offs] = True
    blank = gap & ~inner & ~first[:-1]
    n = 1 + blank.astype(np.int64)
    out = np.full(int(n.sum()), BLANK, np.uint32)
    ends = np.concatenate(([0], np.cumsum(n)))
    out[ends[1:] - 1] = kept
    return out, ends[kept_offs]


def gram_hashes(cps: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit rolling hash of each run of q characters (by start); len(cps) - q + 1 of them."""
    n = len(cps)
    if n < q:
        return np.zeros(0, np.uint64)
    # times a falling power, so that equal runs have equal hashes wherever they stand
    h = np.zeros(n - q + 1, np.uint64)
    chunk = 1 << 20
    for a in range(0, n - q + 1, chunk):
        b = min(n - q + 1, a + chunk)
        part = cps[a : b + q - 1].astype(np.uint64) + np.uint64(1)
        p = powers(len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * p[: len(part)], dtype=np.uint64)))
        inverse = powers_inverse(b - a)
        h[a:b] = (sums[q:] - sums[:-q]) * inverse
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


@functools.cache
def _powers_inverse(n: int) -> np.ndarray:
    inv = np.uint64(pow(int(BASE), -1, 1 << 64))
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, inv, np.uint64))), dtype=np.uint64)


def powers_inverse(n: int) -> np.ndarray:
    return _powers_inverse(1 << max(10, int(n).bit_length()))[:n]


@dataclass
class Index:
    """The q-grams of one block of passages."""

    kinds: list  # (q, sorted hashes, passage, place, bitmap, whether an anchor)
    ids: np.ndarray
    text: list[np.ndarray]
    shortest: np.ndarray  # characters of the shortest run that counts
    bound: np.ndarray  # q-grams a region must share
    chinese: np.ndarray


def build_index(ids: list[int], passages: list[str | None], chinese: list[bool], rule: Rule) -> Index:
    """Passages too short to hold a run get no q-grams and are never found."""
    cps, offs = stream(pa.array(passages, pa.string()))
    text = [cps[a:b] for a, b in zip(offs[:-1], offs[1:])]
    shortest, bound = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    by_q: dict[int, list[int]] = {}
    for i, x in enumerate(text):
        q = rule.q_ideographs if chinese[i] else rule.q
        if chinese[i]:
            length = rule.ideographs if len(x) >= rule.ideographs else 0
        else:
            starts = np.concatenate(([0], np.flatnonzero(x == BLANK) + 1, [len(x) + 1]))
            length = int((starts[rule.words :] - 1 - starts[: -rule.words]).min()) if len(starts) > rule.words else 0
        if not length:
            continue
        while q > 1 and length < q * (rule.edits + 1):
            q //= 2
        shortest[i], bound[i] = length, max(1, length - q + 1 - rule.edits * q)
        by_q.setdefault(q, []).append(i)
    kinds = []
    for q, own in by_q.items():
        grams = [gram_hashes(text[i], q) for i in own]
        h = np.concatenate(grams)
        o = np.repeat(np.array(own, np.int64), [len(g) for g in grams])
        p = np.concatenate([np.arange(len(g), dtype=np.int64) for g in grams])
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        cuts = np.cumsum([len(g) for g in grams])[:-1]
        anchor = np.concatenate([_anchors(c, int(shortest[i]) - q + 1, rule.edits * q + 1) for i, c in zip(own, np.split(counts[inverse], cuts))])
        order = np.lexsort((p, o, h))
        bits = np.zeros(1 << 22, bool)
        bits[(h >> np.uint64(42)).astype(np.int64)] = True
        kinds.append((q, h[order], o[order], p[order], bits, anchor[order]))
    return Index(kinds, np.array(ids, np.int64), text, shortest, bound, np.array(chinese))


def _anchors(counts: np.ndarray, window: int, most: int) -> np.ndarray:
    """Which q-grams are among the `most` rarest of some `window` neighbours (all, if there are no more)."""
    n = len(counts)
    if window <= most or n <= window:
        return np.ones(n, bool) if window <= most else np.isin(np.arange(n), np.argsort(counts, kind="stable")[:most])
    out = np.zeros(n, bool)
    rank = counts.astype(np.int64) * n + np.arange(n)
    views = np.lib.stride_tricks.sliding_window_view(rank, window)
    for a in range(0, len(views), 1 << 14):
        out[np.unique(np.partition(views[a : a + (1 << 14)], most - 1, axis=1)[:, :most] % n)] = True
    return out


def _runs(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... (n of them), one after another."""
    return np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _postings(hashes: np.ndarray, owner: np.ndarray, anchor: np.ndarray, h: np.ndarray, doc: np.ndarray, few: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(hit, posting) of the passages of which the hit's document holds an anchor. Postings of q-grams that more than `few` share are looked up per passage."""
    at = np.flatnonzero(anchor)
    low, high = (np.searchsorted(hashes[at], h, side) for side in ("left", "right"))
    first = _runs(low, high - low)
    items = int(owner.max()) + 1
    pairs = np.unique(np.repeat(doc, high - low) * items + owner[at[first]])
    low, n = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
    n -= low
    rare = np.flatnonzero(n <= few)
    j = _runs(low[rare], n[rare])
    hit = np.repeat(rare, n[rare])
    k = np.searchsorted(pairs, key := doc[hit] * items + owner[j])
    k[k == len(pairs)] = 0
    ok = pairs[k] == key if len(pairs) else np.zeros(len(key), bool)
    hits, posts = [hit[ok]], [j[ok]]
    hot = np.flatnonzero(n > few)
    if len(hot) and len(pairs):
        a, b = (np.searchsorted(pairs, (doc[hot] + k) * items) for k in (0, 1))
        cand = pairs[_runs(a, b - a)] % items
        hit = np.repeat(hot, b - a)
        start = np.searchsorted(hashes, hashes, "left")
        composite = start * items + owner
        want = low[hit] * items + cand
        x, y = np.searchsorted(composite, want, "left"), np.searchsorted(composite, want, "right")
        hits.append(np.repeat(hit, y - x))
        posts.append(_runs(x, y - x))
    return np.concatenate(hits), np.concatenate(posts)


def regions(cps: np.ndarray, offs: np.ndarray, index: Index, edits: int) -> np.ndarray:
    """Rows (document, passage, first and last place in the document, lowest and highest diagonal) of the bands that reach their bound."""
    found = []
    width = 2 * (edits + 1)
    for q, hashes, owner, place, bits, anchor in index.kinds:
        h = gram_hashes(cps, q)
        at = np.flatnonzero(bits[(h >> np.uint64(42)).astype(np.int64)])
        if not len(at):
            continue
        k = np.searchsorted(hashes, h[at])
        k[k == len(hashes)] = 0
        at = at[hashes[k] == h[at]]
        doc = np.searchsorted(offs, at, "right") - 1
        inside = at + q <= offs[doc + 1]  # a q-gram across two texts is none
        at, doc = at[inside], doc[inside]
        if not len(at):
            continue
        hit, j = _postings(hashes, owner, anchor, h[at], doc)
        if not len(hit):
            continue
        pos, doc, item = at[hit], doc[hit], owner[j]
        diagonal = pos - offs[doc] - place[j] + (1 << 20)  # passages are far shorter than this shift
        for shift in (0, width // 2):  # bands overlap by half, so diagonals at most width / 2 apart meet in one
            band = (diagonal + shift) // width
            order = np.lexsort((pos, band, item, doc))
            d, i, b, p, g = doc[order], item[order], band[order], pos[order], diagonal[order]
            edge = np.ones(len(d), bool)
            edge[1:] = (np.diff(d) != 0) | (np.diff(i) != 0) | (np.diff(b) != 0) | (np.diff(p) > 4096)
            start = np.flatnonzero(edge)
            distinct = np.add.reduceat((edge | np.concatenate(([True], np.diff(p) != 0))).astype(np.int64), start)
            last = np.concatenate((start[1:], [len(d)])) - 1
            ok = distinct >= index.bound[i[start]]
            s, e = start[ok], last[ok]
            if len(s):
                lo, hi = np.minimum.reduceat(g, start)[ok], np.maximum.reduceat(g, start)[ok]
                found.append(np.stack((d[s], i[s], p[s] - offs[d[s]], p[e] + q - offs[d[e]], lo - (1 << 20), hi - (1 << 20)), 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 6), np.int64)


def banded_alignment(doc: np.ndarray, passage: np.ndarray, low: int, high: int, edits: int, length: int) -> bool:
    """Whether some `length` characters of the passage align with the document within `edits` edits, on diagonals low - edits to high + edits.

    Local alignment by furthest reach: for each edit count the furthest matching run on each diagonal; a run of `length` within the budget ends the search.
    """
    a, b = low - edits, high + edits
    best = {}
    for g in range(a, b + 1):
        lo, hi = max(0, -g), min(len(passage), len(doc) - g)
        if hi <= lo:
            continue
        differ = np.flatnonzero(passage[lo:hi] != doc[lo + g : hi + g])
        cuts = np.concatenate(([-1], differ, [hi - lo])) + lo
        best[g] = cuts
        step = min(edits + 1, len(cuts) - 1)
        if (cuts[step:] - cuts[:-step] - 1).max() >= length:  # substitutions only: a window over the mismatches
            return True
    if not edits:
        return False
    # insertions and deletions: dynamic programming over the band, edits so far against passage consumed
    for g0 in best:
        cuts = best[g0]
        for c in cuts[:-1]:
            reach = {g0: int(c) + 1}
            for k in range(edits + 1):
                reach = {g: _slide(doc, passage, g, x) for g, x in reach.items()}
                if any(x - (int(c) + 1) >= length for x in reach.values()):
                    return True
                if k == edits:
                    break
                grown: dict[int, int] = {}
                for g, x in reach.items():
                    for g2, x2 in ((g, x + 1), (g + 1, x), (g - 1, x + 1)):
                        if a <= g2 <= b and x2 <= len(passage):
                            grown[g2] = max(grown.get(g2, 0), x2)
                reach = grown
    return False


def verified(doc: np.ndarray, passage: np.ndarray, start: int, end: int, low: int, high: int, edits: int, length: int) -> bool:
    """banded_alignment() around a region: a run that shares a q-gram of it lies within `length` and the edits of its ends."""
    a, b = max(0, start - length - edits), min(len(doc), end + length + edits)
    c, e = max(0, a - high - edits), max(0, min(len(passage), b - low + edits))
    return banded_alignment(doc[a:b], passage[c:e], low - a + c, high - a + c, edits, length)


def _slide(doc: np.ndarray, passage: np.ndarray, g: int, x: int) -> int:
    """The place in the passage where the run of equal characters on diagonal g from x ends."""
    n = min(len(passage), len(doc) - g)
    if x + g < 0 or x >= n:
        return x
    differ = passage[x:n] != doc[x + g : n + g]
    return int(x + differ.argmax()) if differ.any() else n


def longest_run(doc: np.ndarray, passage: np.ndarray, low: int, high: int, chinese: bool) -> int:
    """Most consecutive words (ideographs for Chinese) that document and passage share on the diagonals low to high."""
    t = textform.tables()
    most = 0
    for g in range(low, high + 1):
        lo, hi = max(0, -g), min(len(passage), len(doc) - g)
        if hi <= lo:
            continue
        a, b = passage[lo:hi], doc[lo + g : hi + g]
        same = a == b
        if chinese:
            same &= (t.cls[a] & textform.HAN) != 0
            cuts = np.concatenate(([-1], np.flatnonzero(~same), [len(a)]))
            most = max(most, int((np.diff(cuts) - 1).max()))
            continue
        cuts = np.concatenate(([-1], np.flatnonzero(~same), [len(a)]))
        for k in np.flatnonzero(np.diff(cuts) > 12):
            x, y = lo + int(cuts[k]) + 1, lo + int(cuts[k + 1])
            run = passage[x:y]
            # words count only if whole on both sides
            whole_left = (x == 0 or passage[x - 1] == BLANK) and (x + g == 0 or doc[x + g - 1] == BLANK)
            whole_right = (y == len(passage) or passage[y] == BLANK) and (y + g == len(doc) or doc[y + g] == BLANK)
            blanks = np.flatnonzero(run == BLANK)
            words = len(blanks) + 1
            words -= (not whole_left) + (not whole_right)
            if run[0] == BLANK:
                words -= whole_left
            if run[-1] == BLANK:
                words -= whole_right
            most = max(most, words)
    return most


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", rule: Rule = Rule(), exact: bool = True) -> DataFrame:
    """(doc_id, item_id) of the documents that contain a run of a passage.

    exact: the run holds as many equal consecutive words or ideographs as the rule says; else it is a region within the edit budget. A passage counts as
    Chinese if most of its letters are ideographs. Null or empty texts and passages contain nothing; repeated rows of a document or item count once.
    The items are a stated query set: they are read in blocks, each of bounded size, and each block meets all documents.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id).alias("i"), F.col(passage).alias("p")).distinct()
    done: list[DataFrame] = []
    last = None

    def settled(found: DataFrame, shared) -> DataFrame:
        out = materialize(found, "leaked")
        shared.destroy()
        return out

    for block in _blocks(rows, rule.block_chars):
        if last:
            done.append(settled(*last))
        last = _search(spark, docs, block, rule, exact)
    if not last:
        return spark.createDataFrame([], "doc_id long, item_id long")
    out = reduce(DataFrame.unionByName, [*done, settled(*last)]) if done else last[0]
    return out.distinct()


def _blocks(rows: DataFrame, most: int) -> Iterator[list]:
    """The items in blocks of at most `most` characters (or one item), one block on the driver at a time."""
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r["p"]) > most:
            yield block
            block, size = [], 0
        block.append((r["i"], r["p"]))
        size += len(r["p"])
    if block:
        yield block


def _search(spark, docs: DataFrame, block: list, rule: Rule, exact: bool) -> tuple[DataFrame, Broadcast]:
    cps, offs = stream(pa.array([p for _, p in block], pa.string()))
    han = (textform.tables().cls[cps] & textform.HAN) != 0
    share = np.concatenate(([0], np.cumsum(han)))
    chinese = [bool((share[b] - share[a]) * 2 > b - a) for a, b in zip(offs[:-1], offs[1:])]
    shared = spark.sparkContext.broadcast(build_index([i for i, _ in block], [p for _, p in block], chinese, rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for b in (x for whole in batches for x in textform.slices(whole, 1)):
            cps, offs = stream(b.column(1))
            hits: set[tuple[int, int]] = set()
            for d, i, start, end, low, high in regions(cps, offs, index, rule.edits).tolist():
                if (d, i) in hits:
                    continue
                doc, passage = cps[offs[d] : offs[d + 1]], index.text[i]
                if not verified(doc, passage, start, end, low, high, rule.edits, int(index.shortest[i])):
                    continue
                zh = bool(index.chinese[i])
                if not exact or longest_run(doc, passage, low, high, zh) >= (rule.ideographs if zh else rule.words):
                    hits.add((d, i))
            rows = sorted(hits)
            ids = b.column(0).take(pa.array([d for d, _ in rows], pa.int64())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(index.ids[[i for _, i in rows]] if rows else [], pa.int64())], names=["doc_id", "item_id"])

    return docs.mapInArrow(run, "doc_id long, item_id long"), shared
