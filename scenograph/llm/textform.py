"""One consistent form of text, worked out on code-point arrays.

A batch of Arrow strings is copied into one array of code points. Lookup tables give each character's class and replacement, expansion offsets
place replacements longer than one character, and combining marks are reordered and composed with whole-array steps, so no string call is made
per row. Rows without any unusual character, nearly all of them, leave after the first lookup.

The form: compatibility forms of letters, digits and ideographs become the ordinary ones, marks are composed (Unicode NFC), invisible characters
vanish, unusual spaces become U+0020, and letters of another script that stand for look-alike Latin ones inside a Latin word become Latin. Line ends,
U+3000, full-width punctuation and middle dots stay.
Null stays null, an empty text stays empty, repeated rows give the same result, texts of any length are handled whole.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIMIT = 0x110000
#: Classes of characters as bits.
LATIN, FOREIGN, WORD, MARK, HIDDEN, SPACE, COMPAT, HAN, ALNUM, KANA = (1 << i for i in range(10))
SPECIAL = FOREIGN | MARK | HIDDEN | SPACE | COMPAT | KANA

# Letters of other scripts that look like Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "т": "t", "у": "y", "ү": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ё": "ë", "ї": "ï",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V", "Ӏ": "I",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "յ": "j", "ո": "n", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L",
}

# Katakana that look like ideographs.
KANA_LOOKALIKES = {"ロ": "口", "ニ": "二", "ハ": "八", "カ": "力", "エ": "工", "タ": "夕", "ト": "卜", "オ": "才", "ミ": "三", "ヌ": "又", "チ": "千", "ム": "厶"}

#: Blocks without any compatibility form; left out to build the tables quickly.
_PLAIN = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xD800, 0xF900), (0x17000, 0x1D000), (0x20000, 0x2F800), (0x2FA20, 0xE0000), (0xE01F0, LIMIT))


class Tables:
    """Lookup tables over all code points, made once in a worker."""

    def __init__(self) -> None:
        cls = np.zeros(LIMIT, np.uint16)
        lower = np.arange(LIMIT, dtype=np.uint32)
        ccc = np.zeros(LIMIT, np.uint8)
        full: list[int] = []
        self.at = np.zeros(LIMIT, np.int32)
        self.width = np.ones(LIMIT, np.int32)
        self.base_at = np.zeros(LIMIT, np.int32)
        self.base_width = np.zeros(LIMIT, np.int32)
        look = np.zeros(LIMIT, np.uint32)
        pairs: dict[int, int] = {}
        for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x2FA20), (0x30000, 0x323B0)):
            cls[a:b] |= HAN | ALNUM
        cls[0xAC00:0xD7A4] |= ALNUM
        skip = np.zeros(LIMIT, bool)
        for a, b in _PLAIN:
            skip[a:b] = True
        for cp in np.flatnonzero(~skip).tolist():
            ch = chr(cp)
            cat = unicodedata.category(ch)
            if cat == "Cn":
                continue
            ccc[cp] = unicodedata.combining(ch)
            name = unicodedata.name(ch, "") if cat[0] == "L" else ""
            small = ch.lower()
            if len(small) == 1:
                lower[cp] = ord(small)
            if cat[0] in "LN":
                cls[cp] |= ALNUM
            if cat[0] in "LMN":
                cls[cp] |= WORD
            if name.startswith(("LATIN ", "FULLWIDTH LATIN")) or cp in (0xAA, 0xBA):
                cls[cp] |= LATIN
            elif name.startswith(("CYRILLIC", "GREEK", "ARMENIAN")):
                cls[cp] |= FOREIGN
            elif name.startswith(("CJK UNIFIED", "CJK COMPAT", "KANGXI")) or cp == 0x3007:
                cls[cp] |= HAN
            if cat[0] == "M":
                cls[cp] |= MARK
            elif cat == "Cf" or (cat == "Cc" and ch not in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85") or cp in (0x115F, 0x1160, 0x3164, 0xFFA0):
                cls[cp] |= HIDDEN
            elif cat == "Zs" and cp not in (0x20, 0x3000):
                cls[cp] |= SPACE
            compat = unicodedata.normalize("NFKC", ch)
            if compat != ch and cat[0] not in "ZCM" and self._ordinary(cat, compat):
                cls[cp] |= COMPAT
                self.at[cp], self.width[cp] = len(full), len(compat)
                full += map(ord, compat)
                if any(unicodedata.name(c, "").startswith("LATIN ") for c in compat):
                    cls[cp] |= LATIN
            source = compat if cls[cp] & COMPAT else ch
            base = unicodedata.normalize("NFD", source)
            if base != source:
                self.base_at[cp], self.base_width[cp] = len(full), len(base)
                full += map(ord, base)
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
                pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = cp
        for a, b in (LOOKALIKES | KANA_LOOKALIKES).items():
            look[ord(a)] = ord(b)
        for a in KANA_LOOKALIKES:
            cls[ord(a)] |= KANA
        self.cls, self.lower, self.ccc, self.look = cls, lower, ccc, look
        self.full = np.array(full or [0], np.uint32)
        keys = np.array(sorted(pairs), np.uint64)
        self.pair_keys, self.pair_to = keys, np.array([pairs[int(k)] for k in keys], np.uint32)
        self.follows = ccc > 0
        self.follows[(keys & np.uint64(0x1FFFFF)).astype(np.int64)] = True
        self.follows[0x1161:0x1176] = self.follows[0x11A8:0x11C3] = True

    @staticmethod
    def _ordinary(cat: str, compat: str) -> bool:
        """Whether a compatibility form is one of letters, digits or ideographs; punctuation and other symbols keep their form."""
        return cat[0] in "LN" or any(unicodedata.category(c)[0] in "LN" and not 0x3040 <= ord(c) < 0x3100 for c in compat)


@functools.cache
def tables() -> Tables:
    return Tables()


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the offsets of the texts in it. Nulls count as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cps) == len(raw):
        return cps, offs - offs[0]
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return cps, starts[offs - offs[0]]


def strings(cps: np.ndarray, offs: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The reverse of points()."""
    text = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    raw = np.frombuffer(text, np.uint8)
    starts = np.concatenate((np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)])).astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(starts[offs].tobytes()), pa.py_buffer(text))
    if null is not None and null.any():
        out = pc.if_else(pa.array(null), pa.scalar(None, pa.large_string()), out)
    return out


def _expand(cps: np.ndarray, at: np.ndarray, width: np.ndarray, hit: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each hit by its run in `full`; also the new place of each old character, with the end."""
    n = np.ones(len(cps), np.int64)
    n[hit] = width[cps[hit]]
    place = np.concatenate(([0], np.cumsum(n)))
    out = np.repeat(cps, n)
    k = np.flatnonzero(hit)
    if len(k):
        w = n[k]
        inner = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        out[np.repeat(place[k], w) + inner] = full[np.repeat(at[cps[k]].astype(np.int64), w) + inner]
    return out, place


def _pair(t: Tables, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The composed form of each pair of characters, 0 where there is none."""
    key = (a.astype(np.uint64) << np.uint64(21)) | b.astype(np.uint64)
    j = np.searchsorted(t.pair_keys, key)
    j[j == len(t.pair_keys)] = 0
    to = np.where(t.pair_keys[j] == key, t.pair_to[j], 0)
    # Hangul syllables are composed by rule: leading consonant, vowel, trailing consonant
    a, b = a.astype(np.int64), b.astype(np.int64)
    lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
    to = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, to)
    lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
    return np.where(lvt, a + b - 0x11A7, to).astype(np.uint32)


def _compose(t: Tables, cps: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Canonical order and composition within runs of marks; gives the composed code points, with LIMIT where one was taken in."""
    n = len(cps)
    ccc = t.ccc[cps]
    follows = t.follows[cps]
    follows[0] = False
    follows[1:] &= row[1:] == row[:-1]
    free = np.flatnonzero(follows & (ccc == 0))  # a follower of class 0 joins only the character just before it
    if len(free):
        tail = (cps[free] >= 0x11A8) & (cps[free] < 0x11C3) & (cps[free - 1] >= 0x1161) & (cps[free - 1] < 0x1176)
        follows[free] = (_pair(t, cps[free - 1], cps[free]) > 0) | tail
    if not follows.any():
        return cps
    # stable order by class within each stretch of marks (class 0 ends a stretch)
    odd = np.flatnonzero((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (row[1:] == row[:-1]))
    if len(odd):
        stretch = np.cumsum((ccc == 0) | np.concatenate(([True], row[1:] != row[:-1])))
        order = np.lexsort((np.arange(n), ccc, stretch))
        cps, ccc = cps[order].copy(), ccc[order]
    else:
        cps = cps.copy()
    k = np.flatnonzero(follows)
    depth = k - np.maximum.accumulate(np.where(~follows, np.arange(n), 0))[k]
    starter = k - depth
    last = np.zeros(n, np.int16)  # class of the last mark left standing after a starter
    left = np.zeros(n, bool)
    for d in range(1, int(depth.max()) + 1):
        i = k[depth == d]
        s = starter[depth == d]
        to = _pair(t, cps[s], cps[i])
        ok = (~left[s] | (last[s] < ccc[i])) & (to > 0) & (t.ccc[cps[s]] == 0)
        cps[s[ok]] = to[ok]
        no = i[~ok]
        last[s[~ok]], left[s[~ok]] = ccc[no], True
        cps[i[ok]] = LIMIT
    return cps


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together have at most `most` bytes (or one row), so that memory does not grow with the texts of a batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def normalize_points(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, offsets, flag per text) in the consistent form; the flag says that a text held a case as TESTDATA.md lists them."""
    t = tables()
    n = len(offs) - 1
    flag = np.zeros(n, bool)
    special = (t.cls[cps] & SPECIAL) != 0
    # a character joined by a following one that is not a mark (Indic vowel signs, Hangul) is composed as well
    special |= t.follows[cps]
    if not special.any():
        return cps, offs, flag
    count = np.concatenate(([0], np.cumsum(special)))
    some = np.flatnonzero(count[offs[1:]] > count[offs[:-1]])
    lens = np.diff(offs)[some]
    ends = np.cumsum(lens)
    index = np.arange(ends[-1]) + np.repeat(offs[some] - (ends - lens), lens)
    part, sub_flag, sub_lens = _normalize(t, cps[index], np.repeat(np.arange(len(some)), lens), len(some))
    flag[some] = sub_flag
    new_lens = np.diff(offs).copy()
    new_lens[some] = sub_lens
    new_offs = np.concatenate(([0], np.cumsum(new_lens)))
    out = np.empty(new_offs[-1], np.uint32)
    touched = np.zeros(n, bool)
    touched[some] = True
    out[np.repeat(~touched, new_lens)] = cps[np.repeat(~touched, np.diff(offs))]
    out[np.repeat(touched, new_lens)] = part
    return out, new_offs, flag


def _normalize(t: Tables, cps: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flag = np.zeros(n, bool)
    cls = t.cls[cps]
    case = (cls & (MARK | HIDDEN | SPACE)) != 0
    compat = (cls & COMPAT) != 0
    if compat.any():  # kana and other letters are brought to form too, but count as no case
        named = np.zeros(LIMIT, bool)
        some = np.unique(cps[compat])
        for c in some.tolist():
            run = t.full[t.at[c] : t.at[c] + t.width[c]]
            named[c] = bool((t.cls[run] & (LATIN | HAN)).any() or any(chr(x).isdigit() for x in run.tolist()))
        case |= named[cps]
    flag[row[case]] = True
    cps = cps.copy()
    cps[(cls & SPACE) != 0] = 0x20
    keep = (cls & HIDDEN) == 0
    cps, row = cps[keep], row[keep]
    if not len(cps):
        return cps, flag, np.bincount(row, minlength=n)
    compat = (t.cls[cps] & COMPAT) != 0
    if compat.any():
        cps, place = _expand(cps, t.at, t.width, compat, t.full)
        row = np.repeat(row, np.diff(place))
    follows = t.follows[cps]
    if follows.any():
        near = follows.copy()  # a precomposed letter before a mark, and marks themselves, are taken apart first
        near[:-1] |= follows[1:]
        near &= t.base_width[cps] > 0
        if near.any():
            cps, place = _expand(cps, t.base_at, t.base_width, near, t.full)
            row = np.repeat(row, np.diff(place))
        cps = _compose(t, cps, row)
        keep = cps < LIMIT
        cps, row = cps[keep], row[keep]
    cls = t.cls[cps]
    foreign = (cls & FOREIGN) != 0
    if foreign.any():
        script = (cls & (LATIN | FOREIGN)) != 0
        joined = script | ((cls & MARK) != 0)
        edge = np.ones(len(cps), bool)
        edge[1:] = ~(joined[1:] & joined[:-1] & (row[1:] == row[:-1]))
        word = np.cumsum(edge) - 1
        has_latin = np.bincount(word, weights=(cls & LATIN) != 0) > 0
        swap = foreign & has_latin[word] & (t.look[cps] > 0)
        cps[swap] = t.look[cps[swap]]
        flag[row[swap]] = True
    kana = (cls & KANA) != 0
    if kana.any():  # one that stands alone beside an ideograph, with no other kana next to it
        edge = np.concatenate(([True], row[1:] != row[:-1], [True]))
        is_kana, is_han = (cps >= 0x3041) & (cps < 0x3100) & (cps != 0x30FB), (cls & HAN) != 0
        beside = lambda x: (np.concatenate(([False], x[:-1])) & ~edge[:-1], np.concatenate((x[1:], [False])) & ~edge[1:])
        (k1, k2), (h1, h2) = beside(is_kana), beside(is_han)
        swap = kana & ~k1 & ~k2 & (h1 | h2)
        cps[swap] = t.look[cps[swap]]
        flag[row[swap]] = True
    return cps, flag, np.bincount(row, minlength=n)


def normalize(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts in the consistent form, and which of them held a case."""
    cps, offs = points(texts)
    cps, offs, flag = normalize_points(cps, offs)
    null = np.asarray(texts.is_null()) if texts.null_count else None
    return strings(cps, offs, null), flag
