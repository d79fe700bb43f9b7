"""Variant spellings of names: the forms of a typed name, and links between the rows that name one person or organisation.

Every name of a row (its keyword and those aliases that are names) becomes one or more forms in a space of its kind. Forms of one group (a volume) and
space meet in a metric-space join. Its pivots are the strings that a form becomes by at most `radius` deletions: the cell of a pivot is the ball about it, a
form is replicated to the balls it lies in, two forms within the radius lie in one ball, and two of one ball are by the triangle inequality at most twice the
radius apart, so cells stay small however large the group is. Inside a cell the exact edit distance finds all pairs. Rules on the parts of the names judge
the pairs. Forms that fit several people (initials, nicknames, acronyms) join last, and only where one person is left.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenograph.llm.components import components
from scenograph.llm.textform import normalize
from scenograph.session import materialize

# Forms of address, what makes a name an epithet, kinds of organisation with their abbreviations, placeholders.
TITLES = "mr mrs ms miss dr prof professor capt captain lord lady sir dame master mistress brother sister father mother old young saint st m mme mlle maitre frere soeur pere monsieur madame".split()
EPITHET = re.compile(r"\b(of|de|du|des|the|le|la)\b|\b[ld]'", re.I)
GENERIC = {"teacher", "l'ancien", "maitre", "l'etranger", "隊長", "師父", "前輩", "那個人", "老師", "師兄", "師姐", "掌門", "陌生人"}
ZH_TITLES = ("師姐", "師兄", "師妹", "師弟", "長老", "將軍", "先生", "殿下", "大人", "夫人", "小姐", "公子", "姑娘", "老師", "隊長")
ZH_PREFIX = "老小阿"
FRENCH = "ordre guilde compagnie academie".split()
CLASSES = "order guild company trading academy church league society brotherhood".split() + FRENCH
ZH_CLASSES = {"商會": "商會", "商行": "商會", "騎士團": "騎士團", "騎團": "騎士團", "教團": "教團", "教會": "教團", "學院": "學院", "書院": "學院"}
SMALL_WORDS = {"of", "the", "du", "de", "des", "la", "le", "l", "d", "and", "et"}
SMALL_FRENCH = {"du", "de", "des", "la", "le", "l", "d"}
SWAPPED = {"".join(sorted(w)) for w in SMALL_WORDS}  # small words with their letters swapped
PLACEHOLDER = re.compile(r"(none|null|nil|nan|n/?a|unknown|undefined|unnamed|inconnue?|未知|無|无|不明|無名|某人|路人|行人|旁人|男子|女子|男人|女人|少年|少女|老人|[-?？.…_]*|(未知人物|未知|無名|角色|人物|路人|character|person|figure|personnage)\s*[-_#]?\s*([0-9０-９]*|[a-z]|[甲乙丙丁一二三四五六七八九十]+))", re.I)
PEOPLE, BODIES, CONCEPTS, NEITHER = {"character", "person", "角色", "人物", "personnage"}, {"organisation", "organization", "組織"}, {"concept", "概念"}, {"location", "place", "地點", "object", "item", "物品", "lieu", "objet"}

#: Radius of each space; a swap of letters counts as one edit where swaps are allowed.
RADIUS = {"PL": 1, "PZ": 1, "PF": 1, "OL": 1, "OS": 1, "OZ": 1, "SL": 1, "OW": 2}
#: A word with less than this share of the persons of a word one edit away is a slip of it; signs and nicknames need such shares of their names and rows.
SLIP_SHARE, SIGN_SHARE, NICK_SHARE = 0.1, 0.03, 0.05
HAN = re.compile("[㐀-鿿]")


def fold(name: str) -> str:
    """Lower case without accents; blanks trimmed and single."""
    bare = "".join(c for c in unicodedata.normalize("NFD", name.lower()) if not unicodedata.combining(c))
    return " ".join(unicodedata.normalize("NFC", bare).replace("’", "'").split())


Form = tuple[str, str, str, str, bool]  # space, key, given (or initial), surname, whether others may find it


def _latin_person(s: str) -> list[Form]:
    if EPITHET.search(s) or s in GENERIC:
        return []
    comma = "," in s
    parts = [re.findall(r"[a-zœæß'’\d]+", p.replace("-", "").replace("­", "")) for p in s.split(",")]
    parts = [[t for i, t in enumerate(p) if not (t in TITLES and len(t) > 1) or (i == len(p) - 1 and i > 0)] for p in parts]
    parts = [p for p in parts if p]
    tokens = [t for p in (parts[1:] + parts[:1] if comma else parts) for t in p]
    if len(tokens) < 2:
        return [("short", tokens[0], "", "", False)] if tokens else []
    if len(tokens[-1]) == 1 and len(tokens[0]) > 1:  # surname first, then initials
        return [("init", tokens[0], tokens[1][0], tokens[0], True)] if len(tokens[1]) == 1 else [("PL", tokens[0] + tokens[1], tokens[0], tokens[1], True), ("PL", tokens[1] + tokens[0], tokens[1], tokens[0], False)]
    if len(tokens[0]) == 1:
        return [("init", tokens[-1], tokens[0], tokens[-1], True)]
    g, n = tokens[0], tokens[-1]
    out: list[Form] = [("PL", g + n, g, n, True)]
    if not comma:
        out.append(("PL", n + g, n, g, False))
    if len(tokens) > 2:
        out.append(("PL", "".join(tokens), "", "", False))
        if not comma and len(tokens[1]) > 1:
            out.append(("PL", tokens[1] + g, tokens[1], g, False))
    if len(tokens) > 3:
        out.append(("PL", g + tokens[-2] + n, g, tokens[-2] + n, False))
    return out


def _han_person(s: str, foreign_given: set[str]) -> list[Form]:
    reverse = re.search("[，,、]", s)
    s = re.sub(r"\s+", "", s)
    for t in ZH_TITLES:
        if s.endswith(t) and len(s) > len(t) + 1:
            s = s[: -len(t)]
            break
    parts = [p for p in re.split("[・·•‧,，、]", s) if p]
    if s in GENERIC or re.search("[之的]", s) or not parts:
        return []
    if len(parts) > 1:
        g, n = (parts[-1], parts[0]) if reverse else (parts[0], parts[-1])
        out: list[Form] = [("PF", g + n, g, n, True)]
        if g[0] in ZH_PREFIX and len(g) > 2:
            out.append(("PF", g[1:] + n, g[1:], n, False))
        return out
    if len(s) > 3 and s[0] in ZH_PREFIX:
        s = s[1:]
    if len(s) < 3 or s in foreign_given or s[0] in "小阿":
        return [("short", s, "", "", False)]
    if len(s) > 5:
        return [("PF", s, "", "", True)]
    if len(s) > 3:  # a word before or after a native name, a slip, or a foreign name without its dot
        return [("PF", s, "", "", True), ("PZ", s[-3:], s[-2:], s[-3], False), ("PZ", s[:3], s[1:3], s[0], False)]
    return [("PZ", s, s[1:], s[0], True)]


def _one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or swap of neighbours makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return len(b) - len(a) == 1 and a[i:] == b[i + 1 :]


@lru_cache(100_000)
def _class_word(t: str, french: bool = False, short: bool = True) -> str:
    """The kind of organisation that a word spells: typed right, with one slip, or short (its first letter and later ones in order, two or more left out); else the word.

    Of several kinds those of the name's language come first, then short ones.
    """
    if t in CLASSES or len(t) < 2:
        return t
    best = lambda some: min(some, key=lambda w: ((w in FRENCH) != french, len(w)), default=None)
    slip = best(w for w in CLASSES if len(t) > 3 and _one_edit(t, w))
    cut = best(w for w in CLASSES if t[0] == w[0] and len(t) <= len(w) - 2 and _in_order(t, w)) if short and t not in TITLES else None
    return slip or cut or t


def _in_order(t: str, w: str) -> bool:
    letters = iter(w)
    return all(c in letters for c in t)


def _body(s: str, sure: bool = True) -> list[Form]:
    """An organisation; empty where no word says that it is one. Where the type does not say it either (sure), short words count only beside a stop or a small word."""
    if HAN.search(s):
        s = re.sub(r"\s+", "", s)
        for suffix in sorted(ZH_CLASSES, key=len, reverse=True):
            if s.endswith(suffix) and len(s) > len(suffix):
                stem, cls = s[: -len(suffix)], ZH_CLASSES[suffix]
                if len(stem) == 2:
                    return [("abbr", stem + cls, "", "", True)]
                out: list[Form] = [("OZ", stem + cls, stem, cls, True)]
                if len(stem) >= 4:
                    out.append(("abbr_of", stem[0] + stem[2] + cls, "", "", True))
                return out
        return []
    comma = s.split(",")
    s = " ".join(comma[1:] + comma[:1]) if len(comma) == 2 else s
    tokens = [t for t in re.findall(r"[a-zœæß\d]+", s.replace("-", ""))]
    french = any(t in SMALL_FRENCH for t in tokens)
    short = sure or "." in s or any(t in SMALL_WORDS for t in tokens)
    words = [_class_word(t, french, short) for t in tokens if t not in SMALL_WORDS and "".join(sorted(t)) not in SWAPPED and (len(t) > 2 or t == "co")]
    cls = [w for w in words if w in CLASSES]
    rest = [w for w in words if w not in CLASSES]
    if not cls or not rest:
        return []
    key = "".join(rest + sorted(set(cls)))
    out = [("OL", key, " ".join(rest), " ".join(sorted(set(cls))), True), ("OS", "".join(sorted(words)), "", "", True)]
    # in the order of the name: class words last for Academy and Company, first else
    last = [w for w in words if w in ("academy", "trading", "company")]
    first = [w for w in words if w in CLASSES and w not in last]
    out.append(("acr_of", "".join(w[0] for w in first + rest + sorted(last, reverse=True)), "", "", True))
    return out


def forms(name: str, kind: str, foreign_given: set[str]) -> list[Form]:
    """The forms of a name in the consistent form of text; kind P, O or ? (either)."""
    s = fold(name)
    if not s or PLACEHOLDER.fullmatch(s):
        return []
    body = _body(s, kind == "O") if kind != "P" else []
    if body or kind == "O":
        acronym = re.fullmatch(r"([a-z]\.?){3,5}", s) and (name.isupper() or "." in s)
        return body or ([("acr", s.replace(".", ""), "", "", True)] if acronym else [])
    return _han_person(s, foreign_given) if HAN.search(s) else _latin_person(s)


class Forms:
    """forms() with each distinct name worked out once a task; bounded, emptied when full."""

    def __init__(self, room: int = 200_000) -> None:
        self.seen: dict[tuple, list[Form]] = {}
        self.room = room

    def __call__(self, name: str, kind: str, foreign_given: set[str]) -> list[Form]:
        key = (name, kind, frozenset(foreign_given) if foreign_given else None)
        if key not in self.seen:
            if len(self.seen) >= self.room:
                self.seen.clear()
            self.seen[key] = forms(name, kind, foreign_given)
        return self.seen[key]


def name_forms(rows: DataFrame) -> DataFrame:
    """rows(id, grp, type, keyword, aliases) -> (id, grp, hard, main, space, key, given, surname, found), a row per form.

    hard: the type says person, or the name says organisation. main: the form is the keyword's. Rows with a blank or placeholder keyword, and places, objects
    and other concepts, have no forms.
    """
    schema = "id string, grp string, hard boolean, main boolean, space string, key string, given string, surname string, found boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = Forms()
        for b in batches:
            keywords = normalize(b.column("keyword").cast(pa.string()))[0].to_pylist()
            lists = b.column("aliases")
            flat = normalize(lists.flatten().cast(pa.string()))[0].to_pylist()
            at, out = 0, []
            for i, g, t, k, n in zip(b.column("id").to_pylist(), b.column("grp").to_pylist(), b.column("type").to_pylist(), keywords, lists.value_lengths().to_pylist()):
                aliases, at = [x for x in flat[at : at + (n or 0)] if x], at + (n or 0)
                t = fold(t or "")
                if t in NEITHER or not k or PLACEHOLDER.fullmatch(fold(k)):
                    continue
                kind = "P" if t in PEOPLE else "O" if t in BODIES or t in CONCEPTS else "?"
                given = {p for x in [k, *aliases] for p in re.split("[・·•‧]", re.sub(r"\s", "", x))[:1] if HAN.search(x) and re.search("[・·•‧]", x)}
                given |= {re.sub(r"\s", "", x).split("，")[-1] for x in [k, *aliases] if "，" in x}
                mine = parsed(k, kind, given)
                if not mine:
                    continue
                body = mine[0][0] in ("OL", "OZ", "acr", "abbr")
                hard = kind == "P" or (body and mine[0][0] != "acr") or t in BODIES or t in CONCEPTS
                seen = set()
                for main, f in [(True, x) for x in mine] + [(False, x) for a in aliases for x in parsed(a, "O" if body else "P", given)]:
                    if f not in seen:
                        seen.add(f)
                        out.append((i, g, hard, main, *f))
            cols = list(zip(*out)) or [()] * 9
            types = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.select("id", "grp", "type", "keyword", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).mapInArrow(run, schema)


#: Longer keys are held by the balls of their ends, of so many letters and one more; of two keys at most two edits apart one end has at most one edit.
END = 32


def _balls(key: str, radius: Column) -> Column:
    """The strings that a key becomes by at most `radius` (1 or 2) deletions, itself included; for long keys those of their ends by one deletion."""
    without = lambda c, i: F.concat(F.substring(c, F.lit(1), i), F.substring(c, i + 2, F.length(c)))
    each = lambda c: F.transform(F.sequence(F.lit(0), F.length(c)), lambda i: without(c, i))
    one = lambda c: F.when(F.length(key) <= 2 * END + 4, each(c)).otherwise(F.array().cast("array<string>"))
    whole = F.when(radius > 1, F.flatten(F.transform(one(F.col(key)), each))).otherwise(one(F.col(key)))
    first = F.transform(each(F.substring(F.col(key), F.lit(1), F.lit(END + 1))), lambda v: F.concat(F.lit("^"), v))
    last = F.transform(each(F.substring(F.col(key), F.lit(-END - 1), F.lit(END + 1))), lambda v: F.concat(F.lit("$"), v))
    return F.array_distinct(F.when(F.length(key) > 2 * END, F.concat(whole, first, last)).otherwise(whole))


def radius_join(points: DataFrame, radius: Column, swaps: bool = False) -> DataFrame:
    """points(grp, space, key, found) -> pairs (grp, space, a, b, distance) of keys with Levenshtein distance 1 to radius (1 or 2), b one that may be found.

    With swaps, keys of the same letters that one letter moved makes equal count too, though their distance is 2. Keys are distinct per group before
    the join, however many rows share them, and only a hash of group, space and pivot is shuffled with a key.
    """
    keys = points.groupBy("grp", "space", "key").agg(F.max("found").alias("found")).withColumn("r", radius)
    cells = keys.select("grp", "space", "key", "found", "r", F.explode(F.transform(_balls("key", F.col("r")), lambda v: F.xxhash64("grp", "space", v))).alias("cell"))
    home = cells.where("found").select("cell", F.col("grp").alias("g"), F.col("space").alias("s"), F.col("key").alias("b"))
    near = cells.select("cell", "grp", "space", "r", F.col("key").alias("a")).join(home, "cell").where("a <> b and grp = g and space = s and abs(length(a) - length(b)) <= r")
    # pairs of several cells come to one row before their distance is worked out
    near = near.groupBy("grp", "space", "a", "b").agg(F.max("r").alias("r")).withColumn("distance", F.expr(f"levenshtein(a, b, {'greatest(r, 2)' if swaps else 'r'})"))
    close = F.col("distance").between(1, F.col("r"))
    if swaps:
        close |= (F.col("distance") == 2) & (_letters("a") == _letters("b"))
    return near.where(close).select("grp", "space", "a", "b", "distance")


def _letters(c: str) -> Column:
    return F.array_sort(F.split(c, ""))


FULL = ["PL", "PZ", "PF", "OL", "OS", "OZ"]


def _node(space: Column | str, key: str) -> Column:
    return F.concat_ws("\u0001", "grp", space, key)


def _row() -> Column:
    return F.concat_ws("\u0001", "grp", F.lit("row"), "id")


def linked_rows(rows: DataFrame) -> DataFrame:
    """rows(id, grp, type, keyword, aliases) -> (id, grp, entity): rows of one person or organisation share `entity`; rows without forms are left out.

    Null aliases count as none, repeated rows of an id as one, an empty table gives no rows.
    """
    all_forms = materialize(name_forms(rows), "forms")
    # what the whole table says: frequent given names and words, signs typed for one another, nicknames, given names that look native
    vocabulary = materialize(_vocabulary(all_forms), "vocabulary")
    keys = materialize(_keys(all_forms, vocabulary), "keys")
    near = materialize(radius_join(_points(all_forms, keys, vocabulary), _radius(), swaps=True), "near")
    strong = materialize(_judged(keys, near, vocabulary), "strong")

    # rows and name keys are the nodes of one graph: a row is tied to its own keys, where some row's name is that key, and to the keys they are near to
    found = keys.where("found").select("grp", "space", "key", F.col("key").alias("to"))
    targets = found.unionByName(strong.select("grp", "space", F.col("a").alias("key"), F.col("b").alias("to")))
    mine = all_forms.where(F.col("space").isin(FULL)).select("grp", "id", "space", "key").distinct()
    edges = mine.join(targets, ["grp", "space", "key"]).select("grp", _row().alias("p"), _node("space", "to").alias("q"))
    first = materialize(components(edges, "grp"), "first")

    weak = _weak_edges(all_forms, keys, near, strong, vocabulary, first)
    tied = first.where(F.split("node", "\u0001")[1] == "row").select(F.split("node", "\u0001")[0].alias("grp"), F.col("node").alias("p"), F.col("component").alias("q"))
    labels = components(tied.unionByName(weak), "grp")
    hard = all_forms.groupBy("id", "grp").agg(F.max("hard").alias("hard"))
    out = hard.withColumn("node", _row()).join(labels, "node", "left").select("id", "grp", F.coalesce("component", "node").alias("entity"), "hard")
    # rows of an uncertain type count only beside one that is certain
    sure = out.groupBy("entity").agg(F.max("hard").alias("sure")).where("sure").select("entity")
    return out.join(sure, "entity", "left_semi").select("id", "grp", "entity")


def _of(vocabulary: DataFrame, kind: str, *names: str) -> DataFrame:
    return vocabulary.where(F.col("kind") == kind).select(*[F.col(c).alias(n) for c, n in zip(("space", "x", "y"), names) if n])


def _vocabulary(all_forms: DataFrame) -> DataFrame:
    """(kind, space, x, y) of what the whole table says, counted in persons (names of a volume), however many rows name them."""
    persons = all_forms.where("found").select("space", "grp", "key", "given", "surname", "main").groupBy("space", "grp", "key", "given", "surname").agg(F.max("main").alias("main"))
    none = F.lit(None).cast("string")
    # word: given names and organisations' words of five persons or more that are no slips of a word one edit away, with SLIP_SHARE of its persons or fewer
    words = persons.where("main and space in ('PL', 'PF', 'OL')").select("space", "grp", "key", F.explode(F.array_distinct(F.split("given", " "))).alias("x")).where("x <> ''")
    words = words.groupBy("space", "x").agg(F.count("*").alias("n")).where("n >= 5")
    balls = words.select("space", "x", "n", F.explode(F.transform(_balls("x", F.lit(1)), lambda v: F.xxhash64("space", v))).alias("v"))
    most = balls.groupBy("v").agg(F.max("n").alias("most"))
    known = balls.join(most, "v").groupBy("space", "x").agg(F.max(F.col("n") < SLIP_SHARE * F.col("most")).alias("slip")).where("not slip")
    # foreign: native-looking names that stand as given names before a dot more often than as names
    foreign = persons.where("space in ('PF', 'PZ')").select(F.when(F.col("space") == "PF", F.col("given")).otherwise(F.col("key")).alias("x"), F.when(F.col("space") == "PF", 1).otherwise(-1).alias("n")).where("x <> ''")
    foreign = foreign.groupBy("x").agg(F.sum("n").alias("n"), F.max("n").alias("given")).where("given > 0 and n > 0")
    # what rows list side by side
    lists = all_forms.groupBy("id", "grp").agg(
        F.collect_set(F.when(F.col("found") & F.col("space").isin("PZ", "PF", "OZ"), F.struct("space", "key"))).alias("signed"),
        F.collect_set(F.when(F.col("found") & (F.col("space") == "PL") & (F.col("given") != ""), F.struct("given", "surname"))).alias("names"),
        F.collect_set(F.when(F.col("space") == "short", F.col("key"))).alias("short"),
    )
    # sign: ideographs typed for one another, of two persons at least and of a share of the names with the rarer sign
    two = lists.where("size(signed) > 1").select("grp", F.explode("signed").alias("a"), "signed").select("grp", "a", F.explode("signed").alias("b"))
    two = two.where("a.space = b.space and a.key < b.key and length(a.key) = length(b.key)").select("grp", F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    one = two.withColumn("s", _unlike("a", "b")).where("size(s) = 1").withColumn("s", F.get("s", F.lit(0)))
    counts = one.groupBy(F.least("s.x", "s.y").alias("x"), F.greatest("s.x", "s.y").alias("y")).agg(F.count("*").alias("n")).where("n >= 2")
    uses = persons.where("space in ('PZ', 'PF', 'OZ')").select(F.explode(F.array_distinct(F.split("key", ""))).alias("c")).groupBy("c").agg(F.count("*").alias("m"))
    ends = counts.select("x", "y", "n", F.explode(F.array("x", "y")).alias("c")).join(uses, "c").groupBy("x", "y").agg(F.first("n").alias("n"), F.min("m").alias("m"))
    signs = ends.where(F.col("n") >= SIGN_SHARE * F.col("m"))
    # nick: given names used for one person, beside the same surname or alone beside a full name; of two persons at least and of a share of the nickname's
    named = lists.where("size(names) > 0").select("grp", "names", "short", F.explode("names").alias("m"))
    beside = F.transform(F.filter("names", lambda o: (o.surname == F.col("m.surname")) & (o.given != F.col("m.given"))), lambda o: o.given)
    pairs = named.select("grp", "m.surname", F.col("m.given").alias("y"), F.explode(F.concat(beside, "short")).alias("x")).distinct()
    pairs = pairs.where((F.levenshtein("x", "y", 1) == -1) & (_letters("x") != _letters("y"))).groupBy("x", "y").agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("every", F.sum("n").over(Window.partitionBy("x"))).where((F.col("n") >= 2) & (F.col("n") >= NICK_SHARE * F.col("every")))
    often = persons.where("space = 'PL' and given <> ''").groupBy(F.col("given").alias("g")).agg(F.count("*").alias("often"))
    pairs = pairs.join(often.withColumnsRenamed({"g": "y", "often": "ny"}), "y").join(often.withColumnsRenamed({"g": "x", "often": "nx"}), "x", "left").where("ny > 3 * coalesce(nx, 0)")
    return (
        known.select(F.lit("word").alias("kind"), "space", "x", none.alias("y"))
        .unionByName(foreign.select(F.lit("foreign").alias("kind"), F.lit("PZ").alias("space"), "x", none.alias("y")))
        .unionByName(signs.select(F.lit("sign").alias("kind"), none.alias("space"), "x", "y"))
        .unionByName(pairs.select(F.lit("nick").alias("kind"), F.lit("PL").alias("space"), "x", "y"))
    )


def _unlike(a: str, b: str) -> Column:
    """The places (x, y) in which two keys of one length differ."""
    return F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p.x != p.y)


def _keys(all_forms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(grp, space, key, found, given, surname) of the distinct full names; given names that only look native are none."""
    full = all_forms.where(F.col("space").isin(FULL)).groupBy("grp", "space", "key").agg(F.max("found").alias("found"), F.max(F.struct("given", "surname")).alias("parts"))
    return full.join(_of(vocabulary, "foreign", "space", "key"), ["space", "key"], "left_anti").select("grp", "space", "key", "found", "parts.given", "parts.surname")


def _nicknamed(all_forms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(grp, weak, key): names with a nickname, and the full names they may stand for."""
    names = all_forms.where("space = 'PL' and given <> ''").select("grp", F.col("key").alias("weak"), "given", "surname").distinct()
    return names.join(_of(vocabulary, "nick", None, "given", "full_given"), "given").select("grp", "weak", F.concat("full_given", "surname").alias("key")).distinct()


def _points(all_forms: DataFrame, keys: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """What meets in the metric-space join: full names, the full names of nicknames, family names (SL) with those of initials, and organisations' words (OW)."""
    families = keys.where("space = 'PL' and given <> ''").select("grp", F.explode(F.array("surname", "given")).alias("key"), "found")
    initials = all_forms.where("space = 'init'").select("grp", "key", F.lit(False).alias("found"))
    points = keys.select("grp", "space", "key", "found").unionByName(_nicknamed(all_forms, vocabulary).select("grp", F.lit("PL").alias("space"), "key", F.lit(False).alias("found")))
    words = keys.where("space = 'OL' and given <> ''").select("grp", F.lit("OW").alias("space"), F.explode(F.split("given", " ")).alias("key"), "found")
    return points.unionByName(families.unionByName(initials).select("grp", F.lit("SL").alias("space"), "key", "found")).unionByName(words)


def _radius() -> Column:
    return reduce(lambda c, kv: c.when(F.col("space") == kv[0], kv[1]), RADIUS.items(), F.when(F.lit(False), 0))


def _judged(keys: DataFrame, near: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(grp, space, a, b): near names that the rules on their parts take for one."""
    a = keys.select("grp", "space", F.col("key").alias("a"), F.col("given").alias("ga"), F.col("surname").alias("sa"))
    b = keys.where("found").select("grp", "space", F.col("key").alias("b"), F.col("given").alias("gb"), F.col("surname").alias("sb"))
    pairs = near.where("space not in ('SL', 'OW')").join(a, ["grp", "space", "a"]).join(b, ["grp", "space", "b"]).select("grp", "space", "a", "b", "ga", "gb", "distance")
    # long names may have one slip in each part: near family names, then near given names
    slips = near.where("space = 'SL'").select("grp", F.col("a").alias("sa"), F.col("b").alias("sb"), F.lit("PL").alias("space"))
    each = slips.join(a.where("ga <> '' and length(a) >= 14"), ["grp", "space", "sa"]).join(b.where("gb <> ''"), ["grp", "space", "sb"])
    each = each.where((F.levenshtein("ga", "gb", 1) == 1) & (F.levenshtein("a", "b", 2) == 2)).select("grp", "space", "a", "b", "ga", "gb", F.lit(2).alias("distance"))
    # names of organisations may have two slips, in one word or two, so one word at least is near
    of = lambda side, g: side.where(F.col("space") == "OL").withColumn("w", F.explode(F.split(g, " "))).where("w <> ''")
    words = near.where("space = 'OW'").select("grp", F.col("a").alias("wa"), F.col("b").alias("wb"), F.lit("OL").alias("space"))
    two = words.join(of(a, "ga").withColumnRenamed("w", "wa"), ["grp", "space", "wa"]).join(of(b, "gb").withColumnRenamed("w", "wb"), ["grp", "space", "wb"])
    two = two.where(F.levenshtein("a", "b", 2) == 2).select("grp", "space", "a", "b", "ga", "gb", F.lit(2).alias("distance"))
    token = F.split("ga", " "), F.split("gb", " ")
    other = F.array_except(*token), F.array_except(*token[::-1])
    pairs = pairs.unionByName(each).unionByName(two).withColumns({"oa": F.when(F.size(other[0]) == 1, other[0][0]), "ob": F.when(F.size(other[1]) == 1, other[1][0])})
    words = _of(vocabulary, "word", "space", "w")
    pairs = pairs.join(words.select("space", F.col("w").alias("oa"), F.lit(True).alias("wa")), ["space", "oa"], "left").join(words.select("space", F.col("w").alias("ob"), F.lit(True).alias("wb")), ["space", "ob"], "left")
    signs = F.when(F.length("a") == F.length("b"), F.get(_unlike("a", "b"), F.lit(0)))
    pairs = pairs.withColumns({"x": F.least(signs.x, signs.y), "y": F.greatest(signs.x, signs.y)}).join(_of(vocabulary, "sign", None, "x", "y").withColumn("confused", F.lit(True)), ["x", "y"], "left")
    apart = F.coalesce(F.col("wa") & F.col("wb"), F.lit(False))
    ok = (
        F.when(F.col("space") == "PL", ~apart)
        .when(F.col("space").isin("OL", "OS"), ~apart & ((F.col("distance") == 1) | (_letters("a") == _letters("b")) | (F.length("a") >= 14)))
        .when(F.col("space") == "PF", F.col("confused").isNotNull() | (~apart & (F.length("a") >= 5)))
        .otherwise(F.col("confused").isNotNull() | ((F.length("a") != F.length("b")) & (F.least(F.length("a"), F.length("b")) >= 4)))
    )
    return pairs.where(ok).select("grp", "space", "a", "b").distinct()


def _weak_edges(all_forms: DataFrame, keys: DataFrame, near: DataFrame, strong: DataFrame, vocabulary: DataFrame, first: DataFrame) -> DataFrame:
    """Edges (grp, p, q) of forms that fit several people, where all they fit is one component."""
    # initials: a family name, right or near, and a given name that begins so; a name may be given in either order
    initials = all_forms.where("space = 'init'").select("grp", "key", F.col("given").alias("initial")).distinct()
    surnames = near.where("space = 'SL'").select("grp", F.col("a").alias("key"), F.col("b").alias("hit"))
    spelled = initials.join(surnames, ["grp", "key"]).unionByName(initials.withColumn("hit", F.col("key")))
    part = lambda hit, given: F.struct(F.col(hit).alias("hit"), F.substring(given, 1, 1).alias("initial"))
    families = keys.where("space = 'PL' and found and given <> ''").select("grp", "key", F.explode(F.array(part("surname", "given"), part("given", "surname"))).alias("f")).select("grp", "f.*", _node(F.lit("PL"), "key").alias("q"))
    by_initial = spelled.join(families, ["grp", "hit", "initial"]).select("grp", F.concat_ws("\u0001", F.lit("init"), "initial", "key").alias("weak"), "q")

    named = _nicknamed(all_forms, vocabulary)
    close = near.where("space = 'PL'").select("grp", F.col("a").alias("key"), F.col("b").alias("hit"))
    nick = F.concat_ws("\u0001", F.lit("nick"), "weak")
    by_nick = named.join(close, ["grp", "key"]).select("grp", nick.alias("weak"), _node(F.lit("PL"), "hit").alias("q")).unionByName(named.select("grp", nick.alias("weak"), _node(F.lit("PL"), "key").alias("q")))

    # acronyms and abbreviations: rows whose name shortens to them
    short = all_forms.where("space in ('acr', 'abbr')").select("grp", F.concat_ws("", "space", F.lit("_of")).alias("space"), "key").distinct()
    theirs = all_forms.where("space in ('acr_of', 'abbr_of')").select("grp", "space", "key", _row().alias("q")).distinct()
    by_letters = short.join(theirs, ["grp", "space", "key"]).select("grp", F.concat_ws("\u0001", F.regexp_replace("space", "_of", ""), "key").alias("weak"), "q")

    candidates = by_initial.unionByName(by_nick).unionByName(by_letters)
    fits = candidates.join(first.withColumnRenamed("node", "q"), "q").groupBy("grp", "weak").agg(F.min("component").alias("component"), F.max("component").alias("other"))
    # equal initials, acronyms and abbreviations name one another too, unless they fit several
    bare = all_forms.where("space in ('init', 'acr', 'abbr')").select("grp", "id", F.when(F.col("space") == "init", F.concat_ws("\u0001", "space", "given", "key")).otherwise(F.concat_ws("\u0001", "space", "key")).alias("weak"))
    nicked = all_forms.where("space = 'PL' and given <> ''").join(named.select("grp", F.col("weak").alias("key")).distinct(), ["grp", "key"], "left_semi").select("grp", "id", F.concat_ws("\u0001", F.lit("nick"), "key").alias("weak"))
    held = bare.unionByName(nicked).distinct().join(fits, ["grp", "weak"], "left").where("component is null or component = other")
    weak_node = F.concat_ws("\u0001", "grp", F.lit("weak"), "weak")
    ends = F.array(F.struct(_row().alias("p"), weak_node.alias("q")), F.struct(weak_node.alias("p"), F.col("component").alias("q")))
    return held.select("grp", F.explode(ends).alias("e")).select("grp", "e.*").where("q is not null").distinct()


def linked_pairs(rows: DataFrame) -> DataFrame:
    """All pairs (a < b) of ids with the same entity."""
    labels = materialize(linked_rows(rows), "linked").select("entity", "id")
    return labels.alias("a").join(labels.alias("b"), "entity").where("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
