"""Text functions as column expressions; all run on the JVM inside code generation where Spark generates code for them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates scenes in a volume. (?imU): case-insensitive, multi-line, Unicode classes (full-width digits and blanks).
BREAKS = (
    r"(?=\n\s*第\s*?[一二三四五六七八九十百千\d]+\s*?[卷章節話回篇]\b)",
    r"(?=\n\s*(?:chapter|prologue|epilogue)\s)",
    r"(?=\n\s*[◆◇★☆■□●○※＊*]+\s*\n)",
    r"(?=\n\s*[-=─━＝]{3,}\s*\n)",
    r"(?=\n{3,})",
)
SENTENCE_END = r"(?<=[。！？\n])"
# Words of Latin letters and digits, and single ideographs; the same pattern serves Spark and DuckDB.
TOKEN = r"[一-鿿]|[a-z0-9à-öø-ÿœ]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_ends(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"\r\n?", "\n")


def non_blank(text: Column | str) -> Column:
    return F.coalesce(_c(text).rlike(r"(?U)\S"), F.lit(False))


def structural_split(text: Column | str) -> Column:
    """Sections of a volume cut before headings, ornament lines, rules and runs of empty lines; blank sections are dropped. Null text: null."""
    parts = F.split(_c(text), "(?imU)" + "|".join(BREAKS))
    return F.filter(parts, lambda p: p.rlike(r"(?U)\S"))


def sentence_split(text: Column | str) -> Column:
    """Sentences, each with its closing sign; concatenated they give the text."""
    return F.filter(F.split(_c(text), SENTENCE_END), lambda p: p != "")


def number_in(name: Column | str) -> Column:
    """The first run of digits of a name, 0 if there is none or it is too long for an integer."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(_c(name), r"(\d{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def estimated_tokens(text: Column | str) -> Column:
    """A tokenizer's stand-in: half the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(_c(text), F.lit(""))) / 2).cast("int")


def truncate_tokens(text: Column | str, most: int = 500) -> Column:
    """Text cut to about `most` tokens: one proportional cut with a tenth in reserve, then up to three cuts by 15 percent."""
    text = _c(text)
    n = estimated_tokens(text)
    out = F.when(n <= most, text).otherwise(F.substring(text, F.lit(1), F.floor(F.length(text) * most * 0.9 / F.greatest(n, F.lit(1))).cast("int")))
    for _ in range(3):
        out = F.when(estimated_tokens(out) <= most, out).otherwise(F.substring(out, F.lit(1), F.floor(F.length(out) * 0.85).cast("int")))
    return out


def identity_text(keyword: Column | str, aliases: Column | str) -> Column:
    """Keyword and aliases as one line; nulls are left out."""
    names = F.filter(F.coalesce(_c(aliases), F.array().cast("array<string>")), lambda a: a.isNotNull())
    return F.concat(F.coalesce(_c(keyword), F.lit("")), F.when(F.size(names) > 0, F.concat(F.lit(" | "), F.array_join(names, ", "))).otherwise(""))


def content_text(description: Column | str, changes: Column | str) -> Column:
    """Description and, line by line, the events of status changes."""
    events = F.transform(F.coalesce(_c(changes), F.array().cast("array<struct<scene_index:int,event:string>>")), lambda c: F.concat(F.lit("- "), c.event))
    return F.concat(F.coalesce(_c(description), F.lit("")), F.when(F.size(events) > 0, F.concat(F.lit("\n"), F.array_join(events, "\n"))).otherwise(""))


# What the embedding model wants before texts to be found and before questions.
DOCUMENT, QUERY = "passage: ", "query: "


def document_text(text: Column | str) -> Column:
    return F.concat(F.lit(DOCUMENT), F.coalesce(_c(text), F.lit("")))


def query_text(text: Column | str) -> Column:
    return F.concat(F.lit(QUERY), F.coalesce(_c(text), F.lit("")))


def stripped(text: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def reasoning(text: Column | str, tag: str = "think") -> tuple[Column, Column]:
    """(what stands in the first tag, what follows it), both trimmed; without a tag an empty string and the text."""
    text = F.coalesce(_c(text), F.lit(""))
    inside = F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)
    rest = F.regexp_replace(text, f"(?s)\\A.*?<{tag}>.*?</{tag}>", "")
    return stripped(inside), F.when(text.rlike(f"(?s)<{tag}>.*?</{tag}>"), stripped(rest)).otherwise(text)


def json_narrow(text: Column | str) -> Column:
    """From the first opening to the last closing brace; empty if there is none."""
    return F.regexp_extract(_c(text), r"(?s)\{.*\}", 0)


def lenient_flag(text: Column | str, field: str = "combine") -> Column:
    """A boolean field of JSON text; unreadable text counts as true unless it names the field without saying true."""
    text = F.coalesce(_c(text), F.lit(""))
    read = F.try_variant_get(F.try_parse_json(text), f"$.{field}", "boolean")
    low = F.lower(text)
    return F.coalesce(read, F.when(low.contains(field), low.contains("true")).otherwise(True))


# Tool calls that a chat template left in a text.
TOOL_CALLS = (r"<\|?tool_call\|?>.*?<\|?/?tool_call\|?>", r"<\|tool_call\|>.*?<\|/tool_call\|>", r"<tool_call>.*?</tool_call>")


def strip_tool_calls(text: Column | str) -> Column:
    """Without tool calls that stand in the text, trimmed."""
    out = _c(text)
    for pattern in TOOL_CALLS:
        out = F.regexp_replace(out, "(?s)" + pattern, "")
    return stripped(out)


def front_matter(text: Column | str) -> Column:
    """Text without a leading block between lines of three dashes, and without empty lines before what follows."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"(?s)\A---\s*\n.*?\n---\s*\n", ""), r"\A\n+", "")


def rendered(template: str, **values: Column) -> Column:
    """A template with each $name or ${name} replaced by the value of that name, null by an empty text; $$ is a dollar sign. A name without a value is an error."""
    parts, at = [], 0
    for m in re.finditer(r"\$(?:(\$)|\{(\w+)\}|(\w+))", template):
        name = m[2] or m[3]
        parts += [F.lit(template[at : m.start()]), F.lit("$") if m[1] else F.coalesce(values[name].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def log_name(scene: Column, keyword: Column, existing: Column) -> Column:
    """The name of a step's log: scene, whether the entity was there, keyword and a hash of the entity."""
    kind = F.when(existing.isNotNull(), "merge").otherwise("new")
    number = F.lpad(scene.cast("string"), 3, "0")
    return F.concat(F.lit("scene_"), F.when(F.length(scene.cast("string")) > 3, scene.cast("string")).otherwise(number), F.lit("_extraction_"), kind, F.lit("_"), keyword, F.lit("_"), F.left(F.md5(F.coalesce(existing, F.lit(""))), F.lit(8)), F.lit(".json"))
