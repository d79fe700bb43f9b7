"""Filters of the engine as boolean columns; none is ever null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for "no value" in a keyword, a context and a finished entity, and names that identify nobody.
NO_KEYWORD = ["", "N/A", "NONE", "NULL", "未知", "無"]
NO_CONTEXT = ["", "N/A", "NONE", "NULL", "無", "未知", "無資料", "無相關資訊"]
PLACEHOLDER = r"^((未知人物|人物|角色|未知|無名)[\s_\-]*[A-Za-z0-9甲乙丙丁戊己庚辛壬癸零一二三四五六七八九十]*|男子|女子|男人|女人|路人|行人|旁人|某人|少年|少女|老人)$"
TYPES = ["character", "location", "object", "concept"]


def _value(c: str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))


def not_tainted(flag: str = "tainted") -> Column:
    return ~F.coalesce(F.col(flag), F.lit(False))


def valid_keyword(keyword: str = "keyword") -> Column:
    return ~_value(keyword).isin(NO_KEYWORD) & ~F.trim(F.coalesce(F.col(keyword), F.lit(""))).rlike(PLACEHOLDER)


def valid_context(context: str = "context_summary") -> Column:
    return ~_value(context).isin(NO_CONTEXT)


def final_guard(keyword: str = "keyword", description: str = "description") -> Column:
    return ~_value(keyword).isin(NO_CONTEXT) & ~_value(description).isin(NO_CONTEXT)


def any_category(categories: str, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.filter(F.col(categories), lambda x: x.isNotNull()), F.array(*map(F.lit, wanted))), F.lit(False))


def scope(novel: str | None = None, vol: int = 0, max_vol: int = 0, kind: str | None = None) -> Column:
    """Tenant, volume, volume bound and type; empty and 0 mean any."""
    out = F.lit(True)
    if novel:
        out &= F.col("novel_hash").eqNullSafe(novel)
    if vol:
        out &= F.col("vol_num").eqNullSafe(vol)
    if max_vol:
        out &= F.coalesce(F.col("vol_num") <= max_vol, F.lit(False))
    if kind:
        out &= F.col("entity_type").eqNullSafe(kind)
    return out


def create_valid(requested: str, returned: str, description: str) -> Column:
    return F.col(requested).eqNullSafe(F.col(returned)) & valid_context(description)


def merge_valid(index: str, candidates: str, requested: str, returned: str, description: str) -> Column:
    """-1 <= index < number of candidates; without a match the keyword stays; keyword and description hold something."""
    inside = F.coalesce((F.col(index) >= -1) & (F.col(index) < F.col(candidates)), F.lit(False))
    kept = (F.col(index) != -1) | F.col(requested).eqNullSafe(F.col(returned))
    return inside & F.coalesce(kept, F.lit(False)) & ~_value(returned).isin(NO_KEYWORD) & valid_context(description)
