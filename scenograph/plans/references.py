"""Queries on references between the layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenograph.operators.references import layer_orphans
from scenograph.tables import read


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return layer_orphans(read(spark, d, "chunks"), read(spark, d, "entities"), read(spark, d, "removals"))


def p5_by_period(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, volume and reason."""
    return p5_found(spark, d).groupBy("src_table", "vol_num", "reason").agg(F.count("*").alias("orphans"), F.countDistinct("src_uuid").alias("rows_affected"))


QUERIES = {"p5_found": p5_found, "p5_by_period": p5_by_period}

_FOUND = r"""
with rows_ as (
  select 'chunks' as layer, lower(trim(chunk_uuid)) as uuid, written_at, vol_num, entity_refs as refs from chunks
  union all select 'entities', lower(trim(entity_uuid)), written_at, vol_num, chunk_refs from entities),
gone as (select lower(trim(layer)) as layer, lower(trim(row_uuid)) as uuid, max(removed_at) as removed from removals group by all),
state as (select layer, uuid, min(written_at) as first_, max(written_at) as last_ from rows_ group by all),
full_ as (select s.*, g.removed from state s left join gone g using (layer, uuid)),
cur as (select distinct r.layer, r.uuid, r.written_at, r.vol_num, r.refs from rows_ r join full_ f on r.layer = f.layer and r.uuid = f.uuid and r.written_at = f.last_
        where f.removed is null or f.removed < f.last_),
refs as (select distinct layer as src_table, vol_num, uuid as src_uuid, written_at, lower(regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as ref_uuid
         from (select layer, vol_num, uuid, written_at, unnest(refs) as x from cur) where regexp_replace(x, '[\s\p{Z}]+', '', 'g') <> ''),
judged as (select r.src_table, r.vol_num, r.src_uuid, r.ref_uuid, case when f.uuid is null then 'missing' when f.removed >= f.last_ then 'deleted'
           when f.first_ > r.written_at + interval 24 hours then 'late' end as reason
  from refs r left join full_ f on f.uuid = r.ref_uuid and f.layer = case r.src_table when 'chunks' then 'entities' else 'chunks' end)
"""
SQL = {
    "p5_found": _FOUND + "select * from judged where reason is not null",
    "p5_by_period": _FOUND + "select src_table, vol_num, reason, count(*) as orphans, count(distinct src_uuid) as rows_affected from judged where reason is not null group by all",
}
