"""Visually identical text with different characters: forms of a text column, and the rows that need one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenograph.llm.textform import normalize, slices


def with_form(df: DataFrame, text: str, form: str = "form", case: str = "has_case", only_changed: bool = False) -> DataFrame:
    """df plus the consistent form of a text column and whether the text held a case.

    With only_changed the form is null wherever it equals the text, which keeps ordinary texts out of what follows.
    Null text: null form, no case. Empty text: empty form. The other columns pass through; columns already called `form` or `case` are replaced.
    """
    base = df.drop(*[c for c in (form, case) if c in df.columns and c != text])
    schema = T.StructType([*base.schema.fields, T.StructField(form, T.StringType()), T.StructField(case, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, whole.schema.get_field_index(text))):
            texts = b.column(b.schema.get_field_index(text)).cast(pa.string())
            forms, flags = normalize(texts)
            forms = forms.cast(pa.string())
            if only_changed:
                forms = pc.if_else(pc.equal(forms, texts), pa.scalar(None, pa.string()), forms)
            yield pa.RecordBatch.from_arrays([*b.columns, forms, pa.array(np.asarray(flags))], names=[*b.schema.names, form, case])

    return base.mapInArrow(run, schema)


def rows_with_cases(df: DataFrame, key: str, text: str, at: str = "written_at") -> DataFrame:
    """Keys whose current row (greatest `at`, copies once) holds a case.

    Texts are judged where they are read; only the key and one number are shuffled. The number packs time and flag, so its maximum belongs to the
    latest row (of rows with one time, a flagged one wins). Rows with a null key are dropped; a null time is earlier than any other.
    """
    judged = with_form(df.where(F.col(key).isNotNull()).select(key, at, text), text, only_changed=True)
    packed = F.coalesce(F.unix_micros(at), F.lit(-(1 << 60))) * 2 + F.col("has_case").cast("long")
    return judged.groupBy(key).agg(F.max(packed).alias("_m")).where("_m % 2 <> 0").select(key)


def changed_forms(df: DataFrame, key: str, text: str, at: str = "written_at") -> DataFrame:
    """Key and form of the current rows whose text is not in the consistent form already."""
    judged = with_form(df.where(F.col(key).isNotNull()).select(key, at, text), text, only_changed=True)
    best = F.max_by("form", F.struct(at, F.col("form").isNotNull(), "form"))
    return judged.groupBy(key).agg(best.alias("form")).where("form is not null")
