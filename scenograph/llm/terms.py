"""Frequency of every distinct value, by recursive radix spilling.

Terms are cut into partitions by the leading bits of their hash. Partitions that are too large are split again by the next bits, level after level, until
each fits; the sizes are counted before any row moves, so every row is spilled to disk once, by one shuffle to its final partition, and each partition is
aggregated out of core by DuckDB inside one task. Before that a task adds up its own rows, so a term that half of all rows hold is one row a task and
cannot make a partition large, however hot it is.
"""

from __future__ import annotations

import math
import os
import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenograph.session import materialize

COUNTS = "field string, term string, occurrences long, records long"


def plain(value: str | None) -> str | None:
    """NFKC, blanks trimmed and runs of blanks made one space, lower case; None for null and blank values."""
    if value is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", value).split()).lower() or None


class PlainValues:
    """plain() with each distinct value worked out once a task; bounded, emptied when full."""

    def __init__(self, room: int = 500_000) -> None:
        self.seen: dict[str, str | None] = {}
        self.room = room

    def __call__(self, value: str | None) -> str | None:
        if value is None:
            return None
        if value not in self.seen:
            if len(self.seen) >= self.room:
                self.seen.clear()
            self.seen[value] = plain(value)
        return self.seen[value]


def partial_counts(df: DataFrame, fields: dict[str, str], room: int = 1_000_000) -> DataFrame:
    """(field, term, occurrences, records) as each task adds them up; fields: name -> column, a string or an array of strings.

    A record counts once for a term however often it holds it. Null arrays, null and blank elements are skipped. A task that holds more than `room`
    terms puts out what it has and begins anew, so its memory is bounded. One row a task with null field and term has the number of its records.
    """
    flat = df.select(*[(F.col(c) if dict(df.dtypes)[c].startswith("array") else F.array(F.col(c))).alias(f"f{i}") for i, c in enumerate(fields.values())])
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = PlainValues()
        sums: list[dict[str, list[int]]] = [{} for _ in names]
        seen = 0

        def out() -> pa.RecordBatch:
            rows = [(None, None, 0, seen)] + [(n, t, o, r) for n, s in zip(names, sums) for t, (o, r) in s.items()]
            for s in sums:
                s.clear()
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["field", "term", "occurrences", "records"])

        for b in batches:
            seen += b.num_rows
            for i in range(len(names)):
                lists = b.column(i)
                lengths = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(lists)), lengths)
                coded = lists.flatten().dictionary_encode()  # flatten() leaves out what lies under null arrays
                terms = [value(x) for x in coded.dictionary.to_pylist()]
                if len(coded) != len(row):
                    row = np.repeat(np.arange(len(lists)), np.where(np.asarray(lists.is_valid()), lengths, 0))
                index = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                known: dict[str, int] = {}
                codes = np.array([known.setdefault(x, len(known)) if x is not None else -1 for x in terms] + [-1], np.int64)[index]
                ok = codes >= 0
                codes, row = codes[ok], row[ok]
                occurrences = np.bincount(codes, minlength=len(known))
                pairs = np.unique(codes * np.int64(len(lists)) + row) // max(len(lists), 1)
                records = np.bincount(pairs, minlength=len(known))
                for t, k in known.items():
                    s = sums[i].setdefault(t, [0, 0])
                    s[0] += int(occurrences[k])
                    s[1] += int(records[k])
            if sum(map(len, sums)) > room:
                yield out()
                seen = 0
        yield out()

    return flat.mapInArrow(run, COUNTS)


def radix_partitions(partials: DataFrame, bits: int | None = None, most_rows: int = 2_000_000) -> tuple[DataFrame, int]:
    """The rows with their partition `_p` (level and leading bits of the hash), and the number of partitions.

    The first level has enough bits for partitions of most_rows rows and for every shuffle partition; each partition of more rows is split by as many
    further bits, and so on until it fits, one term holds the rows, or the bits end. Only sizes of partitions come to the driver.
    """
    if bits is None:
        rows = partials.count()
        tasks = int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bits = min(16, max(1, math.ceil(math.log2(max(rows / most_rows, tasks, 2)))))
    h = F.xxhash64("field", "term")
    prefix = lambda level: F.shiftrightunsigned(h, 64 - bits * (level + 1))
    place, todo, partitions, level = None, partials, 0, 0
    while True:
        sizes = todo.groupBy(prefix(level).alias("v")).agg(F.count("*").alias("n"), F.min(h).alias("a"), F.max(h).alias("b")).collect()
        large = [r.v for r in sizes if r.n > most_rows and r.a != r.b] if (level + 2) * bits <= 64 else []
        partitions += len(sizes) - len(large)
        here = F.concat_ws("_", F.lit(level), prefix(level).cast("string"))
        fits = ~prefix(level).isin(large) if large else F.lit(True)
        place = F.when(fits, here) if place is None else place.when(fits, here)
        if not large:
            return partials.withColumn("_p", place), max(1, partitions)
        todo, level = todo.where(prefix(level).isin(large)), level + 1


def radix_counts(partials: DataFrame, bits: int | None = None, most_rows: int = 2_000_000, memory_mb: int = 256) -> DataFrame:
    """Add up partial counts; the result has one row for each (field, term).

    Rows of one term share all their hash bits, so they meet in one task. DuckDB takes its rows within memory_mb and spills what is more to the
    executor's own scratch folder, which Spark assigns; nothing there outlives the task.
    """
    split, partitions = radix_partitions(partials, bits, most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with tempfile.TemporaryDirectory(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as spill:
            con = duckdb.connect(os.path.join(spill, "sums"), config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": spill})
            schema = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
            con.execute("create table sums (field varchar, term varchar, occurrences bigint, records bigint)")
            for b in batches:
                rows = pa.Table.from_batches([b])
                con.register("incoming", rows)
                con.execute("insert into sums select field, term, occurrences, records from incoming")
                con.unregister("incoming")
            got = con.execute("select field, term, sum(occurrences)::bigint as occurrences, sum(records)::bigint as records from sums group by all").to_arrow_reader(50_000)
            for b in got:
                yield pa.RecordBatch.from_arrays([b.column(i).cast(t.type) for i, t in enumerate(schema)], schema=schema)
            con.close()

    return split.repartition(min(partitions, 100_000), "_p").select("field", "term", "occurrences", "records").mapInArrow(run, COUNTS)


def marked(counts: DataFrame, total: Column, fewest: int = 3, most_share: float = 0.1) -> DataFrame:
    """counts plus `mark`: rare (fewer than `fewest` records), common (more than most_share of all records) or null."""
    return counts.withColumn("mark", F.when(F.col("records") < fewest, "rare").when(F.col("records") > most_share * total, "common"))


def term_frequencies(df: DataFrame, fields: dict[str, str], fewest: int = 3, most_share: float = 0.1, **how) -> DataFrame:
    """Every distinct plain value of the fields: occurrences, records, mark. An empty table gives no rows.

    The number of records is the whole table's, rows without values included.
    """
    partials = materialize(partial_counts(df, fields), "partials")
    total = partials.where("field is null").agg(F.sum("records")).first()[0] or 0
    return marked(radix_counts(partials.where("field is not null"), **how), F.lit(float(total)), fewest, most_share)

