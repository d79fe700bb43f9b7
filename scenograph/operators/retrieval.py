"""Search over entities and scenes: vectors, BM25, their fusion, and the two-track gate for entity candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenograph.functions.predicates import not_tainted
from scenograph.functions.text import identity_text, tokens
from scenograph.functions.vectors import certainty, sparse_vectors
from scenograph.operators.ranking import ranked
from scenograph.operators.scoring import prepared, scored
from scenograph.session import materialize

STRONG, KEEP, CONTENT_LEAST, CONTENT_STRONG = 0.75, 0.62, 0.10, 0.35
K1, B = 1.2, 0.75
SALTS = 8  # parts into which the documents of a novel and term are dealt; queries, the small stated side, go to each


def _dealt(docs: DataFrame, keys: list[str]) -> DataFrame:
    return docs.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))


def _to_each(queries: DataFrame) -> DataFrame:
    return queries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def near_vectors(queries: DataFrame, rows: DataFrame, k: int = 5, block_rows: int = 20_000) -> DataFrame:
    """queries(query_id, vec), rows(row_id, vec) -> (query_id, row_id, certainty), the k nearest by cosine; ties by row_id.

    The query set is read in blocks of at most block_rows vectors, one at a time, so what is broadcast is bounded; each block is multiplied with the rows
    batch by batch and every batch passes on its k best, so at most k rows a query and batch are shuffled. A row is not its own neighbour.
    """
    spark = rows.sparkSession
    done: list[DataFrame] = []
    last = None
    schema = "query_id long, row_id long, cosine double"

    def search(block: list) -> tuple[DataFrame, Broadcast]:
        ids = np.array([r[0] for r in block], np.int64)
        m = np.array([r[1] for r in block], np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)
        shared = spark.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                row = b.column(0).to_numpy()
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(row), -1)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
                for a in range(0, len(ids), 1024):
                    c = np.round(m[a : a + 1024] @ v.T, 12)
                    c[ids[a : a + 1024, None] == row[None, :]] = -9
                    best = np.lexsort((np.broadcast_to(row, c.shape), -c), axis=1)[:, :k] if len(row) > k else np.tile(np.arange(len(row)), (len(c), 1))
                    q = np.repeat(ids[a : a + 1024], best.shape[1])
                    score = np.take_along_axis(c, best, 1).ravel()
                    ok = score > -9
                    yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(row[best.ravel()][ok]), pa.array(score[ok])], names=["query_id", "row_id", "cosine"])

        return rows.where("row_id is not null and vec is not null").select("row_id", "vec").mapInArrow(run, schema), shared

    def settled(found: DataFrame, shared: Broadcast) -> DataFrame:
        out = materialize(found, "near")
        shared.destroy()
        return out

    block: list = []
    for r in queries.where("query_id is not null and vec is not null").select("query_id", "vec").toLocalIterator():
        block.append(r)
        if len(block) == block_rows:
            if last:
                done.append(settled(*last))
            last, block = search(block), []
    if block:
        if last:
            done.append(settled(*last))
        last = search(block)
    if not last:
        out = spark.createDataFrame([], schema)
    else:
        out = reduce(DataFrame.unionByName, [*done, settled(*last)]) if done else last[0]
    return top_k(out, ["query_id"], [F.col("cosine").desc(), F.col("row_id")], k).select("query_id", "row_id", certainty("cosine").alias("certainty"))


def term_frequencies(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*keys, F.explode(tokens(text)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, scope: list[str], doc_keys: list[str], query_keys: list[str], query_text: str, text: str, k1: float = K1, b: float = B) -> DataFrame:
    """(query_keys, doc_keys, bm25) of every document that shares a term with the query within the same scope columns.

    Frequencies are over all documents of docs. A query's terms count once. Documents and queries meet on (scope, term), pre-aggregated to one row
    a document and term.
    """
    tf = term_frequencies(docs, scope + doc_keys, text)
    lengths = tf.groupBy(*scope, *doc_keys).agg(F.sum("tf").alias("dl"))
    whole = docs.agg(F.count("*").alias("n")).crossJoin(lengths.agg(F.avg("dl").alias("avgdl")))  # one row each
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    terms = queries.select(*scope, *query_keys, F.explode(F.array_distinct(tokens(query_text))).alias("term"))
    scored = _to_each(terms).join(_dealt(tf, doc_keys), scope + ["term", "_salt"]).join(df, "term").join(lengths, scope + doc_keys).crossJoin(F.broadcast(whole))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return scored.groupBy(*scope, *query_keys, *doc_keys).agg(F.sum(score).alias("bm25"))


def sparse_near(queries: DataFrame, docs: DataFrame, scope: list[str], doc_keys: list[str], query_keys: list[str], query_text: str, text: str) -> DataFrame:
    """(scope, query_keys, doc_keys, cosine) of all documents that share a bucket of the hashed-token vector with the query."""
    q = sparse_vectors(queries, scope + query_keys, query_text).withColumnRenamed("weight", "wq")
    d = sparse_vectors(docs, scope + doc_keys, text).withColumnRenamed("weight", "wd")
    return _to_each(q).join(_dealt(d, doc_keys), scope + ["bucket", "_salt"]).groupBy(*scope, *query_keys, *doc_keys).agg(F.sum(F.col("wq") * F.col("wd")).alias("cosine"))


def ranked_fuse(vector: DataFrame, keyword: DataFrame, keys: list[str], query_keys: list[str], constant: int = 60) -> DataFrame:
    """(keys, hybrid) by reciprocal ranks, the other kind of fusion."""

    def ranks(df: DataFrame, c: str) -> DataFrame:
        order = Window.partitionBy(*query_keys).orderBy(F.round(c, 9).desc(), *[k for k in keys if k not in query_keys])
        return df.withColumn(c, 1 / (constant + F.row_number().over(order))).select(*keys, c)

    both = ranks(vector, "cosine").join(ranks(keyword, "bm25"), keys, "full")
    return both.select(*keys, (F.coalesce("cosine", F.lit(0.0)) + F.coalesce("bm25", F.lit(0.0))).alias("hybrid"))


def literal_overlap(a: Column | str, b: Column | str) -> Column:
    """Whether two names share a character other than blanks."""
    letters = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), ""), lambda x: F.trim(x) != "")
    return F.coalesce(F.arrays_overlap(letters(a), letters(b)), F.lit(False))


def gate(overlap: Column, id_sim: Column, content_sim: Column) -> tuple[Column, Column]:
    """(rule, score) of a candidate; the first rule that holds wins, none drops it (null)."""
    rule = F.when(id_sim >= STRONG, 1).when(overlap & (id_sim >= KEEP), 2).when(overlap & (content_sim >= CONTENT_LEAST), 3).when(content_sim >= CONTENT_STRONG, 4)
    return rule, F.when(rule <= 2, id_sim).when(rule > 2, content_sim)


def similar_entities(mentions: DataFrame, entities: DataFrame, k: int = 5) -> DataFrame:
    """Candidates of each mention among the entities of its novel up to its volume, not tainted: (mention_id, entity_uuid, id_sim, content_sim, rule, score).

    mentions(mention_id, novel_hash, vol_num, keyword, mention_type, context_summary); entities are current rows with `searched`, their description and
    events, and `words`, all text that BM25 scores. Track A: identity vectors, same type where the novel has any such candidate, else any type. Track B:
    hybrid of content vectors and BM25 on keyword and the first 400 characters of the context, same type only. Tracks are united by uuid, a missing side
    is 0, and the gate decides. Mentions without keyword find nothing.
    """
    m = mentions.where("trim(coalesce(keyword, '')) <> ''").withColumn("_text", F.concat_ws(" ", "keyword", F.substring("context_summary", 1, 400)))
    e = entities.where(not_tainted())
    asked = prepared(m, "mention_id", "novel_hash", F.col("_text"), F.col("_text"), F.col("keyword"), F.col("vol_num"), F.lower(F.trim("mention_type")))
    docs = prepared(e, "entity_uuid", "novel_hash", F.col("searched"), F.col("words"), identity_text("keyword", "aliases"), F.col("vol_num"), F.lower(F.trim("entity_type")))
    track_a, track_b = scored(docs, asked, k)
    united = track_a.withColumnRenamed("score", "id_sim").join(track_b.withColumnRenamed("score", "content_sim"), ["qid", "key"], "full").na.fill(0.0, ["id_sim", "content_sim"])
    united = united.select(F.col("qid").alias("mention_id"), F.col("key").alias("entity_uuid"), "id_sim", "content_sim")
    named = united.join(m.select("mention_id", F.col("keyword").alias("m_keyword")), "mention_id").join(e.select("entity_uuid", F.col("keyword").alias("e_keyword")), "entity_uuid")
    rule, score = gate(literal_overlap("m_keyword", "e_keyword"), F.col("id_sim"), F.col("content_sim"))
    judged = named.select("mention_id", "entity_uuid", "id_sim", "content_sim", rule.alias("rule"), score.alias("score")).where("rule is not null")
    return top_k(judged, ["mention_id"], [F.round("score", 9).desc(), F.col("entity_uuid")], k)


def search(queries: DataFrame, docs: DataFrame, key: str, text: str, words: str, limit: int = 5, scope: str = "novel_hash") -> DataFrame:
    """queries(query_id, query_text, scope) -> (query_id, key, hybrid): the best `limit` documents of the scope by hybrid score of vectors of `text` and BM25 of `words`, ties by key."""
    asked = prepared(queries, "query_id", scope, F.col("query_text"), F.col("query_text"))
    _, best = scored(prepared(docs, key, scope, F.col(text), F.col(words)), asked, limit)
    return best.select(F.col("qid").alias("query_id"), F.col("key").alias(key), F.col("score").alias("hybrid"))


def ranked_search(queries: DataFrame, docs: DataFrame, key: str, text: str, words: str, limit: int = 5, scope: str = "novel_hash") -> DataFrame:
    """The same by reciprocal ranks in both lists, exact over whole lists."""
    asked = prepared(queries, "query_id", scope, F.col("query_text"), F.col("query_text"))
    best = ranked(prepared(docs, key, scope, F.col(text), F.col(words), unscoped=True), asked, limit)
    return best.select(F.col("qid").alias("query_id"), F.col("key").alias(key), F.col("score").alias("hybrid"))


def clamp(limit: int, most: int = 15) -> int:
    return max(1, min(limit, most))
