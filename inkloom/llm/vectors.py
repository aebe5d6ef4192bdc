"""Vectors of Arrow batches as matrices, and best hits of query and row blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HITS = "query_id long, ids binary, scores binary"


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id and embedding (doubles) of rows that take part: neither is null, no component is null or not finite, and,
    unless zero vectors count, one isn't 0."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows if zero else rows.where(F.exists("embedding", lambda x: x != 0))


def matrix(column, dim: int) -> np.ndarray:
    """Rows of an Arrow list array of doubles; shorter ones end with zeros."""
    lens = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(lens) and (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def distinct_best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by id; of equal (id, score), one."""
    order = np.lexsort((ids, -scores))
    i, s = ids[order], scores[order]
    return order[np.concatenate([[True], (i[1:] != i[:-1]) | (s[1:] != s[:-1])])][:k] if len(order) else order


def best_of(k: int, kind: str):
    """For applyInArrow over rows (query_id, ids, scores) of whole queries: rank, vec_id and score of the k best."""

    def merge(table: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
        scores = [np.frombuffer(x, kind) for x in table.column("scores").to_pylist()]
        query = np.repeat(np.asarray(table.column("query_id"), dtype=np.int64), [len(x) for x in ids])
        ids, scores = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((ids, np.int64), (scores, kind)))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        if len(query):
            new = np.concatenate([[True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])])
            query, ids, scores = query[new], ids[new], scores[new]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first + 1
        keep = rank <= k
        return pa.table({"query_id": query[keep], "rank": rank[keep].astype(np.int32), "vec_id": ids[keep], "score": scores[keep]})

    return merge


def ranked(hits: DataFrame, k: int, kind: str, spread: int) -> DataFrame:
    """The k best of all hits of each query; queries are dealt into ``spread`` groups."""
    sql = "double" if kind == "<f8" else "long"
    grouped = hits.withColumn("_group", F.pmod(F.xxhash64("query_id"), F.lit(spread)))
    return grouped.groupBy("_group").applyInArrow(best_of(k, kind), f"query_id long, rank int, vec_id long, score {sql}")
