"""Operator 10, exact top-k search with an impact-ordered index, a score at a time.

Components are whole numbers. A block of rows is indexed by term: each dimension makes two, one whose impact is the
component above the block's least and one whose impact is what it is below the block's largest; a query weighs one of
them by the size of its own component, so all contributions are 0 or more. A term's postings (row and impact, none where
the impact is 0) are cut into segments by quantised impact. Segments are processed from the highest impact down, for
some queries of a block together: a sum of what is seen bounds each row's score from below, and what is unseen is
bounded from above by the next impact. Work on a query stops only when no row but the ones that are still possible can
be among its k best; these are scored exactly.

The query set meets all rows in blocks: query blocks are broadcast where they take ``BROADCAST`` bytes at most, else
query blocks are copied to DEALS parts of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.vectors import HITS, distinct_best, matrix, ranked, usable

LEVELS = 8
BROADCAST = 32 << 20
DEALS = 64
TOGETHER = 128


def quantise(x: np.ndarray, scale: int) -> np.ndarray:
    v = np.floor(scale * x)
    if v.size and np.abs(v).max() >= 2**62:
        raise OverflowError("a component doesn't fit a long")
    return v.astype(np.int64)


class Block:
    """Impact-ordered index of a block of rows (whole numbers): segments of all terms by level, from the highest."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        if (np.diff(ids[order]) == 0).any():
            order = np.lexsort((*rows.T[::-1], ids))
        ids, rows = ids[order], rows[order]
        # repeated rows count once, and so does an id among the k best, however many rows it has
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]).any(1)])
        self.ids, self.rows = ids[new], rows[new]
        self.start = np.flatnonzero(np.concatenate([[True], self.ids[1:] != self.ids[:-1]]))
        low, high = self.rows.min(0), self.rows.max(0)
        impact = np.concatenate([self.rows - low, high - self.rows], axis=1)
        self.terms, self.most, self.largest = impact.shape[1], int(impact.max()), float(np.abs(self.rows).max())
        self.step = max(1, -(-(self.most + 1) // LEVELS))
        self.level = (impact // self.step).astype(np.int8)
        # postings (row, impact) of each level and term, from the highest level; impact 0 adds nothing and isn't held
        row, term = np.nonzero(impact)
        impact = impact[row, term]
        segment = (LEVELS - 1 - impact // self.step) * self.terms + term
        order = np.argsort(segment, kind="stable")
        self.post_row, self.post_impact = row[order].astype(np.int32), impact[order]
        self.ends = np.searchsorted(segment[order], np.arange(LEVELS * self.terms + 1))

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int):
        """For each query, ids and scores of its k best rows."""
        for a in range(0, len(qids), TOGETHER):  # sums of so many fit a processor's cache
            yield from self._search(qids[a : a + TOGETHER], queries[a : a + TOGETHER], k)

    def _search(self, qids, queries, k):
        weight = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1)
        size = weight.astype(float).sum(1).max(initial=0)
        if size * (float(self.most) + 1) >= 2**53 or size * self.largest >= 2**62:
            yield from self._plain(qids, queries, k)
            return
        kind = np.float32 if size * (float(self.most) + 1) < 2**24 else np.float64  # either holds all sums exactly
        w = np.ascontiguousarray(weight.T.astype(kind))
        own = self.ids[:, None] == qids
        n = len(self.ids)
        ids_here = len(self.start)
        k_here = min(k, ids_here)
        part = np.zeros((n, len(qids)), kind)  # for each row and query: what is seen of the score
        alive = np.arange(len(qids))
        for level in range(LEVELS - 1, -1, -1):
            for term in range(self.terms):
                s = (LEVELS - 1 - level) * self.terms + term
                a, b = self.ends[s], self.ends[s + 1]
                if a < b and w[term].any():
                    rows = self.post_row[a:b]  # each once
                    part[rows] += self.post_impact[a:b, None].astype(kind) * w[term]
            if level > LEVELS // 2:
                continue
            low = np.where(own[:, alive], -1, part)
            low = low if ids_here == n else np.maximum.reduceat(low, self.start, axis=0)
            kth = np.partition(low, ids_here - k_here, axis=0)[ids_here - k_here]
            # each term that isn't seen in a row adds its weight times the next impact at most
            unseen = (self.level < level).astype(kind) @ w
            bound = part + unseen * (level * self.step - 1) if level else part
            possible = (bound >= kth) & ~own[:, alive]
            few = possible.sum(0) <= (4 * k if level else n)
            for i in np.flatnonzero(few):
                pick = np.flatnonzero(possible[:, i])
                score = self.rows[pick] @ queries[alive[i]]
                best = distinct_best(self.ids[pick], score, k)
                yield qids[alive[i]], self.ids[pick[best]], score[best]
            rest = ~few
            if not rest.any():
                return
            alive = alive[rest]
            w, part = (np.ascontiguousarray(x[:, rest]) for x in (w, part))

    def _plain(self, qids, queries, k):
        """Sums too large for floating point or a long: whole numbers of any size; an error where a score found is."""
        rows = self.rows.astype(object)
        for qid, q in zip(qids, queries.astype(object)):
            pick = np.flatnonzero(self.ids != qid)
            score = np.array([int(s) for s in rows[pick] @ q], dtype=object)
            best = distinct_best(self.ids[pick], score, k)
            yield qid, self.ids[pick[best]], score[best].astype(np.int64)


def _pack(dim: int, scale: int, block: int):
    """Rows as blocks: ids and whole numbers."""

    def run(batches):
        ids, rows, n = [], [], 0

        def out():
            return pa.record_batch({"ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()), "rows": pa.array([np.concatenate(rows).tobytes()], pa.binary())})

        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                ids.append(np.asarray(part.column(0), dtype=np.int64))
                rows.append(quantise(matrix(part.column(1), dim), scale))
                n += len(ids[-1])
                if n >= block:
                    yield out()
                    ids, rows, n = [], [], 0
        if n:
            yield out()

    return run


def _meet(dim: int, k: int):
    def run(batches):
        held, index = None, None
        for batch in batches:
            for ids, rows, qids, queries in zip(*(batch.column(c) for c in range(4))):
                ids, rows, qids, queries = (c.as_py() for c in (ids, rows, qids, queries))
                if held != (ids, rows):
                    held, index = (ids, rows), Block(np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64).reshape(-1, dim))
                out = ([], [], [])
                for q, found, score in index.search(np.frombuffer(qids, np.int64), np.frombuffer(queries, np.int64).reshape(-1, dim), k):
                    out[0].append(q)
                    out[1].append(found.tobytes())
                    out[2].append(score.tobytes())
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["query_id", "ids", "scores"])

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, rows_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows of the largest inner product of whole numbers floor(scale * x).

    vectors and queries have vec_id and embedding (other columns are not read). Rows of the query's own vec_id don't
    count. Vectors that are null or hold null or non-finite components take no part, nor do null ids; zero vectors do,
    and shorter vectors count as ending with zeros. Ties go to the smaller vec_id, and repeated rows count once. An
    empty side gives no rows; a score among the k best that a long can't hold is an error.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, True), usable(queries, True)
    dim, n = asked.agg(F.max(F.size("embedding")), F.count("*")).first()
    dim = max(dim or 1, rows.agg(F.max(F.size("embedding"))).first()[0] or 1)
    packs = rows.mapInArrow(_pack(dim, scale, rows_block), "ids binary, rows binary")
    parts = max(1, -(-n // query_block))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    asks = asked.withColumn("part", group).groupBy("part").applyInArrow(lambda t: _ask(t, dim, scale), "part long, qids binary, queries binary")
    # each block of rows meets all query blocks one after the other, so it is indexed once
    small = n * dim * 8 <= BROADCAST
    deals = 1 if small else DEALS
    packs = packs.withColumn("deal", F.pmod(F.xxhash64("ids"), F.lit(deals)))
    asks = asks.withColumn("deal", F.pmod(F.xxhash64("qids"), F.lit(1))) if small else asks.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    met = packs.join(F.broadcast(asks) if small else asks.hint("merge"), "deal")
    hits = met.select("ids", "rows", "qids", "queries").mapInArrow(_meet(dim, k), HITS)
    return ranked(hits, k, "<i8", int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)


def _ask(table: pa.Table, dim: int, scale: int) -> pa.Table:
    ids = np.asarray(table.column("vec_id"), dtype=np.int64)
    x = quantise(matrix(table.column("embedding").combine_chunks(), dim), scale)
    return pa.table({"part": table.column("part").slice(0, 1), "qids": pa.array([ids.tobytes()], pa.binary()), "queries": pa.array([x.tobytes()], pa.binary())})


def op10_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_top_k(vectors, vectors.where("vec_id % 20 = 0"))
