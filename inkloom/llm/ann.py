"""Operator 2, approximate nearest neighbours by cross-polytope hashing.

A vector's direction is turned by a pseudo-random rotation (three rounds of random signs and a fast Hadamard
transform) and goes to the cell of the signed axis nearest to it. Each of ``tables`` tables has a rotation of its own.
A query probes, in each table, the cells of its ``probes`` nearest axes; the rows found there are compared with it
exactly, in double precision on the original vectors.

Rows of a cell are dealt into blocks of about ``block`` rows by a hash of their id, and the cell's queries go to each of
its blocks, so a cell with a third of all rows is spread too. The number of cells is fixed by the dimension alone.
Rows are parted by norm into ranges within each of which norms differ by ``RATIO`` at most, so that the order of angles
is nearly that of inner products. Each range has cells of its own, and a query probes all ranges. Neighbouring ranges
that together have few rows are one range that is compared whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.vectors import HITS, distinct_best, matrix, ranked, usable
from inkloom.session import Scratch

RATIO = 1.5


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def lengths(x: np.ndarray) -> np.ndarray:
    """Norms, without overflow."""
    most = np.abs(x).max(1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


class Hasher:
    """Cells of directions in each table, and steps of norm down from the longest."""

    def __init__(self, dim: int, tables: int, longest: float, seed: int = 2):
        self.width = 1 << max(1, int(dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.width)).astype(np.float32)
        self.longest = longest

    def prepare(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width), np.float32)
        x = x / np.abs(x).max(1)[:, None]
        out[:, : x.shape[1]] = x / lengths(x)[:, None]
        return out

    def steps(self, x: np.ndarray) -> np.ndarray:
        # a little more than the logarithm, so that equal norms fall into one step in spite of rounding
        return np.maximum(0, np.floor((np.log(self.longest) - np.log(lengths(x))) / np.log(RATIO) + 1e-6)).astype(int)

    def turned(self, x: np.ndarray, table: int) -> np.ndarray:
        for s in self.signs[table]:
            x = hadamard(x * s)
        return x

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        t = self.turned(x, table)
        axis = np.abs(t).argmax(1)
        return 2 * axis + (t[np.arange(len(t)), axis] < 0)

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        t = self.turned(x, table)
        near = np.stack([t, -t], axis=2).reshape(len(t), -1)
        return np.argsort(-near, axis=1, kind="stable")[:, :n]


def _longest(dim: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"longest": pa.array([lengths(matrix(batch.column(1), dim)).max()])})

    return run


def _count(hasher: Hasher, dim: int, tables: int):
    def run(batches):
        n = {}
        for batch in batches:
            exact = matrix(batch.column(1), dim)
            if not len(exact):
                continue
            x, step = hasher.prepare(exact), hasher.steps(exact)
            for t in range(tables):
                cell = hasher.cells(x, t)
                for s in np.unique(step):
                    n[s, t] = n.get((s, t), 0) + np.bincount(cell[step == s], minlength=2 * hasher.width)
        for (s, t), count in n.items():
            (c,) = np.nonzero(count)
            yield pa.record_batch({"step": pa.array(np.full(len(c), s), pa.int32()), "tab": pa.array(np.full(len(c), t), pa.int32()), "cell": pa.array(c, pa.int32()), "n": pa.array(count[c])})

    return run


class Ranges:
    """Ranges of norm, and the blocks of each one's cells: cell c of table t of range r has blocks[r, t, c] up to
    blocks[r, t, c + 1]. A range that is compared whole has all its rows in cell 0 of table 0."""

    def __init__(self, counts: dict[int, np.ndarray], whole: int, block: int):
        self.of, self.whole, kept, held = np.zeros(max(counts, default=0) + 1, int), [], [], 0
        for step in sorted(counts):
            n = int(counts[step][0].sum())
            if n > whole:
                self.whole.append(False)
                kept.append(counts[step])
            elif self.whole and self.whole[-1] and held + n <= whole:
                held += n
                kept[-1][0, 0] = held
            else:
                held = n
                self.whole.append(True)
                kept.append(np.zeros_like(counts[step]))
                kept[-1][0, 0] = held
            self.of[step] = len(kept) - 1
        shape = np.shape(kept)
        ends = np.cumsum(-(-np.ravel(kept).astype(np.int64) // block))
        self.blocks = np.zeros((0, 0, 1), np.int64)
        if kept:
            self.blocks = np.concatenate([np.concatenate([[0], ends[:-1]]).reshape(shape), ends.reshape(shape)[:, :, -1:]], axis=2)


def _packs(key: np.ndarray, ids: np.ndarray, x: np.ndarray):
    """Rows (key, ids, vectors) of rows with one key each."""
    order = np.argsort(key, kind="stable")
    key, ids, x = key[order], ids[order], x[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    ends = np.append(cut[1:], len(key))
    yield pa.record_batch(
        [pa.array(key[cut].astype(np.int64)), pa.array([ids[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()), pa.array([x[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())],
        names=["key", "ids", "vectors"],
    )


def _route(hasher: Hasher, dim: int, tables: int, probes: int, ranges: Ranges, query: bool):
    """Rows or queries by block."""
    blocks = ranges.blocks

    def run(batches):
        for batch in batches:
            ids, exact = np.asarray(batch.column(0), dtype=np.int64), matrix(batch.column(1), dim)
            if not len(ids):
                continue
            x = hasher.prepare(exact)
            part = None if query else ranges.of[hasher.steps(exact)]
            for t in range(tables):
                if query:
                    near = hasher.probes(x, t, probes)
                    for r, whole in enumerate(ranges.whole):
                        if whole and t:
                            continue
                        cells = near[:, :1] * 0 if whole else near
                        cell, row = cells.ravel(), np.repeat(np.arange(len(ids)), cells.shape[1])
                        first, n = blocks[r, t, cell], blocks[r, t, cell + 1] - blocks[r, t, cell]
                        key = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        yield from _packs(key, ids[np.repeat(row, n)], exact[np.repeat(row, n)])
                else:
                    whole = np.array(ranges.whole)[part]
                    cell = np.where(whole, 0, hasher.cells(x, t))
                    n = np.maximum(blocks[part, t, cell + 1] - blocks[part, t, cell], 1).astype(np.uint64)
                    deal = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % n
                    here = ~whole if t else np.ones(len(ids), bool)
                    yield from _packs((blocks[part, t, cell] + deal.astype(np.int64))[here], ids[here], exact[here])

    return run


def _compare(dim: int, k: int):
    def read(table: pa.Table):
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
        return ids, np.frombuffer(b"".join(table.column("vectors").to_pylist()), np.float64).reshape(len(ids), dim)

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = ([], [], [])
        if queries.num_rows and rows.num_rows:
            (qid, q), (rid, r) = read(queries), read(rows)
            order = np.argsort(rid, kind="stable")
            rid, r = rid[order], r[order]
            # an id counts once among the k best, however many rows it has
            start = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]]))
            for a in range(0, len(qid), 1024):
                with np.errstate(over="ignore", invalid="ignore"):  # named below, as an error
                    near = q[a : a + 1024] @ r.T
                if np.isnan(near).any() or np.isinf(near).any():
                    raise OverflowError("an inner product doesn't fit a double")
                near[qid[a : a + 1024, None] == rid] = -np.inf
                single = near if len(start) == len(rid) else np.maximum.reduceat(near, start, axis=1)
                least = np.partition(single, len(start) - k, axis=1)[:, -k] if len(start) > k else np.full(len(near), -np.inf)
                slack = 1e-9 * np.maximum(1, np.abs(near, where=np.isfinite(near), out=np.zeros_like(near)).max(1))
                for i, row in enumerate(near):
                    pick = np.flatnonzero((row >= least[i] - slack[i]) & (row > -np.inf))
                    score = (r[pick] * q[a + i]).sum(1)  # in one order of terms, so that equal vectors tie
                    best = distinct_best(rid[pick], score, k)
                    out[0].append(qid[a + i])
                    out[1].append(rid[pick[best]].tobytes())
                    out[2].append(score[best].tobytes())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "ids": pa.array(out[1], pa.binary()), "scores": pa.array(out[2], pa.binary())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 10, probes: int = 12, block: int = 8192, whole: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score: of the rows found for each query, the k of the largest inner product.

    vectors and queries have vec_id and embedding (other columns are not read). Rows of the query's own vec_id are not
    its neighbours. Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids;
    shorter vectors count as ending with zeros. Ties go to the smaller vec_id, and repeated rows count once. An empty
    side gives no rows. An inner product that a double can't hold is an error. A range of norms with ``whole`` rows at most is compared whole. A
    query that found fewer than k rows probes all cells, so it ends with k or with all there are.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, False), usable(queries, False)
    facts = rows.agg(F.max(F.size("embedding"))).first()
    dim = max(facts[0] or 1, asked.agg(F.max(F.size("embedding"))).first()[0] or 1)
    longest = rows.mapInArrow(_longest(dim), "longest double").agg(F.max("longest")).first()[0]
    hasher = Hasher(dim, tables, longest or 1.0)
    probes = min(probes, 2 * hasher.width)
    # how many blocks each cell needs: as many numbers as there are cells
    counts: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(_count(hasher, dim, tables), "step int, tab int, cell int, n long").groupBy("step", "tab", "cell").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["step"], np.zeros((tables, 2 * hasher.width), np.int64))[r["tab"], r["cell"]] = r["n"]
    ranges = Ranges(counts, whole, block)
    kind = "key long, ids binary, vectors binary"
    left = asked.mapInArrow(_route(hasher, dim, tables, probes, ranges, True), kind)
    right = rows.mapInArrow(_route(hasher, dim, tables, probes, ranges, False), kind)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    hits = left.groupBy("key").cogroup(right.groupBy("key")).applyInArrow(_compare(dim, k), HITS)
    out = Scratch(spark, "nearest").save(ranked(hits, k, "<f8", spread), "hits")
    if all(ranges.whole):
        return out
    full = out.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = asked.join(full, "vec_id", "left_anti")
    if short.isEmpty():
        return out
    # all cells of one table hold all rows
    left = short.mapInArrow(_route(hasher, dim, 1, 2 * hasher.width, ranges, True), kind)
    right = rows.mapInArrow(_route(hasher, dim, 1, probes, ranges, False), kind)
    hits = left.groupBy("key").cogroup(right.groupBy("key")).applyInArrow(_compare(dim, k), HITS)
    return out.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").select(*out.columns).unionByName(ranked(hits, k, "<f8", spread))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
