"""Operator 9, substring dedup: words covered by a window of 50 words that also starts in a smaller document go.

Method: count-min prefilter. Of the 26 runs of 25 words in a window, the one with the least hash stands for it, so a
window is repeated only where its run is. Each partition counts its runs in a sketch of two rows; the merged sketches
overestimate the count of each window, and a second pass groups exactly those windows that are estimated at two or
more, losing none. Where the sketch is full, more windows reach the exact pass; its result is the same.

A window that several documents of one block hold is decided in the block for all but the smallest of them, so even a
window of a third of all documents reaches the exact pass once for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.llm import words as W
from inkloom.llm.names import fresh

SLICE = 20  # bits of a cell's number within its slice
ROWS = 2


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Least of each k values in a row, by doubling."""
    n, width, out = len(x) - k + 1, 1, x
    if n <= 0:
        return x[:0]
    while 2 * width <= k:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[:n], out[k - width : k - width + n])


class Reader:
    """Windows of a block of texts: hashes, the runs that stand for them, and their documents' rows."""

    def __init__(self, width: int):
        self.width, self.run = width, (width + 1) // 2
        self.words, self.windows, self.runs = W.Words((11,)), W.Windows(width), W.Windows(self.run)

    def read(self, column):
        data, off = W.string_parts(column)
        _, _, (h,), first = self.words.hashes(data, off)
        if len(h) < self.width:
            z = np.zeros(0, np.int64)
            return z, z, z.astype(np.uint64), z.astype(np.uint64), first
        counts = np.maximum(np.diff(first) - self.width + 1, 0)
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][doc]
        stand = sliding_min(self.runs.hashes(h), self.width - self.run + 1)
        return doc, at, self.windows.hashes(h)[at], stand[at], first


def _cells(stand: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [(stand & mask).astype(np.int64), ((stand >> np.uint64(32)) & mask).astype(np.int64)]


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def sketch_partition(width: int, bits: int, block: int):
    """Sketch of a partition: for each slice, its cells; the lowest bit says whether it counts two or more."""

    def count(batches):
        reader, parts = Reader(width), []

        def merged(parts):
            keys = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            keys, inverse = np.unique(keys, return_inverse=True)
            return [(keys, np.minimum(np.bincount(inverse, n, len(keys)), 2).astype(np.uint8))]

        for batch in batches:
            for part in W.slices(batch, "text", block):
                doc, _, _, stand, _ = reader.read(part.column(part.schema.get_field_index("text")))
                stand = stand[_changes(doc, stand)]
                for row, cell in enumerate(_cells(stand, bits)):
                    keys, n = np.unique(cell + (row << bits), return_counts=True)
                    parts.append((keys, np.minimum(n, 2).astype(np.uint8)))
                if len(parts) > 32:
                    parts = merged(parts)
        if parts:
            ((keys, n),) = merged(parts)
            yield from _slices_out(keys, n)

    return count


def _slices_out(keys: np.ndarray, n: np.ndarray):
    part, start = np.unique(keys >> SLICE, return_index=True)
    coded = (((keys & ((1 << SLICE) - 1)) << 1) | (n > 1)).astype(np.uint32)
    ends = np.append(start[1:], len(keys))
    for s, a, b in zip(part, start, ends):
        yield pa.record_batch({"slice": pa.array([s], pa.int32()), "cells": pa.array([coded[a:b].tobytes()], pa.binary())})


def merge_slices(final: bool):
    """Adds up sketches slice by slice as they stream in; at last, the bits of cells that count two or more."""

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = held.setdefault(s, np.zeros(1 << SLICE, np.uint8))
                coded = np.frombuffer(cells, np.uint32)
                at = coded >> 1
                x[at] = np.minimum(x[at] + 1 + (coded & 1), 2)
        for s, x in held.items():
            if final:
                yield pa.record_batch({"slice": pa.array([s], pa.int32()), "cells": pa.array([np.packbits(x > 1, bitorder="little").tobytes()], pa.binary())})
            else:
                at = np.flatnonzero(x)
                yield from _slices_out(at + (np.int64(s) << SLICE), x[at])

    return merge


def count_sketch(docs: DataFrame, width: int, bits: int, block: int) -> list[np.ndarray]:
    """Merged sketch as bits for each row: whether a cell counts two or more. Its size is fixed by bits alone."""
    kind = "slice int, cells binary"
    some = docs.select("text").mapInArrow(sketch_partition(width, bits, block), kind)
    some = some.withColumn("salt", F.spark_partition_id() % 8).repartition("slice", "salt").select("slice", "cells").mapInArrow(merge_slices(False), kind)
    rows = some.repartition("slice").mapInArrow(merge_slices(True), kind).collect()
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(ROWS)]
    each = 1 << (SLICE - 3)
    for r in rows:
        row, part = divmod(r["slice"], 1 << (bits - SLICE))
        out[row][part * each : (part + 1) * each] = np.frombuffer(r["cells"], np.uint8)
    return out


ASKED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("runs", T.BinaryType()), T.StructField("asks", T.BinaryType())])
RUN = np.dtype([("stand", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("at", "<i4"), ("done", "<u4"), ("ask", "<u4")])


def ask_partition(width: int, bits: int, block: int, buckets: int, sketch):
    """For each block: windows that may be repeated, in runs that share what stands for them, by bucket."""

    def ask(batches):
        reader, rows = Reader(width), sketch.value
        for batch in batches:
            for part in W.slices(batch, "text", block):
                column = {n: part.column(k) for k, n in enumerate(part.schema.names)}
                doc, at, h, stand, first = reader.read(column["text"])
                new = np.flatnonzero(_changes(doc, stand))
                maybe = np.ones(len(new), bool)
                for bitmap, cell in zip(rows, _cells(stand[new], bits)):
                    maybe &= (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
                ids = np.asarray(column["doc_id"].fill_null(0))
                maybe &= ~np.asarray(column["doc_id"].is_null())[doc[new]]
                lens = np.diff(np.append(new, len(doc)))
                keep = np.repeat(maybe, lens)
                if not keep.any():
                    continue
                doc, at, h, stand = doc[keep], (at - first[:-1][doc])[keep], h[keep], stand[keep]
                # of the documents here that hold a window, only the smallest has to ask
                order = np.lexsort((stand, h))
                starts = np.flatnonzero(_changes(h[order], stand[order]))
                least = np.repeat(np.minimum.reduceat(ids[doc][order], starts), np.diff(np.append(starts, len(order))))
                done = np.empty(len(doc), bool)
                done[order] = ids[doc][order] > least
                # at most 32 windows, one after the other, to a run
                start = np.flatnonzero(_changes(doc, stand, at - np.arange(len(at))))
                start = np.unique(np.concatenate([np.arange(a, b, 32) for a, b in zip(start, np.append(start[1:], len(doc)))])) if (np.diff(np.append(start, len(doc))) > 32).any() else start
                bit = np.uint32(1) << (np.arange(len(doc)) - np.repeat(start, np.diff(np.append(start, len(doc))))).astype(np.uint32)
                runs = np.zeros(len(start), RUN)
                runs["stand"], runs["doc"], runs["text"], runs["at"] = stand[start], ids[doc[start]], np.asarray(column["tkey"])[doc[start]], at[start]
                runs["done"], runs["ask"] = np.add.reduceat(np.where(done, bit, 0), start), np.add.reduceat(np.where(done, 0, bit), start)
                bucket = (W.mix(runs["stand"]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(doc))))
                place = np.empty(len(start), np.int64)
                place[order] = np.arange(len(start))
                words = np.argsort(place[of], kind="stable")
                words = words[~done[words]]
                cuts = np.flatnonzero(_changes(bucket[order]))
                run_ends = np.append(cuts[1:], len(order))
                word_cuts = np.searchsorted(place[of[words]], np.append(cuts, len(order)))
                yield pa.record_batch(
                    [
                        pa.array(bucket[order][cuts], pa.int32()),
                        pa.array([runs[order[a:b]].tobytes() for a, b in zip(cuts, run_ends)], pa.binary()),
                        pa.array([h[words[a:b]].tobytes() for a, b in zip(word_cuts[:-1], word_cuts[1:])], pa.binary()),
                    ],
                    names=["bucket", "runs", "asks"],
                )

    return ask


def answer_bucket(table: pa.Table) -> pa.Table:
    """Of each run, the windows that a smaller document holds."""
    runs = np.frombuffer(b"".join(table.column("runs").to_pylist()), RUN)
    h = np.frombuffer(b"".join(table.column("asks").to_pylist()), np.uint64)
    ask = (runs["ask"][:, None] >> np.arange(32, dtype=np.uint32)) & 1 == 1
    of, bit = np.nonzero(ask)
    found = runs["done"].copy()
    if len(h):
        stand, doc = runs["stand"][of], runs["doc"][of]
        order = np.lexsort((stand, h))
        starts = np.flatnonzero(_changes(h[order], stand[order]))
        least = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.append(starts, len(order))))
        hit = order[doc[order] > least]
        np.bitwise_or.at(found, of[hit], np.uint32(1) << bit[hit].astype(np.uint32))
    keep = found > 0
    return pa.table({"doc_id": pa.array(runs["doc"][keep]), "tkey": pa.array(runs["text"][keep]), "at": pa.array(runs["at"][keep]), "mask": pa.array(found[keep].astype(np.int64))})


def drop_words(width: int, cuts_name: str):
    def drop(batches):
        for batch in batches:
            names = batch.schema.names
            n_words, n_removed, kept = [], [], []
            for text, cuts in zip(batch.column(names.index("text")), batch.column(names.index(cuts_name))):
                raw = text.as_buffer() if text.is_valid else None
                words = bytes(raw).split() if raw is not None else []
                gone = np.zeros(len(words) + 1, np.int64)
                if cuts.is_valid:
                    runs = cuts.values
                    at = np.asarray(runs.field("at"), dtype=np.int64)
                    mask = np.asarray(runs.field("mask"), dtype=np.int64)
                    of, bit = np.nonzero((mask[:, None] >> np.arange(32)) & 1)
                    start = at[of] + bit
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + width, -1)
                removed = np.cumsum(gone)[:-1] > 0
                n_words.append(len(words))
                n_removed.append(int(removed.sum()))
                kept.append(b" ".join(w for w, g in zip(words, removed.tolist()) if not g) if n_removed[-1] else b" ".join(words))
            rest = [(n, batch.column(k)) for k, n in enumerate(names) if n not in ("text", cuts_name)]
            yield pa.record_batch(
                [c for _, c in rest] + [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                names=[n for n, _ in rest] + ["text", "n_words", "n_removed"],
            )

    return drop


def remove_repeats(docs: DataFrame, width: int = 50, sketch_bits: int = 26, block: int = 4 << 20, bucket_words: int = 2_000_000) -> DataFrame:
    """Documents without the words that windows of ``width`` words share with a smaller document.

    docs has doc_id and text; other columns stay as they are, whatever their names. Windows are judged on the input. The result's text is the
    words kept, joined by one space; n_words and n_removed count all words and those removed, and replace columns of
    these names. A null text has no words and becomes empty. Rows of one doc_id are one document and don't remove each
    other's words; with a null doc_id, a row neither loses words nor makes others lose any. An empty table gives an
    empty one. ``width`` is 2 to 62. ``sketch_bits`` sets the sketch's size: two rows of 2**sketch_bits bits reach each worker.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    key, runs = fresh(own, "key", "cuts")
    keyed = docs.select(*own).withColumn(key, F.xxhash64("text"))
    slim = keyed.select("doc_id", "text", F.col(key).alias("tkey"))
    sketch = spark.sparkContext.broadcast(count_sketch(slim, width, sketch_bits, block))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(16, size // (6 * bucket_words)))
    asked = slim.mapInArrow(ask_partition(width, sketch_bits, block, buckets, sketch), ASKED)
    hits = asked.groupBy("bucket").applyInArrow(answer_bucket, "doc_id long, tkey long, at int, mask long")
    cuts = hits.groupBy("doc_id", F.col("tkey").alias(key)).agg(F.collect_list(F.struct("at", "mask")).alias(runs))
    joined = keyed.join(cuts, ["doc_id", key], "left").select(*own, runs)
    rest = [f for f in joined.schema.fields if f.name not in ("text", runs)]
    schema = T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(drop_words(width, runs), schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
