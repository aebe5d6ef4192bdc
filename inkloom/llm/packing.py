"""Operator 4, best-fit packing of documents into training sequences.

Conflict-constrained best fit: pieces are placed from the longest to the shortest; bins are kept in the order of their
residual space, each with a bitmap of the sources and one of the duplicate clusters in it. The search starts at the
bin with the least residual that holds the piece and goes on to the next larger as long as a bitmap has the piece's
bit, so a piece ends in the tightest bin that is compatible, or opens a new one.

Documents are dealt into shards by a hash of the copy, about ``shard_docs`` to a shard, so a source or a cluster with a
third of all rows is spread evenly; shards pack without each other. Only ids and lengths are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.session import Scratch

SPACES = r"[\x20\x09-\x0D]+"


def best_fit(items: list[tuple], capacity: int, by_source: bool = True) -> list[int]:
    """Bin number of each item (size, source, cluster), in the order given."""
    order: list[tuple[int, int]] = []  # (residual, bin)
    sources: list[int] = []
    clusters: list[int] = []
    source_bits: dict = {}
    cluster_bits: dict = {}
    out = []
    for size, source, cluster in items:
        s = 1 << source_bits.setdefault(source, len(source_bits)) if by_source else 0
        c = 1 << cluster_bits.setdefault(cluster, len(cluster_bits))
        i = bisect_left(order, (size, -1))
        while i < len(order) and (sources[order[i][1]] & s or clusters[order[i][1]] & c):
            i += 1
        if i < len(order):
            residual, b = order.pop(i)
        else:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        if residual > size:
            insort(order, (residual - size, b))
        out.append(b)
    return out


def _pack_shard(capacity: int, by_source: bool):
    def pack(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (-r["words"], r["doc_id"] is None, r["doc_id"] or 0, r["text_key"] or 0, r["copy"], r["start"]))
        bins = best_fit([(r["words"], r["source"], r["cluster"]) for r in rows], capacity, by_source)
        slot: dict[int, int] = {}
        used: dict[int, int] = {}
        slots, offsets = [], []
        for r, b in zip(rows, bins):
            slots.append(slot.get(b, 0))
            offsets.append(used.get(b, 0))
            slot[b], used[b] = slots[-1] + 1, offsets[-1] + r["words"]
        col = lambda n, kind: pa.array([r[n] for r in rows], kind)
        return pa.table(
            {
                "shard": col("shard", pa.int32()), "bin": pa.array(bins, pa.int32()), "slot": pa.array(slots, pa.int32()), "offset": pa.array(offsets, pa.int64()),
                "doc_id": col("doc_id", pa.int64()), "text_key": col("text_key", pa.int64()), "copy": col("copy", pa.int32()), "start": col("start", pa.int64()), "words": col("words", pa.int64()),
            }
        )

    return pack


def pack(docs: DataFrame, capacity: int = 2048, shard_docs: int = 2000, by_source: bool = True, cluster=None) -> DataFrame:
    """Places of all words of docs (doc_id, text, source; other columns are not read) in bins of ``capacity`` words.

    One row for each piece: shard and bin (together the sequence's name), slot and offset in the bin, doc_id, text_key
    (hash of the text), copy (from 0, of equal rows), start (first word, from 0) and words. A document over the capacity
    is cut into pieces of the capacity, which fill bins of their own, and a rest. No bin holds two pieces of one
    duplicate cluster (by default the text in lower case with single spaces; ``cluster`` may name another expression), nor,
    ``by_source``, two documents of one source; null sources count as one. Texts without words (null or empty)
    have nothing to place and no row. Repeated rows are copies of one cluster. An empty table gives an empty one.
    """
    # words with one space between; the text is gone over once, and what follows reads saved ids and lengths
    plain = F.trim(F.regexp_replace("text", SPACES, " "))
    words = F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1)
    same = F.xxhash64(F.lower("plain")) if cluster is None else F.col("cluster")  # equal by default: the same words but for case
    given = F.lit(None).cast("long") if cluster is None else cluster.cast("long")
    read = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("text_key"), given.alias("cluster"), plain.alias("plain"))
    items = read.select("doc_id", "source", "text_key", same.alias("cluster"), words.cast("long").alias("n"))
    items = items.groupBy("doc_id", "source", "text_key", "cluster", "n").agg(F.count("*").cast("int").alias("copies"))
    items = Scratch(docs.sparkSession, "packing").save(items, "items").where("n > 0")
    count = items.agg(F.sum("copies")).first()[0] or 0
    shards = max(1, -(-count // shard_docs))
    items = items.select("doc_id", "source", "text_key", "cluster", "n", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_key", "copy"), F.lit(shards)).cast("int"))
    cuts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity)), lambda k: F.struct((k * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - k * capacity).alias("words")))
    pieces = items.select("shard", "doc_id", "source", "text_key", "cluster", "copy", F.inline(cuts))
    kind = "shard int, bin int, slot int, offset long, doc_id long, text_key long, copy int, start long, words long"
    return pieces.groupBy("shard").applyInArrow(_pack_shard(capacity, by_source), kind)


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return pack(docs)
