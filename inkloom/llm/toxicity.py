"""Operator 5, toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's logit is a bias and the sum of its words' weights; the document's
probability is the noisy-or of its sentences', 1 - prod(1 - p). Weights are fitted to the documents' labels alone, and
the sentences that then score high are the ones that make a document toxic. A word's features are itself and its first
4 to 9 bytes, which catch inflected and compound forms; features whose share among toxic documents isn't off their share
among others by ``least_z`` standard errors are left out.

Fitting takes a bounded sample of labelled rows (``per_class`` of each label, texts of ``train_chars`` characters at
most). Features are chosen by counts of documents first, and only the chosen ones of each sentence reach the driver.
Scoring is one pass over all texts in whole, in NumPy; long texts are read in pieces that end with a sentence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import words as W
from inkloom.session import Scratch

BITS = 20
PREFIXES = (4, 5, 6, 7, 8, 9)
BLOCK = 4 << 20
PIECE = 1 << 20


class Sentences:
    """Sentences of a column of texts: words are runs of ASCII letters, in lower case, and bytes from 128 on; a full
    stop, an exclamation or question mark or a line feed ends a sentence."""

    def __init__(self):
        self.words = W.Words((31,), lower=True, prefixes=PREFIXES)
        other = np.ones(256, bool)
        other[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
        self.words.space = other
        self.mark = np.zeros(256, bool)
        self.mark[[ord(c) for c in ".!?\n"]] = True

    def read(self, column):
        """Features of each word (a row; 0 is none), number of the first word of each sentence, document of each, and
        their bytes' ends."""
        data, off = W.string_parts(column)
        starts, ends, hashes, first = self.words.hashes(data, off)
        feature = np.empty((len(starts), len(hashes)), np.int32)
        for k, h in enumerate(hashes):
            feature[:, k] = h >> np.uint64(64 - BITS)
        h = starts
        doc = np.repeat(np.arange(len(column)), np.diff(first))
        part = np.searchsorted(np.flatnonzero(self.mark[data]), starts)
        new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(h)) - 1
        return feature, new, doc[new], starts[new], ends[last] if len(h) else new, off, data


    def pieces(self, column):
        """The same for parts of a column that are small enough, with the byte of the text where the part starts: a long
        text, which is alone in its column, is cut behind marks; a sentence is never cut."""
        data, off = W.string_parts(column)
        if len(column) != 1 or len(data) <= PIECE:
            yield 0, self.read(column)
            return
        at = 0
        while at < len(data):
            to = min(at + PIECE, len(data))
            while to < len(data):
                (marks,) = np.nonzero(self.mark[data[to : to + 65536]])
                if len(marks):
                    to += int(marks[0]) + 1
                    break
                to = min(to + 65536, len(data))
            yield at, self.read(pa.array([data[at:to].tobytes()], pa.binary()))
            at = to


def document_counts(batches):
    """How many documents of either label hold each feature; feature -1 stands for any word."""
    reader = Sentences()
    held = np.zeros((2, (1 << BITS) + 1), np.int64)
    for batch in batches:
        for part in W.slices(batch, "text", BLOCK):
            feature, new, doc, *_ = reader.read(part.column(part.schema.get_field_index("text")))
            cut = np.searchsorted(np.repeat(doc, np.diff(np.append(new, len(feature)))), np.arange(part.num_rows + 1))
            for label, a, b in zip(part.column(part.schema.get_field_index("toxic")).to_pylist(), cut[:-1], cut[1:]):
                held[label][np.unique(feature[a:b])] += 1
                held[label][-1] += b > a
    (some,) = np.nonzero(held.sum(0))
    yield pa.record_batch({"feature": pa.array(np.where(some == 1 << BITS, -1, some), pa.int32()), "n0": pa.array(held[0][some]), "n1": pa.array(held[1][some])})


def choose(counts: list[tuple[int, int, int]], least_docs: int = 4, least_z: float = 3.5) -> np.ndarray:
    """The features (sorted) that tell the labels apart, from rows (feature, documents of label 0, of label 1)."""
    held = np.array(sorted(counts), np.int64).reshape(-1, 3)
    if not len(held) or held[0, 0] != -1 or not held[0, 1:].all():
        return np.zeros(0, np.int64)
    n, held = held[0, 1:].astype(float), held[1:]
    p = held[:, 1:].sum(1) / n.sum()
    z = (held[:, 2] / n[1] - held[:, 1] / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n[0] + 1 / n[1]))
    return held[(np.abs(z) >= least_z) & (held[:, 1:].sum(1) >= least_docs) & (held[:, 0] > 0), 0]


def chosen_features(known: np.ndarray):
    """Of each document: its number of sentences, and (sentence, number of a known feature) for each word's features."""

    def run(batches):
        reader, index = Sentences(), np.full(1 << BITS, -1, np.int32)
        index[known] = np.arange(len(known), dtype=np.int32)
        for batch in batches:
            for part in W.slices(batch, "text", BLOCK):
                feature, new, doc, *_ = reader.read(part.column(part.schema.get_field_index("text")))
                lens = np.diff(np.append(new, len(feature)))
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                sentence = np.repeat(np.arange(len(new)) - first[doc], lens)
                word = index[feature]
                row, _ = np.nonzero(word >= 0)
                pairs = np.stack([sentence[row], word[word >= 0]], axis=1).astype(np.int32)
                cut = np.searchsorted(np.repeat(doc, lens)[row], np.arange(part.num_rows + 1))
                yield pa.record_batch(
                    [part.column(part.schema.get_field_index("toxic")), pa.array(np.diff(first).astype(np.int32)), pa.array([pairs[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["toxic", "sentences", "pairs"],
                )

    return run


def fit(bags: list[tuple[int, int, np.ndarray]], known: np.ndarray, share: float, rounds: int = 300, rate: float = 0.08, l2: float = 2e-5) -> np.ndarray:
    """Weights (2**BITS and the bias) from bags (label, number of sentences, rows of sentence and number of a known
    feature); share is that of toxic rows among all that could be learned from, which the sample need not keep."""
    out = np.zeros((1 << BITS) + 1, np.float32)
    out[-1] = -20.0
    bags = [b for b in bags if b[1]]
    y = np.array([b[0] for b in bags], float)
    if not len(bags) or y.min() == y.max():
        return out
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
    n_sentences = np.array([b[1] for b in bags])
    first = np.cumsum(n_sentences) - n_sentences
    bag = np.repeat(np.arange(len(bags)), n_sentences)
    sentence = np.concatenate([b[2][:, 0] + f for b, f in zip(bags, first)])
    word = np.concatenate([b[2][:, 1] for b in bags])
    w, bias = np.zeros(len(known)), -6.0
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for t in range(1, rounds + 1):
        logit = np.bincount(sentence, w[word], len(bag)) + bias
        total = np.add.reduceat(np.logaddexp(0, logit), first)
        miss = np.exp(-total)
        d = weight * ((1 - y) - y * miss / np.maximum(1 - miss, 1e-9))
        dz = d[bag] / (1 + np.exp(-logit))
        g = np.append(np.bincount(word, dz[sentence], len(known)) + l2 * w, dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    out[known], out[-1] = w, bias
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, train_chars: int = 40_000, least_docs: int = 4, least_z: float = 3.5) -> np.ndarray:
    """Weights from documents (doc_id, text) and labels (doc_id, toxic); rows with nulls there are not learned from."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "toxic")
    n = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(5), "doc_id")
    some = [labels.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    text = docs.where((F.length("text") <= train_chars) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    rows = Scratch(docs.sparkSession, "toxicity").save(text.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("toxic", "text"), "sample")
    counts = rows.mapInArrow(document_counts, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    known = choose([tuple(r) for r in counts.where(f"feature = -1 OR n0 + n1 >= {int(least_docs)}").collect()], least_docs, least_z)
    got = rows.mapInArrow(chosen_features(known), "toxic int, sentences int, pairs binary").collect()
    got.sort(key=lambda r: (r["toxic"], r["sentences"], r["pairs"]))  # sums in the same order after any retry
    bags = [(r["toxic"], r["sentences"], np.frombuffer(r["pairs"], np.int32).reshape(-1, 2).astype(np.int64)) for r in got]
    return fit(bags, known, n.get(1, 0) / max(1, sum(n.values())))


def score_partition(model, named: float):
    def score(batches):
        weights, reader = model.value, Sentences()
        for batch in batches:
            for part in W.slices(batch, "text", BLOCK):
                k = part.schema.get_field_index("text")
                total = np.zeros(part.num_rows)
                found: list[list] = [[] for _ in range(part.num_rows)]
                for base, (feature, new, doc, a, b, off, data) in reader.pieces(part.column(k)):
                    z = (np.add.reduceat(weights[feature].sum(1, dtype=np.float64), new) if len(new) else np.zeros(0)) + weights[-1]
                    total += np.bincount(doc, np.logaddexp(0, z), part.num_rows)
                    for i in np.flatnonzero(z >= np.log(named / (1 - named))).tolist():
                        found[doc[i]].append({"start": base + int(a[i] - off[doc[i]]), "sentence": data[a[i] : b[i]].tobytes().decode("utf-8", "replace"), "score": float(1 / (1 + np.exp(-z[i])))})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("sentence", pa.string()), ("score", pa.float64())]))
                rest = [c for n, c in zip(part.schema.names, part.columns) if n != "text"]
                yield pa.record_batch([*rest, pa.array(1 - np.exp(-total)), pa.array(found, kind)], names=[n for n in part.schema.names if n != "text"] + ["score", "offending"])

    return score


def score_toxicity(docs: DataFrame, weights: np.ndarray, named: float = 0.5) -> DataFrame:
    """doc_id, score and offending of each row of docs (doc_id, text; other columns are not read).

    score is the noisy-or over the whole text's sentences, 0 where there is none (null or empty text, or no letter);
    offending lists the sentences that score ``named`` or more: first byte, the words' text, score. Repeated rows and
    null doc_ids come out as they go in; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.select("doc_id", "text").mapInArrow(score_partition(model, named), "doc_id long, score double, offending array<struct<start:long,sentence:string,score:double>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    weights = train(docs, labels.where(part != 0))
    scored = score_toxicity(docs, weights)
    return scored.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
