"""Operator 7, language identification with string kernels.

Kernel: blended-spectrum presence, the number of n-grams of 1 to 4 bytes that two texts share, over the root of their
own numbers; n-grams are hashed to ``2**BITS`` cells. Nyström: texts are compared with a few landmarks, and a ridge
regression in the landmarks' space is fitted for each language against the rest. A batch of texts is scored by two
matrix products: presence by landmarks, and the kernel values by the classifiers.

Fitting takes a bounded sample of labelled rows (``train_rows`` in all and ``least_rows`` of each language at least, of
which ``train_chars`` characters are learned from); every text is scored in whole, in pieces of bounded size.
"""

from __future__ import annotations

import codecs
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.llm import words as W
from inkloom.session import Scratch

BITS = 14
ORDERS = 4
BLOCK = 1 << 20
ROWS = 64
FIT_ROWS = 256
PIECE = 1 << 18
BROADCAST_LANGS = 10_000


class Presence:
    """Which hashed n-grams texts hold. ASCII letters count in lower case, all else in ASCII as one space."""

    def __init__(self):
        t = np.full(256, 32, np.uint64)
        t[128:] = np.arange(128, 256)
        t[97:123] = np.arange(97, 123)
        t[65:91] = np.arange(97, 123)
        self.table = t

    def rows(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        x = np.zeros((len(off) - 1, 1 << BITS), bool)
        if not len(data):
            return x
        for at in range(0, len(data), PIECE):  # pieces overlap by as much as an n-gram may reach into the next
            to = min(len(data), at + PIECE + ORDERS - 1)
            self._piece(x.reshape(-1), self.table[data[at:to]], np.searchsorted(off, np.arange(at, to), "right") - 1)
        return x

    def _piece(self, flat: np.ndarray, c: np.ndarray, row: np.ndarray) -> None:
        code = np.zeros(len(c), np.uint64)
        for n in range(1, ORDERS + 1):
            m = len(c) - n + 1
            if m <= 0:
                break
            code = code[:m] * np.uint64(257) + c[n - 1 :]
            cell = ((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            whole = row[:m] == row[n - 1 :]
            flat[((row[:m] << BITS) + cell.astype(np.int64))[whole]] = True


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    return np.array([_letter(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], bool)


def _letter(text: np.ndarray) -> bool:
    read = codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(text), PIECE):
        part = text[at : at + PIECE]
        low = part[:256] | 32
        if ((low >= 97) & (low <= 122)).any():  # as nearly always
            return True
        low = part | 32
        if ((low >= 97) & (low <= 122)).any() or any(map(str.isalpha, read.decode(part.tobytes()))):
            return True
    return False


def batches_of(data: np.ndarray, off: np.ndarray):
    """Rows a to b of a block at a time: ROWS at most."""
    for a in range(0, len(off) - 1, ROWS):
        b = min(a + ROWS, len(off) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # cells by landmarks
    sizes: np.ndarray  # root of each landmark's number of n-grams
    classifiers: np.ndarray  # landmarks by languages
    offset: np.ndarray

    def kernel(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        return (x @ self.landmarks) / np.maximum(np.sqrt(x.sum(1))[:, None] * self.sizes, 1)

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.classifiers + self.offset


def fit(x: np.ndarray, langs: list[str], landmarks: int = 128, ridge: float = 1e-3) -> Model | None:
    """Model from presence rows, Boolean or packed to bits, and their languages; the first rows of each language in
    turn are the landmarks. Rows are unpacked and widened FIT_ROWS at a time."""
    names = sorted(set(langs))
    if not names:
        return None
    y = np.array([names.index(v) for v in langs])
    turn = np.zeros(len(y), int)
    for c in range(len(names)):
        turn[y == c] = np.arange((y == c).sum())
    pick = np.lexsort((y, turn))[:landmarks]
    plain = (lambda part: part) if x.dtype == bool else (lambda part: np.unpackbits(part, axis=1).view(bool))
    marks = plain(x[pick])
    model = Model(names, marks.T.astype(np.float32), np.sqrt(marks.sum(1)).astype(np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    k = np.concatenate([model.kernel(plain(x[at : at + FIT_ROWS])) for at in range(0, len(x), FIT_ROWS)]).astype(float)
    value, vector = np.linalg.eigh(k[pick])
    good = value > 1e-6 * value.max()
    project = vector[:, good] / np.sqrt(value[good])
    z = k @ project
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    # each language weighs the same, so that a rare one isn't taken for the frequent
    weight = (1 / np.bincount(y, minlength=len(names)))[y] / len(names)
    mean_z, mean_t = weight @ z, weight @ target
    zc = z - mean_z
    beta = np.linalg.solve((zc * weight[:, None]).T @ zc + ridge * np.eye(z.shape[1]), (zc * weight[:, None]).T @ (target - mean_t))
    model.classifiers = (project @ beta).astype(np.float32)
    model.offset = (mean_t - mean_z @ beta).astype(np.float32)
    return model


def presence_bits(batches):
    seen = Presence()
    for batch in batches:
        for part in W.slices(batch, "text", BLOCK):
            data, off = W.string_parts(part.column(part.schema.get_field_index("text")))
            good, bits = has_letter(data, off), []
            for _, _, d, o in batches_of(data, off):
                bits += [r.tobytes() for r in np.packbits(seen.rows(d, o), axis=1)]
            yield pa.record_batch([part.column(part.schema.get_field_index("lang")), pa.array(bits, pa.binary()), pa.array(good)], names=["lang", "bits", "good"])


def train(docs: DataFrame, train_rows: int = 3000, train_chars: int = 20_000, landmarks: int = 128, least_rows: int = 20) -> Model | None:
    """Model from docs (doc_id, text, lang); rows with nulls there are not learned from, None where none is left. Each
    language has an equal share of ``train_rows``, ``least_rows`` at least, so a rare one is learned as well; of a
    language with fewer rows all are taken, and the rest of its share goes to nobody."""
    rows = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = Scratch(docs.sparkSession, "languages").save(rows.groupBy("lang").agg(F.count("*").alias("n")), "counts")
    n_langs = counts.count()
    counts = F.broadcast(counts) if n_langs <= BROADCAST_LANGS else counts
    share = max(least_rows, train_rows // max(1, n_langs))
    order = F.xxhash64(F.lit(7), "doc_id")
    # by hash about twice the rows wanted of each language, so that no task ranks all rows of one
    some = rows.join(counts, "lang").where(F.pmod(order, F.lit(1 << 20)) * F.col("n") < F.lit(2 * share * (1 << 20)))
    some = some.select("lang", "doc_id", F.substring("text", 1, train_chars).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", F.xxhash64("text")))
    some = some.withColumn("rank", rank).where(F.col("rank") <= share).select("text", "lang")
    got = [r for r in some.mapInArrow(presence_bits, "lang string, bits binary, good boolean").collect() if r["good"]]
    got.sort(key=lambda r: (r["lang"], r["bits"]))
    if not got:
        return None
    x = np.stack([np.frombuffer(r["bits"], np.uint8) for r in got])
    order = np.random.default_rng(7).permutation(len(got))
    return fit(x[order], [got[i]["lang"] for i in order], landmarks)


def predict_partition(model):
    def predict(batches):
        m, seen = model.value, Presence()
        for batch in batches:
            for part in W.slices(batch, "text", BLOCK):
                data, off = W.string_parts(part.column(part.schema.get_field_index("text")))
                good, lang, score = has_letter(data, off), [], []
                for a, b, d, o in batches_of(data, off):
                    if m is None:
                        lang += ["und"] * (b - a)
                        score += [0.0] * (b - a)
                        continue
                    f = m.outputs(seen.rows(d, o)).astype(float)
                    p = np.exp(4 * (f - f.max(1, keepdims=True)))
                    best = f.argmax(1)
                    p = p[np.arange(b - a), best] / p.sum(1)
                    lang += [m.langs[c] if g else "und" for c, g in zip(best, good[a:b])]
                    score += np.where(good[a:b], p, 0.0).tolist()
                rest = [c for n, c in zip(part.schema.names, part.columns) if n not in ("lang_pred", "lang_score")]
                names = [n for n in part.schema.names if n not in ("lang_pred", "lang_score")]
                yield pa.record_batch([*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "lang_score"])

    return predict


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (with text) and lang_pred and lang_score, which replace columns of these names.

    lang_pred is a learned language, or ``und`` with score 0 where the text is null or has no letter of any script, or
    nothing could be learned; lang_score, 0 to 1, is the softmax of the classifiers' outputs. Rows come out as often as
    they go in; an empty table gives an empty one.
    """
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [f for f in docs.schema.fields if f.name not in ("lang_pred", "lang_score")]
    schema = T.StructType([*own, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.mapInArrow(predict_partition(shared), schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    model = train(docs.where(part != 2))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
