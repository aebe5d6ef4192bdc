"""Each stage of the corpus pipeline against a plain version over its own input: nulls, empty and long texts, ties,
repeated rows, one doc_id with two texts, an empty table and columns with clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from inkloom.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of_documents():
    r = random.Random(11)
    tongues = {"en": ["the", "ing", "wh", "and", "ly"], "fr": ["é", "eau", "oi", "que", "ç"], "de": ["sch", "ung", "ß", "ü", "keit"]}
    rows = []

    def text(lang, n):
        s = tongues[lang]
        return "\n".join(" ".join("".join(r.choice(s) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 12))) for _ in range(n))

    for i in range(150):
        lang = r.choice(list(tongues))
        t = text(lang, r.randint(2, 9))
        rows.append((i, t, lang if i % 7 else None, f"src{i % 4}" if i % 5 else None, len(t)))
    license_lines = text("en", 4)
    for i in range(150, 170):
        t = f"{text('en', 2)}\n{license_lines}\n{text('en', 2)}"
        rows.append((i, t, "en", "src0", len(t)))
    for i in range(170, 185):  # near copies of one line
        w = rows[3][1].replace("\n", " ").split(" ") + text("en", 8).replace("\n", " ").split(" ")[:0]
        w[i % len(w)] = f"the{'ly' * (i % 5)}"
        rows.append((i, " ".join(w), rows[3][2], "src1", 1))
    long = text("de", 900)
    rows += [(190 + i, text("de", 500), "de", "src2", 1) for i in range(6)]  # of several pieces each, and some are in the mix
    rows += [(185, long, "de", "src2", len(long)), (186, None, "en", "src2", 0), (187, "", "en", "src2", 0), (188, " \n\t ", None, "src3", 4), (189, "12 34 !", None, "src3", 7)]
    rows += [rows[5], rows[5], (7, rows[9][1], "en", "src1", 3), (None, rows[11][1], "en", "src1", 3), (None, "the and only ling", "en", None, 3)]
    return rows


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.createDataFrame(rows_of_documents(), DOCS).withColumn("comp", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("places", F.lit(3)).withColumn("id", F.lit(4)).withColumn("rate", F.lit(5)).repartition(3)
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(stage(spark, out[-1], "").cache())
    return [[r.asDict() for r in df.collect()] for df in out]


def test_stages_are_as_declared():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mix_sources", "best_fit"]


def test_columns(steps):
    for rows in steps[1:5]:
        assert list(rows[0]) == cp.COLUMNS


def test_language_id_rejects_texts_without_a_language(steps):
    before, after = steps[0], steps[1]
    kept = Counter((r["doc_id"], r["text"], r["source"]) for r in after)
    for r in before:
        if not any(ch.isalpha() for ch in r["text"] or ""):
            assert (r["doc_id"], r["text"], r["source"]) not in kept
    assert kept == Counter((r["doc_id"], r["text"], r["source"]) for r in before if any(ch.isalpha() for ch in r["text"] or ""))
    truth = {r["doc_id"]: r["lang"] for r in before if r["lang"] and r["doc_id"] is not None and r["doc_id"] < 170 and r["doc_id"] != 7}
    assert np.mean([truth[r["doc_id"]] == r["lang"] for r in after if r["doc_id"] in truth]) > 0.95


def test_line_dedup_stage(steps):
    before, after = steps[1], steps[2]
    rows = {(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None}
    where = defaultdict(set)
    for i, t in rows:
        ls = t.split("\n")
        for j in range(len(ls) - 2):
            where[tuple(ls[j : j + 3])].add((i, t, j))
    got = {}
    for r in after:
        got.setdefault(r["doc_id"], set()).add(r["text"])
    for i, t in rows:
        if sum(k == i for k, _ in rows) > 1:
            continue  # the order of two texts of one doc_id is by a hash
        ls = t.split("\n")
        gone = {j + k for j in range(len(ls) - 2) for k in range(3) if any((p, q) < (i, j) for p, _, q in where[tuple(ls[j : j + 3])])}
        left = "\n".join(x for j, x in enumerate(ls) if j not in gone)
        assert (left in got.get(i, ())) == bool(words_of(left)), i
    assert all(r["n_chars"] == len(r["text"]) and words_of(r["text"]) for r in after)
    assert Counter(r["text"] for r in after if r["doc_id"] is None) == Counter(r["text"] for r in before if r["doc_id"] is None)


def test_near_duplicates_stage(steps):
    before, after = steps[2], steps[3]

    def grams(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words_of(t)]
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    rows = sorted({(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None})
    sets, least = [grams(t) for _, t in rows], {i: i for i, _ in rows}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 7 * len(sets[a] & sets[b]) >= 3 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                least[y] = x
    assert Counter(r["doc_id"] for r in after if r["doc_id"] is not None) == Counter({i for i in least if find(i) == i})
    assert {(r["doc_id"], r["text"]) for r in after if r["doc_id"] is not None} <= set(rows)
    assert Counter(r["text"] for r in after if r["doc_id"] is None) == Counter(r["text"] for r in before if r["doc_id"] is None)


def test_mixing_stage(steps):
    before, after = steps[3], steps[4]
    size = Counter()
    for r in before:
        size[r["source"]] += len(r["text"])
    weight = {s: mixing.WEIGHTS.get(s or "", 1.0) if n else 0.0 for s, n in size.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(size.values()) / n for s, n in size.items() if n}
    expected = Counter()
    for r in before:
        key = str(r["doc_id"]) if r["doc_id"] is not None else "#" + hashlib.md5(r["text"].encode()).hexdigest()
        u, lam, k = int(hashlib.md5(f"17|{key}".encode()).hexdigest()[:13], 16) / 16**13, rate[r["source"]], 0
        p = c = np.exp(-lam)
        while c <= u:
            k += 1
            p *= lam / k
            c += p
        expected[r["doc_id"], r["text"]] += k
    assert Counter((r["doc_id"], r["text"]) for r in after) == +expected


def test_packing_stage(steps):
    before, after = steps[4], steps[5]
    wanted, got = Counter(), Counter()
    for r in before:
        for w in words_of(r["text"]):
            wanted[r["doc_id"], w] += 1
    bins = defaultdict(list)
    pieces = defaultdict(dict)
    for r in after:
        assert len(words_of(r["text"])) == r["words"] <= cp.CAPACITY
        for w in words_of(r["text"]):
            got[r["doc_id"], w] += 1
        bins[r["shard"], r["bin"]].append(r)
        pieces[r["doc_id"], r["copy"]][r["start"]] = r
    assert wanted == got
    for held in bins.values():
        held.sort(key=lambda r: r["slot"])
        assert sum(r["words"] for r in held) <= cp.CAPACITY and len({r["source"] for r in held}) == len(held)
        assert [r["offset"] for r in held] == [sum(q["words"] for q in held[:k]) for k in range(len(held))]
    longest = max(before, key=lambda r: len(r["text"]))
    mine = [p for (i, _), p in pieces.items() if i == longest["doc_id"]]
    assert mine and all(words_of(" ".join(p[s]["text"] for s in sorted(p))) == words_of(longest["text"]) for p in mine) and len(mine[0]) > 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
