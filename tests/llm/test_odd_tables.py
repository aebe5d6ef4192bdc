"""Columns whose names the operators use themselves, scores too large for a long or a double, and very long texts."""

import random
import resource

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkloom.llm import ann, langid, lines, mixing, names, repeats, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["rate", "size", "parts", "cdf", "_source", "_u", "_n", "_run", "_l", "_key", "_gone", "_lines", "__key", "key", "at", "tkey", "_cuts", "ha", "salt", "copy_no_", "slice", "tokens", "n", "a", "b"]


def with_clashes(docs):
    return docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz")
    passage = "\n".join(" ".join(word() for _ in range(15)) for _ in range(5))
    rows = [(i, "\n".join([" ".join(word() for _ in range(12)), passage if i % 3 else "", f"end {i}"]), "en", f"s{i % 2}", 1) for i in range(40)]
    return with_clashes(spark.createDataFrame(rows, DOCS))


def check_kept(out, docs):
    assert set(docs.columns) <= set(out.columns)
    kept = out.select("doc_id", *CLASHES).distinct().collect()
    assert kept and all(r[c] == f"{c}{r['doc_id']}" for r in kept for c in CLASHES)


def test_names_are_fresh():
    assert names.fresh(["a", "b"], "x") == ["_x"]
    assert names.fresh(["_A", "__b"], "x", "y") == ["___x", "___y"]


def test_mixing_keeps_columns(docs):
    check_kept(mixing.mix_sources(docs), docs)


def test_line_dedup_keeps_columns(docs):
    out = lines.remove_repeated_lines(docs)
    check_kept(out, docs)
    assert out.agg(F.sum("n_removed")).first()[0] > 100
    plain = lines.remove_repeated_lines(docs.select("doc_id", "text"))
    assert {tuple(r) for r in out.select("doc_id", "text").collect()} == {tuple(r) for r in plain.select("doc_id", "text").collect()}


def test_substring_dedup_keeps_columns(docs):
    out = repeats.remove_repeats(docs, sketch_bits=20)
    check_kept(out, docs)
    assert out.agg(F.sum("n_removed")).first()[0] > 100


def test_language_id_keeps_columns(docs):
    check_kept(langid.identify(docs, langid.train(docs)), docs)


@pytest.mark.parametrize("component", [2.0**30, 2.0**24])
def test_exact_top_k_of_scores_beyond_a_long_is_an_error(spark, component):
    df = spark.createDataFrame([(i, [component + i]) for i in range(25)], "vec_id long, embedding array<double>")
    if component == 2.0**30:
        with pytest.raises(Exception, match="too large"):
            topk.exact_top_k(df, df.where("vec_id % 20 = 0")).collect()
    else:
        got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.exact_top_k(df, df.where("vec_id % 20 = 0")).collect()}
        assert got[0, 24] == (64 * 2**24) * (64 * (2**24 + 24)) and len(got) == 40


def test_top_k_blocks_and_queries_meet_once_each(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(300, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    wide = {tuple(r) for r in topk.exact_top_k(df, df.where("vec_id % 20 = 0")).collect()}
    monkeypatch.setattr(topk, "BROADCAST", 0)
    monkeypatch.setattr(topk, "DEALS", 5)
    assert {tuple(r) for r in topk.exact_top_k(df, df.where("vec_id % 20 = 0"), rows_block=16, query_block=4).collect()} == wide and len(wide) == 300


def test_nearest_of_inner_products_beyond_a_double_is_an_error(spark):
    df = spark.createDataFrame([(i, [1e300, float(i + 1)]) for i in range(25)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit a double"):
        ann.nearest(df, df.where("vec_id % 20 = 0")).collect()


def test_recall_on_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    found = {(r["query_id"], r["vec_id"]) for r in ann.op2_cross_polytope(spark, sf).select("query_id", "vec_id").collect()}
    rows = vectors.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    wanted = set()
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[ids == ids[q]] = -np.inf
        wanted |= {(int(ids[q]), int(ids[i])) for i in np.lexsort((ids, -score))[:20]}
    assert len(found & wanted) >= 0.9 * len(wanted)


def grown(f):
    """Megabytes that the process's peak grows by in f; only a new peak shows."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    f()
    return (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024


def test_long_texts_are_read_in_pieces(monkeypatch):
    r = random.Random(2)
    text = "".join(r.choice("abcdé ß. \n") for _ in range(200_000)) * 130
    column = pa.record_batch({"text": pa.array([text])}).column(0)
    data, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    assert len(data) > 30e6
    assert grown(lambda: (langid.Presence().rows(data, off), langid.has_letter(data, off))) < 300
    weights = np.zeros((1 << toxicity.BITS) + 1, np.float32)
    weights[-1] = -5
    assert grown(lambda: [weights[f].sum() for _, (f, *_) in toxicity.Sentences().pieces(column)]) < 300
    few, p = data[:5000], langid.Presence()
    cuts = np.array([0, 1000, 1000, 1003, len(few)])
    whole = p.rows(few, cuts)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (p.rows(few, cuts) == whole).all()


def test_long_text_scores_as_its_sentences(spark, monkeypatch):
    r = random.Random(3)
    text = ". ".join(" ".join(r.choice(["tree", "river", "Grumble", "stone"]) for _ in range(r.randint(1, 9))) for _ in range(300)) + " no mark at the end"
    docs = spark.createDataFrame([(1, text), (2, text[:50])], "doc_id long, text string")
    weights = np.random.default_rng(4).normal(size=(1 << toxicity.BITS) + 1).astype(np.float32) * 0.3
    weights[-1] = -2
    batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "text": text}])
    run = toxicity.score_partition(type("Held", (), {"value": weights})(), 0.01)
    (one,) = run([batch])
    monkeypatch.setattr(toxicity, "PIECE", 100)
    (two,) = run([batch])
    assert one.column("offending").to_pylist() == two.column("offending").to_pylist() and len(one.column("offending")[0]) > 20
    assert abs(one.column("score")[0].as_py() - two.column("score")[0].as_py()) < 1e-9
    assert docs.count() == 2


def brute_noisy_or(text, weights):
    """Score of a text, sentence by sentence and word by word."""
    import re

    reader = toxicity.Sentences()
    miss = 1.0
    for sentence in re.split(r"[.!?\n]", text):
        words = re.findall(r"[A-Za-z\x80-\U0010ffff]+", sentence)
        if words:
            z = float(weights[-1])
            for w in words:
                (feature, *_) = reader.read(pa.array([w]))
                z += float(sum(weights[f] for f in feature[0]))
            miss *= 1 - 1 / (1 + np.exp(-z))
    return 1 - miss


def test_noisy_or_of_sentences(spark):
    r = random.Random(6)
    texts = [". ".join(" ".join(r.choice(["tree", "Überfluss", "Grumbleton", "stone", "x1y"]) for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 8))) for _ in range(40)]
    texts += ["", "12 .. !", "one\ntwo?three"]
    weights = np.random.default_rng(7).normal(size=(1 << toxicity.BITS) + 1).astype(np.float32)
    weights[0], weights[-1] = 0, -2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in toxicity.score_toxicity(docs, weights).collect()}
    assert all(abs(got[i] - brute_noisy_or(t, weights)) < 1e-6 for i, t in enumerate(texts))


def test_fit_follows_the_gradient_of_the_noisy_or():
    """The weights that fit finds have no less likelihood than weights near them."""
    r = np.random.default_rng(8)
    bags = []
    for i in range(80):
        n = int(r.integers(1, 5))
        pairs = np.array([(s, f) for s in range(n) for f in range(3) if r.random() < (0.7 if f == i % 2 else 0.2)], np.int64).reshape(-1, 2)
        bags.append((i % 2, n, pairs))
    out = toxicity.fit(bags, np.array([5, 6, 7]), 0.5, rounds=3000, rate=0.02)

    def loss(w, bias):
        total = 0.0
        for y, n, pairs in bags:
            z = np.full(n, bias)
            np.add.at(z, pairs[:, 0], w[pairs[:, 1]])
            log_miss = -np.logaddexp(0, z).sum()
            total -= np.log(1 - np.exp(log_miss)) if y else log_miss
        return total / len(bags) + 1e-5 * (w**2).sum()

    w, bias = out[[5, 6, 7]].astype(float), float(out[-1])
    best = loss(w, bias)
    for k in range(3):
        for step in (-0.3, 0.3):
            assert loss(w + step * np.eye(3)[k], bias) > best
    assert loss(w, bias + 0.3) > best and loss(w, bias - 0.3) > best


def test_language_model_is_kernel_ridge_on_nystrom_features():
    """The classifiers are those of ridge regression in the landmarks' space, solved here in the plain way."""
    r = np.random.default_rng(9)
    langs = [["de", "en", "fr"][i % 3] for i in range(60)]
    x = np.stack([r.random(400) < np.where(np.arange(400) // 130 == i % 3, 0.3, 0.05) for i in range(60)])
    ridge = 1e-2
    model = langid.fit(x, langs, landmarks=12, ridge=ridge)
    sets = [set(np.flatnonzero(v)) for v in x]
    kernel = lambda a, b: len(a & b) / max(1.0, np.sqrt(len(a)) * np.sqrt(len(b)))
    marks = [sets[i] for i in range(12)]  # the first of each language in turn
    k = np.array([[kernel(s, m) for m in marks] for s in sets])
    value, vector = np.linalg.eigh(k[:12])
    z = k @ (vector / np.sqrt(value))
    for c, name in enumerate(model.langs):
        t = np.array([1.0 if v == name else -1.0 for v in langs])
        zz = np.hstack([z, np.ones((60, 1))])
        penalty = np.diag([ridge] * 12 + [0.0])
        beta = np.linalg.solve(zz.T @ zz / 60 + penalty, zz.T @ t / 60)
        assert np.allclose(model.outputs(x)[:, c], zz @ beta, atol=1e-3)


def test_rare_languages_and_long_texts_are_learned(spark):
    rows = [(i, "the tree and the river walk " * 3, "en", "s", 0) for i in range(400)] + [(1000 + i, "ø æ å hygge rød " * 3000, "da", "s", 0) for i in range(3)]
    model = langid.train(spark.createDataFrame(rows, DOCS), train_rows=50)
    assert model.langs == ["da", "en"]


def test_revisits_are_the_same_without_a_broadcast(spark, tmp_path, monkeypatch):
    rows = [(i, f"u{i}", "x" * 1200 if i % 3 else f"{i}" * 700) for i in range(60)] + [(None, "u", "x" * 1200), (None, "u", "y" * 1500), (5, "u", "x" * 1200), (58, "u", "x" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for k, most in enumerate((500_000, 0)):
        monkeypatch.setattr(warc, "DUP_BROADCAST", most)
        warc.write_warc(pages, f"file://{tmp_path}/a{k}")
    one, two = (sorted(map(repr, warc.read_warc(spark, f"file://{tmp_path}/a{k}").collect())) for k in range(2))
    assert one == two and sum("revisit" in r for r in one) > 35
