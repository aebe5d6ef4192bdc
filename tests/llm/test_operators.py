"""Each operator against a brute-force version, on small rows with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.llm import ann, components, jaccard, langid, lines, mixing, packing, repeats, topk, toxicity, warc, words
from inkloom.session import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """rows of (doc_id, text)."""
    return spark.createDataFrame([(i, t, None, None if i is None else f"s{i % 3}", len(t or "")) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    long = " ".join(r.choice(vocabulary) for _ in range(6000))
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(20, 160))) for _ in range(60)]
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    rows = list(enumerate(base))
    for i in range(60, 110):
        w = r.choice(base).split(" ")
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, r.choice([" ", "  ", "\t"]).join(w)))
    for i in range(110, 130):
        rows.append((i, f"{r.choice(base)} {passage} {r.choice(base)}"))
    for i in range(130, 160):  # one group of near copies
        w = base[0].split(" ")
        w[r.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w).upper() if i % 2 else " ".join(w)))
    rows += [(160, None), (161, ""), (162, " \n\t "), (163, "one"), (164, "ONE"), (165, "one two three four"), (166, long), (167, long + " end"), (168, "a b c d e"), (None, base[1]), (5, base[5])]
    return rows


def word_list(text, lower=False):
    t = text or ""
    if lower:
        t = t.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_word_hashes_match_words():
    words.BLOCK, before = 64, words.BLOCK
    try:
        r = random.Random(1)
        texts = [None, "", " ", "a", "x" * 500, " lead", "é ü"] + ["".join(r.choice("abc \n\té") for _ in range(r.randint(0, 300))) for _ in range(100)]
        import pyarrow as pa

        data, off = words.string_parts(pa.array(texts))
        start, end, (h,), first = words.Words().hashes(data, off)
        seen = {}
        for i, t in enumerate(texts):
            got = [data[start[k] : end[k]].tobytes() for k in range(first[i], first[i + 1])]
            assert got == (t or "").encode().split()
            for k, w in zip(range(first[i], first[i + 1]), got):
                assert seen.setdefault(w, h[k]) == h[k]
        assert len(set(seen.values())) == len(seen)
    finally:
        words.BLOCK = before


def brute_components(rows, k=5):
    sets = {}
    for i, t in rows:
        w = word_list(t, True)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("bands", [8, 1])
def test_jaccard_join(spark, texts, bands):
    got = jaccard.ngram_components(docs_of(spark, texts).withColumn("tokens", F.lit(1)).withColumn("n", F.lit(1)), bands=bands, group_rows=4, block=4000).collect()
    expected = brute_components([r for r in texts if r[0] is not None])
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (expected[r["doc_id"]] if r["doc_id"] is not None else (expected[1][0], None))
    assert sum(v[1] == 0 for v in expected.values()) > 10


def test_jaccard_threshold_is_exact(spark):
    w = [f"w{i}" for i in range(200)]
    a = " ".join(w[:16])  # 12 shingles
    rows = [(1, a), (2, " ".join(w[:20])), (3, " ".join(w[:13])), (4, " ".join(w[:12]))]  # 12 of 16, 9 of 12, 8 of 12
    got = {r["doc_id"]: r["component_id"] for r in jaccard.ngram_components(docs_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1} and {k: v[1] for k, v in brute_components(rows).items()} == got
    assert jaccard.ngram_components(docs_of(spark, [(1, a), (4, " ".join(w[:12]))])).where("component_id <> doc_id").count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def brute_repeats(rows, width):
    first = {}
    for i, t in rows:
        w = word_list(t)
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = word_list(t), set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("width,block", [(50, 8 << 20), (8, 3000)])
def test_substring_dedup(spark, texts, width, block):
    docs = docs_of(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("at", F.lit("clash"))
    got = repeats.remove_repeats(docs, width=width, sketch_bits=20, block=block)
    assert got.columns[:2] == ["doc_id", "lang"] and "at" in got.columns
    rows = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.where("doc_id IS NOT NULL").collect())
    expected = sorted(brute_repeats([r for r in texts if r[0] is not None], width))
    assert rows == expected and sum(r[2] > 0 for r in rows) > 20
    (lone,) = got.where("doc_id IS NULL").collect()
    assert lone["n_removed"] == 0 and lone["n_words"] == len(word_list(texts[1][1]))


def test_sketch_overestimates_but_loses_none(spark, texts):
    few = {tuple(r) for r in repeats.remove_repeats(docs_of(spark, texts), width=8, sketch_bits=20).select("doc_id", "n_removed").collect()}
    import inkloom.llm.repeats as module

    before, module.SLICE = module.SLICE, 6  # a sketch of 64 cells is full
    try:
        assert {tuple(r) for r in repeats.remove_repeats(docs_of(spark, texts), width=8, sketch_bits=6).select("doc_id", "n_removed").collect()} == few
    finally:
        module.SLICE = before


def test_line_dedup(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice("abcde") for _ in range(r.randint(0, 9)))) for i in range(60)] + [(100, None), (101, ""), (102, "x"), (103, "x\ny\nz"), (104, "q\nx\ny\nz\nw\n"), (105, "m\nm\nm\nm"), (None, "x\ny\nz")]
    got = {r["doc_id"]: r for r in lines.remove_repeated_lines(docs_of(spark, rows).withColumn("at", F.lit(1)).withColumn("l", F.lit(1))).collect()}
    first = {}
    for i, t in sorted((x for x in rows if x[0] is not None and x[1] is not None)):
        ls = t.split("\n")
        for j in range(len(ls) - 2):
            first.setdefault(tuple(ls[j : j + 3]), (i, j))
    for i, t in rows:
        ls = t.split("\n") if t is not None else []
        gone = {j + k for j in range(len(ls) - 2) for k in range(3) if i is not None and first[tuple(ls[j : j + 3])] != (i, j)}
        assert got[i]["n_lines"] == len(ls) and got[i]["n_removed"] == len(gone)
        assert got[i]["text"] == ("\n".join(x for j, x in enumerate(ls) if j not in gone) if t is not None else None)
    assert got[104]["text"] == "q\nw\n" and got[105]["text"] == "m"
    twice = lines.remove_repeated_lines(docs_of(spark, [(1, "a\nb\nc"), (1, "a\nb\nc")])).agg(F.sum("n_removed")).first()[0]
    assert twice == 0


def test_mixing(spark):
    rows = [(i, "x" * (1 + i % 7), None, f"s{i % 4}" if i % 5 else None, 0) for i in range(4000)] + [(9999, None, None, "empty", 0), (None, "abc", None, "s0", 0), (3, "xxxx", None, "s3", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("copy_no", F.lit("clash"))
    out = mixing.mix_sources(docs, {"s0": 3.0, "s1": 0.5}).cache()
    size = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = docs.agg(F.sum(F.length("text"))).first()[0]
    share = {"s0": 3, "s1": 0.5, "s2": 1, "s3": 1, None: 1}
    for s, w in share.items():
        assert abs(size[s] / total - w / 6.5) < 0.02
    assert "empty" not in size
    # the count is the inverse of the distribution function at the row's number
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs, {"s0": 3.0, "s1": 0.5}).collect()}
    counts = Counter(r["doc_id"] for r in out.where("doc_id IS NOT NULL AND doc_id <> 3").select("doc_id").collect())
    for i, _, _, s, _ in rows[:300]:
        u, p, k = int(hashlib.md5(f"17|{i}".encode()).hexdigest()[:13], 16) / 16**13, np.exp(-rate[s]), 0
        c = p
        while c <= u:
            k += 1
            p *= rate[s] / k
            c += p
        assert counts[i] == k or i == 3
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") + ["copy_no"]
    again = mixing.mix_sources(docs, {"s0": 3.0, "s1": 0.5}).select("doc_id", "copy_no").collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["copy_no"]) for r in out.collect())


def brute_fit(items, capacity, by_source):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["left"], n) for n, b in enumerate(bins) if b["left"] >= size and b["left"] > 0 and cluster not in b["c"] and not (by_source and source in b["s"])]
        n = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[n]["left"] -= size
        bins[n]["s"].add(source)
        bins[n]["c"].add(cluster)
        out.append(n)
    return out


@pytest.mark.parametrize("by_source", [True, False])
def test_best_fit_is_the_tightest_compatible_bin(by_source):
    r = random.Random(9)
    for _ in range(30):
        items = sorted(((r.randint(1, 50), r.choice("aaabcd"), r.randint(0, 15)) for _ in range(120)), reverse=True)
        assert packing.best_fit(items, 60, by_source) == brute_fit(items, 60, by_source)


def test_packing_places_every_word_once(spark, texts):
    rows = texts + [(200, "same words"), (200, "same words"), (201, "Same  WORDS")]
    placed = packing.pack(docs_of(spark, rows).withColumn("cluster", F.lit(1)), capacity=64, shard_docs=50).collect()
    held, seen = defaultdict(list), Counter()
    for p in placed:
        held[p["shard"], p["bin"]].append(p)
        seen[p["doc_id"]] += p["words"]
    wanted = Counter()
    for i, t in rows:
        wanted[i] += len(word_list(t))
    assert seen == +wanted
    source = lambda i: None if i is None else i % 3
    for pieces in held.values():
        pieces.sort(key=lambda p: p["slot"])
        assert sum(p["words"] for p in pieces) <= 64
        assert [p["offset"] for p in pieces] == [sum(q["words"] for q in pieces[:k]) for k in range(len(pieces))]
        assert len({source(p["doc_id"]) for p in pieces}) == len(pieces)
    assert len([p for p in placed if p["doc_id"] in (200, 201)]) == 3


def test_toxicity_learns_words_from_document_labels(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        sentences = [" ".join(r.choice(["tree", "river", "stone", "cloud", "green", "walks", "sings"]) for _ in range(r.randint(3, 9))) for _ in range(r.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            k = r.randrange(len(sentences))
            sentences[k] += " " + r.choice(["Grumbleton", "snarkface"])
        rows.append((i, ". ".join(sentences) + "!"))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "123 ..."), (None, "you snarkface. fine tree")]
    docs = docs_of(spark, rows).withColumn("score", F.lit("clash"))
    learned = spark.createDataFrame([x for x in labels if x[0] % 5] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, toxicity.train(docs, learned)).collect()}
    assert all((got[i]["score"] >= 0.5) == bool(y) for i, y in labels if i % 5 == 0)
    assert [s["sentence"] for s in got[None]["offending"]] == ["you snarkface"]
    assert [got[i]["score"] for i in (2000, 2001, 2002)] == [0, 0, 0]
    none = toxicity.train(docs, learned.limit(0))
    assert toxicity.score_toxicity(docs, none).agg(F.max("score")).first()[0] < 0.01


def test_language_id(spark):
    r = random.Random(4)
    syllables = {"en": ["the", "ing", "wh", "and", "ly"], "fr": ["é", "eau", "oi", "que", "ç"], "de": ["sch", "ung", "ß", "ü", "keit"]}
    rows = []
    for i in range(600):
        lang = r.choice(list(syllables))
        rows.append((i, " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(4, 60))), lang, "s", 0))
    train = spark.createDataFrame(rows[:400] + [(900, "abc", None, "s", 0), (901, None, "en", "s", 0), (902, "...", "xx", "s", 0)], DOCS)
    model = langid.train(train)
    assert model.langs == ["de", "en", "fr"]
    test = spark.createDataFrame(rows[400:] + [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "12 .\n!", "en", "s", 0)], DOCS).withColumn("lang_pred", F.lit(1))
    got = langid.identify(test, model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] < 1000)
    assert all(r["lang_pred"] == "und" and r["lang_score"] == 0 for r in got if r["doc_id"] >= 1000)
    assert {r["lang_pred"] for r in langid.identify(test, None).collect()} == {"und"}


def test_presence_kernel_matches_sets():
    texts = ["Ab c", "", "é ab", "cab cab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    x = langid.Presence().rows(data, off).astype(int)
    grams = []
    for t in texts:
        b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in t.encode())
        grams.append({b[i : i + n] for n in range(1, 5) for i in range(len(b) - n + 1)})
    assert (x @ x.T).tolist() == [[len(a & b) for b in grams] for a in grams]


def test_warc_round_trip(spark, tmp_path):
    r = random.Random(6)
    big = "".join(r.choice("abc é") for _ in range(5000))
    tricky = "x" * 990 + "WARC/1.1\r\n\r\nWARC/1.1" * 30 + "WARC/1.1"
    rows = [(1, "http://a/b c\r\nd", big), (2, None, big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", tricky), (9, "u", tricky), (None, "u", big), (3, "u", big), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (12, "u", "z" * 999), (13, "u", "z" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash")).repartition(3)
    path = f"file://{tmp_path}/archive"
    warc.write_warc(pages, path, chunk_bytes=700)
    got = Counter(tuple(r) for r in warc.read_warc(spark, path).collect())
    expected = Counter()
    for page, _, html in rows:
        b = (html or "").encode()
        keep = max(p for p, _, h in rows if (h or "").encode() == b and p is not None)
        revisit = len(b) >= 1000 and page != keep
        expected[page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keep if revisit else None] += 1
    assert got == expected
    chunks = warc.read_chunks(spark, path)
    assert chunks.agg(F.max(F.length("data"))).first()[0] <= 700
    assert chunks.where("record_type = 'continuation'").count() > 20


def test_warc_reader_finds_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 3000)], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/a", chunk_bytes=700)
    (file,) = [f for f in (tmp_path / "a").iterdir() if f.suffix == ".txt" and f.stat().st_size > 500]
    for crc in (tmp_path / "a").glob(".*.crc"):
        crc.unlink()
    file.write_bytes(file.read_bytes().replace(b"aaaa", b"aaba", 1))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, f"file://{tmp_path}/a").collect()


def vector_rows():
    r = np.random.default_rng(8)
    v = r.normal(size=(400, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    same = v[3].tolist()
    rows += [(1000 + i, same) for i in range(60)] + [(2000, None), (2001, [0.0] * 24), (2002, [None] + [0.1] * 23), (2003, [float("nan")] * 24), (2004, [float("inf")] * 24), (2020, v[3].tolist()), (None, same), (5, v[5].tolist())]
    return rows


def brute_top(rows, k, score, zero):
    good = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x) and (zero or any(x)):
            good[i] = x
    out = []
    for q in good:
        if q % 20 == 0:
            near = sorted(((-score(good[q], x), i) for i, x in good.items() if i != q))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 37])
def test_exact_top_k(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = topk.exact_top_k(df, df.where("vec_id % 20 = 0"), rows_block=block, query_block=7)
    whole = lambda x: [int(np.floor(64 * c)) for c in x]
    expected = brute_top(rows, 20, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b))), True)
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_exact_top_k_with_large_components(spark):
    rows = [(i, [float((i * 7919 % 101) * 10**5), float(-i * 10**5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = brute_top(rows, 5, lambda a, b: sum(int(64 * x) * int(64 * y) for x, y in zip(a, b)), True)
    assert sorted(tuple(r) for r in topk.exact_top_k(df, df.where("vec_id % 20 = 0"), k=5).collect()) == expected


@pytest.mark.parametrize("scale", [1.0, None])
def test_nearest_neighbours(spark, scale):
    rows = vector_rows()
    if scale is None:  # norms differ
        rows = [(i, x if x is None or i is None or i >= 400 else [c * (1 + i % 3) for c in x]) for i, x in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1))
    got = sorted(tuple(r) for r in ann.nearest(df, df.where("vec_id % 20 = 0"), block=64).collect())
    expected = brute_top(rows, 20, lambda a, b: float(np.dot(a, b)), False)
    found = {(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in expected}
    assert len(found) >= 0.9 * len(expected)
    by = {i: np.array(x) for i, x in rows if x is not None and i is not None and None not in x}
    assert all(abs(s - by[q] @ by[i]) < 1e-9 for q, _, i, s in got)
    for q in {g[0] for g in got}:
        mine = [g for g in got if g[0] == q]
        assert [g[1] for g in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda g: (-round(g[3], 12), g[2]))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert jaccard.ngram_components(docs).count() == 0
    assert repeats.remove_repeats(docs, sketch_bits=20).count() == 0
    assert lines.remove_repeated_lines(docs).count() == 0
    assert mixing.mix_sources(docs).count() == 0
    assert packing.pack(docs).count() == 0
    assert langid.train(docs) is None and langid.identify(docs, None).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.train(docs, labels)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(vectors, vectors).count() == 0 and topk.exact_top_k(vectors, vectors).count() == 0


def test_empty_archive(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0
