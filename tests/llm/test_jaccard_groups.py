"""The n-gram Jaccard join on dense groups: one passage in very many documents, near copies around the threshold, texts
made of shared passages, and documents of several texts, against a full comparison."""

import random

import numpy as np
import pytest

from inkloom.llm import jaccard

DOCS = "doc_id long, text string"


def brute(rows, k=5):
    """Component of each doc_id by all pairs."""
    place, sets = {}, []
    for _, t in rows:
        w = (t or "").lower().split()
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
        sets.append([place.setdefault(g, len(place)) for g in grams])
    x = np.zeros((len(rows), max(1, len(place))), np.float32)
    for i, s in enumerate(sets):
        x[i, s] = 1
    n = x.sum(1)
    parent = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for at in range(0, len(rows), 500):
        both = x[at : at + 500] @ x.T
        linked = (7 * both >= 3 * (n[at : at + 500, None] + n)) & (both > 0)
        for i, j in zip(*np.nonzero(linked)):
            a, b = sorted((find(rows[at + i][0]), find(rows[j][0])))
            parent[b] = a
    return {i: find(i) for i in parent}


def check(spark, rows, **how):
    got = jaccard.ngram_components(spark.createDataFrame(rows, DOCS), **how).collect()
    expected = brute(rows)
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, c if (c is not None) else None) for i, c in expected.items()}
    return expected


def fresh(r, n):
    return [f"w{r.getrandbits(40)}" for _ in range(n)]


def test_one_passage_in_2000_documents(spark):
    r = random.Random(1)
    passage = fresh(r, 50)
    rows = [(i, " ".join(fresh(r, r.randint(5, 60)) + passage + fresh(r, r.randint(0, 5)))) for i in range(2000)]
    found = check(spark, rows)
    assert len(set(found.values())) > 1500 and len(found) - len(set(found.values())) > 50


@pytest.mark.parametrize("how", [{}, {"rounds": 1}, {"bands": 1, "group_rows": 7, "slice_tokens": 50}])
def test_near_copies_around_the_threshold(spark, how):
    r = random.Random(2)
    rows = []
    for base in range(3):
        core = fresh(r, 120)
        for _ in range(150):
            w = list(core)
            for _ in range(r.randint(0, 7)):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1, 1, 2])] = fresh(r, r.choice([0, 1, 1, 3]))
            if r.random() < 0.2:
                w = w[r.randint(0, 30) :]
            rows.append((len(rows), " ".join(w)))
    found = check(spark, rows, **how)
    assert 3 < len(set(found.values())) < 400


def test_texts_of_shared_passages(spark):
    r = random.Random(3)
    pool = [fresh(r, r.randint(8, 30)) for _ in range(25)]
    rows = [(i, " ".join(sum((r.choice(pool) for _ in range(r.randint(2, 6))), []))) for i in range(500)]
    found = check(spark, rows)
    assert 1 < len(set(found.values())) < 500


def test_rows_of_one_doc_id_are_one_node(spark):
    r = random.Random(4)
    x, y, z = (" ".join(fresh(r, 20)) for _ in range(3))
    assert check(spark, [(3, x), (7, x), (7, y), (8, y), (9, z), (9, x + " a b")]) == {3: 3, 7: 3, 8: 3, 9: 3}
    assert check(spark, [(7, x), (7, y), (9, None), (9, z), (10, z)]) == {7: 7, 9: 9, 10: 9}
