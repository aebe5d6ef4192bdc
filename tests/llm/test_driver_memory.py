"""What the driver holds: the rows that the language model is fitted to, and what joins broadcast."""

import random
import re
import tracemalloc

import numpy as np

from inkloom.llm import jaccard, langid

DOCS = "doc_id long, text string, lang string"


def test_language_model_is_fitted_in_blocks(spark):
    r = random.Random(1)
    word = {"en": ["the", "tree", "and", "river"], "de": ["der", "Baum", "und", "Fluss"]}
    rows = [(i, " ".join(r.choices(word[v], k=12)), v) for i in range(2000) for v in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows, DOCS)
    tracemalloc.start()
    model = langid.train(docs)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert model.langs == ["de", "en"] and peak < 100


def test_packed_rows_fit_the_same_model():
    r = np.random.default_rng(2)
    langs = [["de", "en", "fr"][i % 3] for i in range(2 * langid.FIT_ROWS + 9)]
    x = np.stack([r.random(400) < np.where(np.arange(400) // 130 == i % 3, 0.3, 0.05) for i in range(len(langs))])
    one, two = langid.fit(x, langs, 12), langid.fit(np.packbits(x, axis=1), langs, 12)
    assert (one.classifiers == two.classifiers).all() and (one.offset == two.offset).all() and (one.sizes == two.sizes).all()


def test_marks_of_near_copies_are_not_broadcast(spark):
    r = random.Random(3)
    core = [f"w{r.getrandbits(40)}" for _ in range(120)]
    rows = []
    for i in range(200):
        w = list(core)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"w{r.getrandbits(40)}"
        rows.append((i, " ".join(w)))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert jaccard.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).count() == 200
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made = store.executionsList()
    plans = "\n".join(made.apply(i).physicalPlanDescription() for i in range(max(0, made.size() - (store.executionsCount() - before)), made.size()))
    joins = re.findall(r"\) (\w+Join)[^\n]*\nLeft keys \[4\]: \[grp#\d+L?, mark#", plans)
    assert joins and set(joins) == {"SortMergeJoin"}
