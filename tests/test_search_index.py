"""The index of trigrams, also where an id has several rows."""

from collections import Counter

from inkloom.operators import search


def test_trigrams_are_counted_by_id_without_a_row_for_each(spark):
    rows = [(1, "banana"), (1, "Bandana"), (2, "ab"), (3, None), (4, "  aaaa a"), (None, "abcabc"), (5, "Ünü ünü"), (None, "xabc"), (6, "")]
    df = search.trigram_index(spark.createDataFrame(rows, "i long, s string"), "i", "s")
    want = Counter()
    for i, s in rows:
        s = " ".join((s or "").lower().replace("ü", "u").split())
        want.update((i, s[k : k + 3]) for k in range(len(s) - 2))
    assert {(r["i"], r["trigram"]): r["tf"] for r in df.collect()} == want and dict(df.dtypes) == {"i": "bigint", "trigram": "string", "tf": "bigint"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") > plan.index("Generate")  # fields are grouped before they are taken apart
