"""Sources so small that their rate is in the thousands."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkloom.llm import mixing


@pytest.mark.parametrize("run", [1 << 14, 100])
def test_mixing_of_rare_sources(spark, monkeypatch, run):
    monkeypatch.setattr(mixing, "RUN", run)
    rows = [(i, "x" * 3000, None, "big", 0) for i in range(60)] + [(1000 + i, "y" * 3, None, "rare", 0) for i in range(8)] + [(2000, "z" * 100, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix_sources(docs).cache()
    total = 60 * 3000 + 8 * 3 + 100
    rate = {"rare": total / 3 / 24, None: total / 3 / 100}  # 2501.7 and 600.4
    counts = Counter(r["doc_id"] for r in out.where("source IS DISTINCT FROM 'big'").select("doc_id").collect())
    rare = [counts[1000 + i] for i in range(8)]
    assert all(abs(n - rate["rare"]) < 5 * rate["rare"] ** 0.5 for n in rare) and len(set(rare)) > 4
    assert abs(sum(rare) - 8 * rate["rare"]) < 4 * (8 * rate["rare"]) ** 0.5
    assert abs(counts[2000] - rate[None]) < 5 * rate[None] ** 0.5
    numbers = out.where("doc_id = 1000").agg(F.min("copy_no"), F.max("copy_no"), F.count_distinct("copy_no")).first()
    assert tuple(numbers) == (1, counts[1000], counts[1000])
    assert dict(out.dtypes)["copy_no"] == "int"
