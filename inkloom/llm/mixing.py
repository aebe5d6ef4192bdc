"""Operator 3, mixing sources to target weights, with DataFrame functions only.

Poisson replication: a source's rate is its share of the target over its share of the corpus, so the expected amount of
each source is what its weight asks for. Each document's count of copies is the inverse of the Poisson distribution
function of that rate at a uniform number that md5 makes of seed and doc_id; it depends on nothing else and is the same
after any retry. Copies are exploded and dealt over all partitions by the hash of the copy: one shuffle by that hash, and a sort by it within each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.names import fresh
from inkloom.session import Scratch

#: So many sources are broadcast; where there are more, their rates are joined by a shuffle.
BROADCAST_SOURCES = 50_000
HEX = 13  # 52 bits, as many as a double holds
#: A count of a higher rate is the sum of several, each of an equal part of the rate, as exp(-rate) would be 0.
RATE = 700
#: So many copies of a row are made from one array.
RUN = 1 << 14


def _uniform(*parts):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, HEX), 16, 10).cast("double") / float(16**HEX)


def rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0) -> DataFrame:
    """source, size (characters), rate, parts, and the distribution function's values below 1, at rate / parts, for each
    source present."""
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    weight = F.coalesce(F.element_at(known, F.coalesce("source", F.lit(""))), F.lit(float(default_weight))) if weights else F.lit(float(default_weight))
    size = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size"))
    size = size.withColumn("weight", F.when(F.col("size") > 0, weight.cast("double")).otherwise(0.0))
    total = size.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.when((F.col("size") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * F.col("all_size") * F.lit(float(epochs)) / F.col("size")).otherwise(0.0)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / RATE).cast("int"))
    each = F.col("rate") / F.col("parts")
    terms = F.sequence(F.lit(1), F.ceil(each + 12 * F.sqrt(each) + 30).cast("int"))
    start = F.struct(F.exp(-each).alias("p"), F.array(F.exp(-each)).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * each / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    cdf = F.aggregate(terms, start, step)["cdf"]
    return size.crossJoin(F.broadcast(total)).withColumn("rate", rate).withColumn("parts", parts).select("source", "size", "rate", "parts", cdf.alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, epochs: float = 1.0, seed: int = 17, shuffle: bool = True) -> DataFrame:
    """docs (doc_id, text, source and any others) with each row as often as its count, and copy_no from 1.

    ``weights`` maps sources to target shares of all characters; a source that isn't in it has ``default_weight``, and a
    source with no characters has no share and no copies. A null source is a source of its own, named '' in ``weights``.
    All rows of one doc_id get the same number; a row with a null doc_id takes its number from its text. A null
    or empty text has no characters, counts as a row like any other and has the copies of its source's rate. A column
    copy_no is replaced, others stay, whatever their names. An empty table gives an empty one. Where a rate is over ``RATE``, the count is the sum of counts of equal parts of the rate, each
    at a number of its own; a sum of such counts has the distribution of the whole rate.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() != "copy_no"])
    name, parts, cdf, n, run, order = fresh(docs.columns, "source", "parts", "cdf", "n", "run", "order")
    by = rates(docs.select("source", "text"), weights or {}, default_weight, epochs).select(F.col("source").alias(name), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    by = Scratch(docs.sparkSession, "mixing").save(by, "rates")
    by = F.broadcast(by) if by.count() <= BROADCAST_SOURCES else by
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce("text", F.lit("")))))
    number = lambda j: F.when(j == 1, _uniform(F.lit(str(seed)), key)).otherwise(_uniform(F.concat_ws("#", F.lit(str(seed)), j), key))
    us = F.transform(F.sequence(F.lit(1), parts), number)
    counted = docs.join(by, F.col("source").eqNullSafe(F.col(name)))
    count = F.aggregate(us, F.lit(0).cast("long"), lambda s, u: s + F.size(F.filter(cdf, lambda c: c <= u)))
    counted = counted.withColumn(n, count.cast("int")).where(F.col(n) > 0)
    runs = counted.select(*docs.columns, n, F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / RUN).cast("int"))).alias(run))
    copies = runs.select(*docs.columns, F.explode(F.sequence(F.col(run) * RUN + 1, F.least(n, F.lit(RUN) + F.col(run) * RUN))).alias("copy_no"))
    if not shuffle:
        return copies
    place = F.xxhash64(F.lit(seed), key, "copy_no")
    return copies.withColumn(order, place).repartition(order).sortWithinPartitions(order, "doc_id", "copy_no").drop(order)


#: The query's targets: the source of a third of the corpus is to be a tenth as much of the mix as four others together.
WEIGHTS = {"src0": 0.5, "src1": 2.0, "src2": 2.0}

ORACLE = """
WITH s AS (SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY 1),
w AS (SELECT source, size, CASE WHEN size = 0 THEN 0.0 WHEN source = 'src0' THEN 0.5 WHEN source IN ('src1', 'src2') THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
r AS (SELECT source, CASE WHEN size > 0 THEN weight / (SELECT sum(weight) FROM w) * (SELECT sum(size) FROM w)::DOUBLE / size ELSE 0.0 END AS rate FROM w),
c AS (WITH RECURSIVE t AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM t WHERE k < 60) SELECT source, list(cdf) AS cdf FROM t GROUP BY source),
n AS (SELECT d.doc_id, d.source, d.text, len(list_filter(c.cdf, lambda x: x <= ('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, '#' || md5(coalesce(d.text, '')))), 1, 13))::BIGINT / 4503599627370496.0)) AS n
      FROM documents d JOIN c ON c.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, source, unnest(range(1, n + 1))::INTEGER AS copy_no, sha256(text) AS text_sha256 FROM n WHERE n > 0
"""


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, WEIGHTS).select("doc_id", "source", "copy_no", F.sha2("text", 256).alias("text_sha256"))
