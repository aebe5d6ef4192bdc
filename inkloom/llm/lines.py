"""Operator 6, line dedup: later occurrences of runs of three lines go.

Lines are what line feeds separate. Every three consecutive lines make a window, hashed by two 64-bit numbers. Of the
places where a window's lines stand, the first by (doc_id, line number) stays; all lines that any later one covers are
removed. Windows overlap, so a repeated passage of three lines or more is covered as a whole. A window's first place is
found by an aggregation that combines within each task before it is shuffled, and only windows that occur again are
joined with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.llm.names import fresh

SALTS = 8


def remove_repeated_lines(docs: DataFrame, window: int = 3) -> DataFrame:
    """Documents without the lines of repeated windows; other columns stay as they are, whatever their names.

    docs has doc_id and text. The result's text is the lines kept, joined by line feeds; n_lines and n_removed count
    lines before and lines removed, and replace columns of these names. Windows are judged on the input. A text of fewer
    lines than ``window`` has none and stays. A null text stays null, with 0 lines; so does the empty text stay, one
    empty line. A row with a null doc_id stays whole and removes nothing. Rows of one doc_id and one text are one place,
    so repeated rows don't remove each other; rows of one doc_id and different texts take their order from the text's
    hash. An empty table gives an empty one.
    """
    own = [f for f in docs.schema.fields if f.name.lower() not in ("n_lines", "n_removed")]
    key, gone, parts = fresh([f.name for f in own], "key", "gone", "lines")
    docs = docs.select(*[f.name for f in own]).withColumn(key, F.xxhash64("text"))
    lines = F.split("text", "\n", -1)
    long = docs.where("doc_id IS NOT NULL").where(F.length("text") - F.length(F.replace("text", F.lit("\n"))) >= window - 1)
    held = long.select("doc_id", F.col(key).alias("key"), lines.alias("l"))
    joined = F.transform(
        F.sequence(F.lit(1), F.size("l") - (window - 1)),
        lambda i: F.struct(i.alias("at"), F.concat_ws("\n", *[F.get("l", i + j) for j in range(-1, window - 1)]).alias("w")),
    )
    # outer, since a filter on the array's size would be pushed below the lines and split the text again for each line
    windows = held.select("doc_id", "key", F.inline_outer(joined)).where("at IS NOT NULL").select("doc_id", "key", "at", F.xxhash64("w").alias("ha"), F.xxhash64(F.lit(1), F.reverse("w"), F.length("w")).alias("hb"))
    place = F.struct("doc_id", "key", "at")
    first = windows.groupBy("ha", "hb").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("ha", "hb", "first")
    # a window of very many places is dealt into SALTS parts, each with its own copy of the one row of the first place
    salted = first.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    again = windows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int")).join(salted, ["ha", "hb", "salt"]).where(place > F.col("first"))
    later = again.groupBy("doc_id", F.col("key").alias(key)).agg(F.collect_set("at").alias(gone))
    out = docs.join(later, ["doc_id", key], "left").withColumn(parts, lines)
    covered = F.array_distinct(F.flatten(F.transform(gone, lambda a: F.sequence(a, a + (window - 1)))))
    out = out.withColumn(gone, F.coalesce(covered, F.array().cast(T.ArrayType(T.IntegerType()))))
    keep = F.transform(F.array_except(F.sequence(F.lit(1), F.size(parts)), gone), lambda i: F.element_at(parts, i))
    text = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(keep, "\n"))
    return out.select(
        *[text.alias("text") if f.name == "text" else F.col(f.name) for f in own],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
    )


ORACLE = """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT * FROM (SELECT doc_id, pos, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)) x WHERE c IS NOT NULL),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS r FROM w) x WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) v(k)),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
         FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(k.text) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
