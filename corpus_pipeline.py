"""The corpus pipeline: documents in, training sequences out.

Five stages, each on all that the one before kept: language ID, line dedup, n-gram Jaccard join, mixing sources to target
weights, best-fit packing. Each is written as Parquet and read again; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import jaccard, langid, lines, mixing, packing
from inkloom.session import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is less certain than this is rejected, as is one without a letter.
LEAST_SCORE = 0.3
CAPACITY = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages. The model is fitted to the stage's own rows that have a language;
    lang becomes the prediction. Null and empty texts and texts without letters go."""
    found = langid.identify(docs, langid.train(docs))
    keep = found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE))
    return keep.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of windows that occurred before. One that is left with no word goes; n_chars is
    that of the new text."""
    out = lines.remove_repeated_lines(docs)
    return out.where(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one of the smallest doc_id; of repeated rows, one."""
    near = jaccard.ngram_components(docs)
    first = near.where("doc_id = component_id OR component_id IS NULL").select("doc_id").distinct()
    stays = docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi").withColumn("_key", F.xxhash64("text"))
    # rows of one doc_id are one document: of different texts the one of the least hash stays, whatever is retried
    least = F.min_by(F.struct(*COLUMNS), F.struct("_key", "n_chars", "lang", "source")).alias("row")
    return docs.where("doc_id IS NULL").select(*COLUMNS).unionByName(stays.groupBy("doc_id").agg(least).select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; a copy is a row of its own."""
    return mixing.mix_sources(docs, mixing.WEIGHTS).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece: its place in a training sequence of CAPACITY words, its document and its words."""
    scratch = Scratch(spark, "packing")
    placed = scratch.save(packing.pack(docs, CAPACITY, cluster=F.xxhash64("doc_id", "text")), "placed")
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), "source", "lang", "text").dropDuplicates(["id", "key"])
    # all places of a copy meet its text once; only a text of several pieces is split, and that once
    place = F.struct("shard", "bin", "slot", "offset", "start", "words")
    held = placed.groupBy("doc_id", "text_key", "copy").agg(F.collect_list(place).alias("places"))
    joined = texts.join(held, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    cut = F.exists("places", lambda p: p["start"] > 0) | F.exists("places", lambda p: p["words"] == CAPACITY)
    words = F.when(cut, F.split(F.trim(F.regexp_replace("text", packing.SPACES, " ")), " "))
    joined = joined.select("doc_id", "copy", "source", "lang", "text", "places", words.alias("all"))
    piece = lambda p: F.when(F.size("all") > p["words"], F.array_join(F.slice("all", (p["start"] + 1).cast("int"), p["words"].cast("int")), " ")).otherwise(F.col("text"))
    made = F.transform("places", lambda p: F.struct(p["shard"].alias("shard"), p["bin"].alias("bin"), p["slot"].alias("slot"), p["offset"].alias("offset"), p["start"].alias("start"), p["words"].alias("words"), piece(p).alias("piece")))
    out = joined.select("doc_id", "copy", "source", "lang", F.inline(made))
    return out.select("shard", "bin", "slot", "offset", "doc_id", "copy", "start", "words", "source", "lang", F.col("piece").alias("text"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix),
    ("best_fit", sequences),
]
#: Language ID fits a model, and packing is a sequential search: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
