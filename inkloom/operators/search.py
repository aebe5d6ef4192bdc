"""Search of titles and authors: every word must be part of one field; ranked by BM25 over trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.text import containment, fold_all, let, sanitize_query
from inkloom.session import Scratch


def trigrams(c) -> Column:
    every = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substr(s, i, F.lit(3)))
    return let(fold_all(c), lambda s: F.when(F.length(s) >= 3, every(s)).otherwise(F.array().cast("array<string>")))


def trigram_index(rows: DataFrame, ident: str, field: str) -> DataFrame:
    """ident, trigram and how often it occurs in the field. Fields are brought together by ident, not their trigrams, of
    which there are many times more; what is counted is the trigrams of one ident."""
    # runs of equal trigrams, from where each begins in the sorted list
    begins = lambda g: F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: (i == 0) | (F.get(g, i) != F.get(g, i - 1)))
    counted = lambda g, at: F.transform(at, lambda i, k: F.struct(F.get(g, i).alias("trigram"), (F.coalesce(F.get(at, k + 1), F.size(g)) - i).cast("long").alias("tf")))
    grams = let(F.sort_array(F.flatten(F.transform("_f", trigrams))), lambda g: F.when(F.size(g) > 0, let(begins(g), lambda at: counted(g, at))))
    fields = rows.where(F.col(field).isNotNull()).groupBy(ident).agg(F.collect_list(field).alias("_f"))
    return fields.select(ident, F.inline(grams))


def holds_words(field, words: list[str]) -> Column:
    """Whether the folded field holds each folded word; a word under three characters is in nothing."""
    if any(len(w) < 3 for w in words):
        return F.lit(False)
    folded = fold_all(field)
    out = F.lit(True)
    for w in words:
        out = out & F.contains(folded, fold_all(F.lit(w)))
    return out


def bm25(rows: DataFrame, ident: str, field: str, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """ident and rank (lower is better) of rows whose field holds all words. One aggregation counts all rows and
    lengths; frequencies of the query's trigrams are a second, over as many rows as there are trigrams in the query."""
    grams = sorted({g for w in words for g in (w.lower()[i : i + 3] for i in range(len(w) - 2))})
    sized = rows.select(ident, field, F.size(trigrams(field)).alias("dl"))
    total = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    occurrences = lambda f, g: F.size(F.filter(trigrams(f), lambda t: t == g))
    counts = lambda f: F.array(*[occurrences(f, g) for g in grams])
    freq = rows.select(F.posexplode(counts(field)).alias("g", "tf")).where("tf > 0").groupBy("g").agg(F.count("*").alias("df"))
    weight = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    idf = freq.crossJoin(F.broadcast(total)).select(F.struct("g", weight.alias("idf")).alias("x"), "avgdl")
    weights = idf.groupBy("avgdl").agg(F.map_from_entries(F.collect_list("x")).alias("idf"))
    hits = sized.where(holds_words(field, words)).crossJoin(F.broadcast(weights)).withColumn("tf", counts(F.col(field)))
    term = lambda tf, i: F.coalesce(F.element_at("idf", i), F.lit(0.0)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.select(ident, (-F.aggregate(F.transform("tf", term), F.lit(0.0), lambda s, x: s + x)).alias("rank"))


def best_ranks(parts: list[DataFrame], ident: str) -> DataFrame:
    """ident and its least rank in any of the parts (ident, rank)."""
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    return hits.groupBy(ident).agg(F.min("rank").alias("rank"))


def containing(docs: DataFrame, items: DataFrame, least: float = 0.6) -> DataFrame:
    """item_id, doc_id and hit of documents (doc_id, tokens) that hold at least a share of an item's tokens (item_id,
    tokens), both lists of distinct tokens; items without tokens are held by none.

    A document with such a share holds one of the item's rarest tokens, as many as may be missing and one more, so only
    these are looked up; the pairs found are then compared in whole.
    """
    asked = items.where(F.size("tokens") > 0).select("item_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    held = docs.select("doc_id", F.explode("tokens").alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    held = Scratch(docs.sparkSession, "containing").save(held, "held")
    counts = held.groupBy("token").agg(F.count("*").alias("df"))
    rare = asked.join(counts, "token", "left").withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "token")))
    rare = rare.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).where("df > 0").select("item_id", "token")
    met = held.join(rare, "token").select("item_id", "doc_id").distinct()
    both = met.join(items.select("item_id", F.col("tokens").alias("x")), "item_id").join(docs.select("doc_id", F.col("tokens").alias("y")), "doc_id")
    return both.withColumn("hit", containment(F.col("x"), F.col("y"))).where(F.col("hit") + 1e-9 >= least).select("item_id", "doc_id", "hit")


def search(books: DataFrame, raw: str, author: bool = False, title: bool = False, limit: int = 0) -> DataFrame:
    """Books (book_id, title, authors) that hold the words of a search string in their title or in one author's name,
    by rank, then id; both fields by default and where both are asked for; a limit of 0 or less is none."""
    words = sanitize_query(raw).split()
    parts = []
    if title or not author:
        parts.append(bm25(books.select("book_id", "title"), "book_id", "title", words))
    if author or not title:
        names = books.select("book_id", F.posexplode("authors").alias("pos", "name")).withColumn("row", F.struct("book_id", "pos"))
        parts.append(bm25(names, "row", "name", words).select(F.col("row.book_id").alias("book_id"), "rank"))
    out = best_ranks(parts, "book_id").join(books, "book_id").orderBy("rank", "book_id")
    return out.limit(limit) if limit > 0 else out
