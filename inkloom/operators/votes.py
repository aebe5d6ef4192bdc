"""Votes: one value for a book out of what its files say, with the ties broken in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.dates import language_tag, publication_date
from inkloom.functions.identifiers import is_isbn_scheme, isbn13, merge_sources
from inkloom.functions.text import fold_latin, meta_key, normalize, title_key
from inkloom.functions.titles import canonical_author, is_artifact_title, is_placeholder_author, is_placeholder_title, is_prose_title


def common_value(rows: DataFrame, key: str, value: str, order: str, prefer_longer: bool = False) -> DataFrame:
    """key and its most frequent value, folded for counting and shown in its first spelling. Ties go to the longer
    spelling, if asked for, then to the one met first. Empty values don't vote; two aggregations, no window."""
    votes = rows.select(key, F.col(order).alias("_o"), normalize(value).alias("_v")).where("_v <> ''").withColumn("_k", fold_latin("_v"))
    counted = votes.groupBy(key, "_k").agg(F.count("*").alias("_n"), F.min_by("_v", "_o").alias("_v"), F.min("_o").alias("_o"))
    length = F.length("_v") if prefer_longer else F.lit(0)
    return counted.groupBy(key).agg(F.max_by("_v", F.struct("_n", length, -F.col("_o"))).alias(value))


def mentions_author(title: Column, authors: Column) -> Column:
    """Whether a title holds the words of an author's name."""
    return F.exists(authors, lambda a: F.contains(F.concat(F.lit(" "), title_key(title), F.lit(" ")), F.concat(F.lit(" "), title_key(a), F.lit(" "))) & (title_key(a) != ""))


def title_vote(rows: DataFrame, key: str, title: str, authors: str, order: str) -> DataFrame:
    """key and its title. Placeholders, artifacts and prose don't vote; of a title's spellings the longest is shown.
    Order: votes, fewer underscores, no author in it, length, met first."""
    votes = rows.select(key, F.col(order).alias("_o"), normalize(title).alias("_v"), F.col(authors).alias("_a"))
    votes = votes.where(~is_placeholder_title("_v") & ~is_artifact_title("_v") & ~is_prose_title("_v")).withColumn("_k", meta_key("_v"))
    longest = F.max_by("_v", F.struct(F.length("_v"), -F.col("_o")))
    votes = votes.withColumn("_m", F.when(mentions_author(F.col("_v"), F.col("_a")), 1).otherwise(0))
    counted = votes.groupBy(key, "_k").agg(F.count("*").alias("_n"), longest.alias("_v"), F.min("_o").alias("_o"), F.max("_m").alias("_m"))
    underscores = F.length("_v") - F.length(F.replace("_v", F.lit("_"), F.lit("")))
    rank = F.struct("_n", -underscores, -F.col("_m"), F.length("_v"), -F.col("_o"))
    return counted.groupBy(key).agg(F.max_by("_v", rank).alias(title))


def author_vote(rows: DataFrame, key: str, authors: str, order: str) -> DataFrame:
    """key and its list of authors. Lists vote as a whole, in any order and with names turned to ``First Last``.
    Order: votes, more authors, more characters, more names of several words, met first."""
    clean = F.filter(F.transform(authors, lambda a: normalize(a)), lambda a: (a != "") & ~is_placeholder_author(a))
    votes = rows.select(key, F.col(order).alias("_o"), clean.alias("_v")).where(F.size("_v") > 0)
    votes = votes.withColumn("_k", F.array_join(F.array_sort(F.transform("_v", lambda a: fold_latin(canonical_author(a)))), "\u001f"))
    counted = votes.groupBy(key, "_k").agg(F.count("*").alias("_n"), F.min_by("_v", "_o").alias("_v"), F.min("_o").alias("_o"))
    characters = F.length(F.array_join("_v", ""))
    spaced = F.size(F.filter("_v", lambda a: a.contains(" ")))
    return counted.groupBy(key).agg(F.max_by("_v", F.struct("_n", F.size("_v"), characters, spaced, -F.col("_o"))).alias(authors))


def series_vote(rows: DataFrame, key: str, order: str, series: str = "series", index: str = "series_index") -> DataFrame:
    """key, its series, and the series index among the files of that series."""
    chosen = common_value(rows, key, series, order)
    same = rows.join(chosen.withColumnRenamed(series, "_s"), key).where(fold_latin(series) == fold_latin("_s"))
    return chosen.join(common_value(same, key, index, order), key, "left").select(key, series, F.coalesce(index, F.lit("")).alias(index))


def publications(rows: DataFrame, key: str, order: str, publisher: str = "publisher", date: str = "publication_date") -> DataFrame:
    """key, publisher and date: each publisher's valid dates once, in the order met; one row without a date where a
    publisher has none."""
    said = rows.select(key, F.col(order).alias("_o"), normalize(publisher).alias("_p"), publication_date(date).alias("_d")).where("_p <> '' OR _d <> ''").withColumn("_k", fold_latin("_p"))
    groups = said.groupBy(key, "_k").agg(F.min_by("_p", "_o").alias(publisher), F.min("_o").alias("first"), F.max(F.col("_d") != "").alias("dated"))
    dates = said.groupBy(key, "_k", "_d").agg(F.min("_o").alias("met"))
    kept = groups.join(dates, [key, "_k"]).where(F.col("dated") == (F.col("_d") != "")).where(~((F.col("_d") == "") & (F.col(publisher) == "")))
    return kept.select(key, publisher, F.col("_d").alias(date), "first", "met")


def distinct_values(rows: DataFrame, key: str, value: str, order: str, kind: str = "subject") -> DataFrame:
    """key and its list of values, each once, in the order met: subjects by folded form, languages by valid tag."""
    shown = language_tag(value) if kind == "language" else normalize(value)
    said = rows.select(key, F.col(order).alias("_o"), shown.alias("_v")).where("_v <> ''")
    each = said.groupBy(key, (F.col("_v") if kind == "language" else fold_latin("_v")).alias("_k")).agg(F.min(F.struct("_o", "_v")).alias("_f"))
    return each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("_f")), lambda f: f["_v"]).alias(value))


def merged_isbns(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key and its ISBNs in 13 digits, in the order met, each with what all occurrences say of its source; rows have
    scheme, value and source."""
    said = rows.where(is_isbn_scheme("scheme")).select(key, F.col(order).alias("_o"), isbn13("value").alias("value"), "source").where("value IS NOT NULL")
    each = said.groupBy(key, "value").agg(F.min("_o").alias("_o"), merge_sources(F.collect_set("source")).alias("source"))
    listed = F.sort_array(F.collect_list(F.struct("_o", "value", "source")))
    return each.groupBy(key).agg(F.transform(listed, lambda x: F.struct(F.lit("ISBN").alias("scheme"), x["value"].alias("value"), x["source"].alias("source"))).alias("identifiers"))


def book_metadata(files: DataFrame, key: str = "book_id", order: str = "path_order") -> DataFrame:
    """All of a book's metadata from its files' (title, authors, description, publisher, publication_date, series,
    series_index, subjects, languages, identifiers)."""
    out = files.select(key).distinct()
    subjects = files.select(key, F.posexplode("subjects").alias("_p", "subject"), order).withColumn("_at", F.col(order) * 100000 + F.col("_p"))
    languages = files.select(key, F.posexplode("languages").alias("_p", "language"), order).withColumn("_at", F.col(order) * 100000 + F.col("_p"))
    isbns = files.select(key, order, F.posexplode("identifiers").alias("_p", "_i")).select(key, "_i.*", (F.col(order) * 100000 + F.col("_p")).alias("_at"))
    pubs = publications(files, key, order).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "met", "publisher", "publication_date"))), lambda p: F.struct(p["publisher"].alias("publisher"), p["publication_date"].alias("publication_date"))).alias("publications"))
    for part in (
        title_vote(files, key, "title", "authors", order), author_vote(files, key, "authors", order), common_value(files, key, "description", order, prefer_longer=True),
        series_vote(files, key, order), pubs, distinct_values(subjects, key, "subject", "_at").withColumnRenamed("subject", "subjects"),
        distinct_values(languages, key, "language", "_at", "language").withColumnRenamed("language", "languages"), merged_isbns(isbns, key, "_at"),
    ):
        out = out.join(part, key, "left")
    return out
