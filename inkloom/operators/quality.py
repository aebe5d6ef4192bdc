"""Quality gates of documents: size, binary content, markup, caches, credits, blurbs, tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import col, fold_all, head
from inkloom.functions.titles import is_credit, is_junk_value

MIN_SIZE = 15_360
# How HTML sources begin, and header names in HTTP caches.
HTML_STARTS = ["<!doctype", "<html", "<head", "<body"]
CACHE_MARKERS = ["http/1.", "content-type:", "content-length:", "last-modified:", "accept-ranges:"]


def below_min_size(size, fmt=None, least: int = 0) -> Column:
    """Whether a plain-text, RTF or PDF file is too small; 0 is the default least size, a negative one turns it off."""
    least = MIN_SIZE if least == 0 else least
    if least < 0:
        return F.lit(False)
    small = F.coalesce(col(size) < least, F.lit(False))
    return small if fmt is None else small & col(fmt).isin("txt", "rtf", "pdf")


def format_disabled(fmt, enabled: list[str]) -> Column:
    """Whether a file's format is one that this installation can't read, so that the file is skipped and not a failure."""
    return ~col(fmt).isin(*enabled)


def looks_binary(text) -> Column:
    """Over 1 % of the first 4,096 characters are controls or replacement characters."""
    sample = F.substring(col(text), 1, 4096)
    odd = F.regexp_count(sample, F.lit("[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F�]"))
    return (F.length(sample) > 0) & (odd * 100 > F.length(sample))


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def looks_like_html(text) -> Column:
    lower = F.lower(F.trim(F.regexp_replace(col(text), "^﻿", "")))
    lower = F.regexp_replace(lower, r"^\s+", "")
    sample = F.substring(lower, 1, 4096)
    tags = _count(sample, "<") + _count(sample, ">")
    starts = F.lit(False)
    for s in HTML_STARTS:
        starts = starts | lower.startswith(s)
    return starts | ((tags > 40) & (tags * 100 > F.length(sample)))


def looks_like_http_cache(text) -> Column:
    sample = F.lower(F.substring(F.regexp_replace(col(text), "^[﻿\\s]+", ""), 1, 8192))
    headers = sum((F.when(sample.contains(m), 1).otherwise(0) for m in CACHE_MARKERS), F.lit(0))
    urls = _count(sample, "http://") + _count(sample, "https://")
    words = F.regexp_count(sample, F.lit(r"\S+"))
    return sample.contains("hts-cache") | (headers >= 2) | ((urls >= 5) & (urls * 20 > words))


def lines_of(text) -> Column:
    """Lines that aren't empty, trimmed."""
    return F.filter(F.transform(F.split(col(text), r"\r\n|\r|\n"), lambda l: F.regexp_replace(l, r"^(?U)\s+|\s+$", "")), lambda l: l != "")


def is_page_number(s: Column) -> Column:
    return s.rlike(r"^\p{Nd}{1,4}$")


def letters(text) -> Column:
    return F.regexp_count(col(text), F.lit(r"\p{L}"))


def credits_only(text) -> Column:
    lines = lines_of(text)
    credit = F.size(F.filter(lines, lambda l: is_credit(l) | is_junk_value(l) | is_page_number(l)))
    return (F.size(lines) > 0) & (credit * 100 >= F.size(lines) * 70) & (letters(text) < 1000)


def blurb_only(text) -> Column:
    lines = lines_of(text)
    return (F.size(lines) > 0) & (F.size(lines) <= 12) & F.coalesce(fold_all(F.get(lines, F.lit(0))).startswith("fulszoveg"), F.lit(False))


def contents_only(text) -> Column:
    lines = lines_of(text)
    toc = F.size(F.filter(lines, lambda l: fold_all(l).startswith("tartalom") | l.endswith(".") | l.contains("...") | is_page_number(F.regexp_extract(l, r"(\S+)$", 1))))
    return (F.size(lines) >= 5) & (toc * 100 >= F.size(lines) * 60)


def junk_reason(text, size) -> Column:
    """Why a file is no book: html, http_cache, few_letters, credits, blurb, contents; null where it may be one."""
    h, n = head(text), col(size)
    trimmed = F.regexp_replace(h, "^[﻿\\s]+", "")
    small, medium = (n >= 0) & (n < 4096), (n >= 0) & (n < 20_480)
    return (
        F.when(trimmed == "", None)
        .when(looks_like_html(h), "html")
        .when(looks_like_http_cache(h), "http_cache")
        .when(small & (letters(h) < 32), "few_letters")
        .when(small & credits_only(h), "credits")
        .when(small & blurb_only(h), "blurb")
        .when(medium & contents_only(h), "contents")
    )


def gate(docs: DataFrame, text: str = "text", size: str = "size", fmt: str | None = None, least: int = 0) -> DataFrame:
    """Adds ``skip_reason``: min_size, binary or a junk reason, null for documents that pass."""
    reason = F.when(below_min_size(size, fmt, least), "min_size").when(looks_binary(text), "binary").otherwise(junk_reason(text, size))
    return docs.withColumn("skip_reason", reason)


def prose_sample(text, most: int = 2000) -> Column:
    """Lines fit for language detection: no code, no markup, some letters; about so many characters."""
    code = lambda l: l.rlike(r"[{};]\s*$|^\s*(#|//|<)|[=<>]{2}")
    prose = F.filter(lines_of(text), lambda l: ~code(l) & (F.regexp_count(l, F.lit(r"\p{L}")) * 2 >= F.length(l)))
    return F.substring(F.array_join(prose, " "), 1, most)


# Frequent words of a few languages.
FREQUENT = {
    "en": "the and of to in is that was for it with as his on be at by had not are but from or have an they which one you were her all she there would their",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux elle cette mais ou leur",
    "es": "de la que el en y los del se las por un para con no una su al lo como más pero sus le ya este sí porque esta entre cuando",
    "hu": "a az és hogy nem egy is ez azt van volt meg csak de már mint el még ha ami aki kell lesz vagy",
}


def detect_languages(docs: DataFrame, text: str = "text", least_letters: int = 40) -> DataFrame:
    """Adds code and confidence by the share of each language's frequent words in a sample of the head's prose; empty
    and 0 under so many letters. The sample and its words are columns of their own, so that they are made once."""
    sampled = docs.withColumn("_sample", prose_sample(head(text)))
    words = sampled.withColumn("_words", F.split(F.lower("_sample"), r"[^\p{L}]+"))
    known = lambda frequent: F.size(F.filter("_words", lambda w: w.isin(frequent)))
    shares = [F.struct((known(frequent.split()) / F.greatest(F.size("_words"), F.lit(1))).alias("share"), F.lit(code).alias("code")) for code, frequent in FREQUENT.items()]
    ranked = words.withColumn("_r", F.sort_array(F.array(*shares), False)).withColumn("_enough", letters("_sample") >= least_letters)
    best, second = F.col("_r")[0], F.col("_r")[1]
    confidence = F.when(F.col("_enough") & (best["share"] > 0), best["share"] / (best["share"] + second["share"])).otherwise(0.0)
    return ranked.withColumn("confidence", confidence).withColumn("code", F.when(F.col("confidence") > 0, best["code"]).otherwise("")).drop("_sample", "_words", "_r", "_enough")
