"""ISBNs and other identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.text import col

DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
PATTERN = r"(?i)(?:97[89][\s\-]?)?(?:[0-9][\s\-]?){9}[0-9Xx]"
#: The 10 or 13 of a label; not where eight more places follow and no more, with which it is an ISBN of ten digits itself.
NUMBER = r"(?:[\s\-]?1[03](?![\s\-‐–]*(?:[0-9][\s\-‐–]*){7}[0-9Xx](?![\s\-‐–]*[0-9Xx])))?"
LABEL = rf"(?i)^\s*(?:e-?)?isbn{NUMBER}\s*(?:\([^)]*\))?\s*[:.\-]?\s*"


def _plain(raw) -> Column:
    return F.upper(F.regexp_replace(F.translate(col(raw), DIGITS, "0123456789" * 2), rf"(?i)^\s*isbn{NUMBER}\s*[:.]?|[\s\-‐–]", ""))


def _digit_sum(s: Column, weights: list[int]) -> Column:
    digits = F.transform(F.filter(F.split(s, ""), lambda d: d != ""), lambda d: F.when(d == "X", 10).otherwise(d.try_cast("int")))
    products = F.zip_with(digits, F.array(*map(F.lit, weights)), lambda d, w: F.coalesce(d * w, F.lit(0)))
    return F.aggregate(products, F.lit(0), lambda t, x: t + x)


def isbn13(raw) -> Column:
    """The 13 digits of a valid ISBN of 10 or 13, null for anything else. One digit over and over is a placeholder."""
    s = _plain(raw)
    placeholder = s.rlike(r"^(?:97[89])?([0-9])\1+$")
    ten_ok = s.rlike("^[0-9]{9}[0-9X]$") & (_digit_sum(s, [10, 9, 8, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0)
    thirteen_ok = s.rlike("^97[89][0-9]{10}$") & (_digit_sum(s, [1, 3] * 6 + [1]) % 10 == 0)
    core = F.concat(F.lit("978"), F.substring(s, 1, 9))
    check = F.pmod(10 - F.pmod(_digit_sum(core, [1, 3] * 6), F.lit(10)), F.lit(10))
    return F.when(placeholder, None).when(thirteen_ok, s).when(ten_ok, F.concat(core, check.cast("string")))


def is_isbn_scheme(c) -> Column:
    return F.upper(F.trim(col(c))).isin("ISBN", "ISBN-10", "ISBN-13")


def line_isbns(text) -> Column:
    """ISBNs that stand alone on a labelled line of a text head, each once, in order; ISBNs within prose don't count."""
    lines = F.filter(F.split(col(text), r"\r\n|\r|\n"), lambda l: l.rlike(LABEL))
    bare = F.transform(lines, lambda l: F.trim(F.regexp_replace(F.regexp_replace(l, LABEL, ""), r"\s*\([^)]*\)\s*$", "")))
    alone = F.filter(bare, lambda l: l.rlike("^" + PATTERN + r"[.;,]?$"))
    return F.array_distinct(F.filter(F.transform(alone, lambda l: isbn13(F.regexp_replace(l, "[.;,]$", ""))), lambda x: x.isNotNull()))


def dois(text) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(r"(10\.[0-9]{4,9}/[^\s\"<>]+)"), 1), lambda d: F.regexp_replace(d, r"[.,;)]+$", "")))


def merge_sources(sources) -> Column:
    """What occurrences of one identifier say of where it came from; unknown sources count as METADATA."""
    known = F.array_distinct(F.transform(col(sources), lambda s: F.when(s.isin("METADATA", "TEXT", "METADATA_AND_TEXT"), s).otherwise("METADATA")))
    return F.when(F.size(known) == 1, known[0]).otherwise("METADATA_AND_TEXT")


def isbn_priority(source) -> Column:
    """0 in metadata and text, 1 in metadata, 2 in text, 3 elsewhere."""
    s = col(source)
    return F.when(s == "METADATA_AND_TEXT", 0).when(s == "METADATA", 1).when(s == "TEXT", 2).otherwise(3)
