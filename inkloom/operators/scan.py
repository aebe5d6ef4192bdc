"""A scan's path of one file: gates that need no parsing, the parser, gates on its text, content hash, head tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import content_tokens, head
from inkloom.operators import quality
from inkloom.sources.parsers import SCHEMA, parse

PLAIN = ("txt", "rtf")


def scanned(files: DataFrame, least: int = 0, enabled: list[str] | None = None, parsers: dict[str, Callable[[bytes], dict]] | None = None) -> DataFrame:
    """Parsed rows of files (path, format, length, content, error), with skip_reason, content_hash and head_tokens.

    A file of a format that isn't ``enabled`` (all, if none are named) or under the least size (``below_min_size``) is
    left out before it is parsed. Plain texts are left out where they are binary or junk, by the head of what was parsed.
    A file with an error has no skip_reason, and neither it nor one left out has a hash. The hash is of the whole text,
    white space normalised; a text without words has none. An empty table gives an empty one.
    """
    off = quality.format_disabled("format", enabled) if enabled is not None else F.lit(False)
    first = F.when(F.col("error").isNotNull(), None).when(off, "format_disabled").when(quality.below_min_size("length", "format", least), "min_size")
    judged = files.withColumn("skip_reason", first)
    names = [c.split(" ")[0] for c in SCHEMA.replace("array<struct<scheme:string,value:string,source:string>>", "x").split(", ")]
    parsed = parse(judged.where("skip_reason IS NULL").drop("skip_reason"), parsers)
    plain = F.col("error").isNull() & F.col("format").isin(*PLAIN)
    later = F.when(plain & quality.looks_binary(head("text")), "binary").when(plain, quality.junk_reason("text", "length"))
    words = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    kept = parsed.withColumn("skip_reason", later)
    good = F.col("error").isNull() & F.col("skip_reason").isNull() & (words != "")
    kept = kept.withColumn("content_hash", F.when(good, F.sha2(words, 256))).withColumn("head_tokens", F.when(good, content_tokens(head("text"))).otherwise(F.array().cast("array<string>")))
    blank = {"length": F.col("length"), "path": F.col("path"), "format": F.col("format"), "skip_reason": F.col("skip_reason"), "head_tokens": F.array().cast("array<string>"), "content_hash": F.lit(None).cast("string")}
    empty = lambda c: blank.get(c, F.lit(None).cast(kept.schema[c].dataType)).alias(c)
    left_out = judged.where("skip_reason IS NOT NULL").select(*[empty(c) for c in [*names, "skip_reason", "content_hash", "head_tokens"]])
    return kept.select(*names, "skip_reason", "content_hash", "head_tokens").unionByName(left_out)
