"""Claims: what files say of a book's title and authors, how far the text attests it, and what is believed in the end.

A claim is (field, value, source, set, trust, ordinal); claims of one set were read together. File by file and book by
book, claims are clustered against the first of each cluster, in a fixed order; a book has few, so this is done in one
task for each. Attestation and the tests of equivalence are column expressions where they meet many rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import LEFTOVERS, NAME_PARTICLES, STOP_WORDS, phrase_in, title_key
from inkloom.functions.titles import author_claim_junk, is_suspicious, title_claim_junk

#: How much a source is worth, the most first.
SOURCES = ["metadata", "header", "title_page", "filename", "folder"]
STATUSES = ["conflicted", "weak", "supported", "attested", "confirmed"]
KIND = "file_id long, field string, value string, status string, cluster int, chosen boolean, support int"


def key(s: str) -> str:
    """The title key of text.py, for use within a group."""
    if s.isascii():
        return " ".join(re.sub("[^a-z0-9]+", " ", s.lower()).split())
    out, latin = [], False
    for ch in unicodedata.normalize("NFD", " ".join(s.split()).lower()):
        if unicodedata.category(ch) == "Mn" and latin:
            continue
        out.append(ch)
        latin = "LATIN" in unicodedata.name(ch, "")
    folded = unicodedata.normalize("NFC", "".join(out))
    for a, b in LEFTOVERS.items():
        folded = folded.replace(a, b)
    return " ".join("".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in folded).split())


def content(s: str) -> set[str]:
    return set(key(s).split()) - set(STOP_WORDS)


def same_title(a: str, b: str) -> bool:
    """Equal keys, or the one's content tokens within the other's, two at least, and the same numbers."""
    if key(a) == key(b):
        return key(a) != ""
    x, y = content(a), content(b)
    small, large = sorted((x, y), key=len)
    number = lambda t: {w for w in t if w.isdigit()}
    return len(small) >= 2 and small <= large and number(x) == number(y)


def same_author(a: str, b: str) -> bool:
    x, y = ({t for t in key(v).split() if len(t) > 2 and t not in NAME_PARTICLES} for v in (a, b))
    small, large = sorted((x, y), key=len)
    return bool(small) and small <= large


def window(text: Column, lines: int = 24, most: int = 8192) -> Column:
    """The short lines that a document opens with, up to the first that reads like running text."""
    every = F.filter(F.split(F.substring(text, 1, most), r"\r\n|\r|\n"), lambda l: F.trim(l) != "")
    body = F.transform(every, lambda l: (F.length(l) > 90) | ((F.size(F.split(F.trim(l), r"\s+")) >= 8) & l.rlike(r"[.!?]\s*$")))
    first = F.coalesce(F.nullif(F.array_position(body, True), F.lit(0).cast("long")), F.lit(lines + 1).cast("long"))
    return F.slice(every, 1, F.least(first - 1, F.lit(lines).cast("long")).cast("int"))


def attestation(value: Column, lines: Column, head: Column | None = None) -> Column:
    """How far a text holds a value: full (a line is it, two words at least), substring, partial (all but numbers in
    front), secondary (all its words later in the head), none."""
    k = title_key(value)
    keys = F.transform(lines, lambda l: title_key(l))
    words = F.size(F.split(k, " "))
    bare = F.regexp_replace(k, r"^(\p{N}+ )+", "")
    tokens = F.split(k, " ")
    later = F.lit(False) if head is None else F.forall(tokens, lambda t: phrase_in(t, title_key(head)))
    return (
        F.when(k == "", "none")
        .when((words >= 2) & F.array_contains(keys, k), "full")
        .when(F.exists(keys, lambda l: phrase_in(k, l)), "substring")
        .when((bare != k) & (bare != "") & F.exists(keys, lambda l: phrase_in(bare, l)), "partial")
        .when(later, "secondary")
        .otherwise("none")
    )


def prepare(claims: DataFrame) -> DataFrame:
    """Claims (file_id, field, value, source, set, ordinal, attestation) with junk marked and suspicious titles weak."""
    junk = F.when(F.col("field") == "title", title_claim_junk("value")).otherwise(author_claim_junk("value"))
    echo = claims.where("field = 'title'").select("file_id", title_key("value").alias("_t")).distinct()
    keyed = claims.withColumn("_k", title_key("value")).withColumn("junk", junk)
    echoes = echo.withColumnRenamed("_t", "_k").withColumn("_echo", F.lit(True))
    joined = keyed.join(echoes, ["file_id", "_k"], "left").withColumn("junk", F.col("junk") | ((F.col("field") == "author") & F.coalesce("_echo", F.lit(False))))
    attested = F.col("attestation").isin("full", "substring")
    return joined.withColumn("weak", (F.col("field") == "title") & is_suspicious("value", attested)).drop("_k", "_echo")


class _Claim(NamedTuple):
    file_id: int
    field: str
    value: str
    source: str
    set: str
    ordinal: int
    attestation: str
    junk: bool
    weak: bool

    @property
    def rank(self) -> int:
        return _RANK.get(self.source, len(SOURCES))

    @property
    def attested(self) -> bool:
        return self.attestation in ("full", "substring")


_NAMES = [c.split()[0] for c in KIND.split(", ")]
_RANK = {s: n for n, s in enumerate(SOURCES)}


def _status(cluster: list[_Claim]) -> str:
    strong = [r for r in cluster if not r.weak]
    several = len({r.source for r in strong}) > 1
    if any(r.attested for r in strong):
        return "confirmed" if several else "attested"
    return "supported" if several else "weak"


def _clusters(rows: list[_Claim]) -> Iterator[tuple]:
    """Rows as KIND says, of the claims of one file."""
    for field, test in (("title", same_title), ("author", same_author)):
        mine = [r for r in rows if r.field == field and r.value is not None and not r.junk]
        mine.sort(key=lambda r: (r.rank, r.set is None, r.set or "", r.ordinal is None, r.ordinal or 0, r.value))
        clusters: list[list[_Claim]] = []
        for r in mine:
            for c in clusters:
                if test(c[0].value, r.value):
                    c.append(r)
                    break
            else:
                clusters.append([r])
        verdicts = [_status(c) for c in clusters]
        sources = [len({r.source for r in c}) for c in clusters]
        best = max(range(len(clusters)), key=lambda n: (STATUSES.index(verdicts[n]), sources[n], -clusters[n][0].rank, -n), default=None)
        strong = sum(STATUSES.index(v) >= 2 for v in verdicts)
        for n, c in enumerate(clusters):
            shown = min(c, key=lambda r: (r.weak, not r.attested, r.rank, -len(r.value)))
            verdict = verdicts[n]
            if field == "title" and strong > 1 and n != best and verdict in ("attested", "confirmed", "supported"):
                verdict = "conflicted"
            yield shown.file_id, field, " ".join(shown.value.split()), verdict, n, n == best, sources[n]


def _claims_of(rows: pd.DataFrame) -> Iterator[_Claim]:
    return map(_Claim, *(rows[c].tolist() for c in _Claim._fields))


def _resolve(rows: pd.DataFrame) -> pd.DataFrame:
    """The clusters of one file's claims, as frames."""
    return pd.DataFrame([*_clusters([*_claims_of(rows)])], columns=_NAMES)


def in_stream(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Clusters of the files of sorted batches."""
    open_: list[_Claim] = []  # of the last file met, which may go on in the next batch
    for batch in batches:
        done: list[tuple] = []
        for file, rows in groupby(_claims_of(batch), itemgetter(0)):
            if open_ and open_[0].file_id != file:
                done += _clusters(open_)
                open_ = []
            open_ += rows
        if done:
            yield pd.DataFrame(done, columns=_NAMES)
    if open_ and (done := [*_clusters(open_)]):
        yield pd.DataFrame(done, columns=_NAMES)


def resolve(prepared: DataFrame) -> DataFrame:
    """Clusters of each file's title and author claims with their status, the chosen one marked. Rows are sorted within
    partitions and read as a stream, a file at a time, so that a partition makes one pass and no frame for each file."""
    ordered = prepared.where("file_id IS NOT NULL").select(*_Claim._fields).repartition("file_id").sortWithinPartitions("file_id")
    return ordered.mapInPandas(in_stream, KIND)


def book_claims(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Claims of files as claims of their books, for ``prepare`` and ``resolve``: file_id is the book's id. Files (file_id,
    book_id, content_hash) of one content are one witness, of which the first file's claims stay; a set is named by its
    file, so that two readings of one file's name stay apart."""
    known = files.select("file_id", "book_id", F.coalesce("content_hash", F.col("file_id").cast("string")).alias("witness"))
    first = known.groupBy("book_id", "witness").agg(F.min("file_id").alias("file_id")).select("file_id", "book_id")
    named = claims.join(first, "file_id").withColumn("set", F.concat_ws(":", F.col("file_id").cast("string"), "set"))
    return named.drop("file_id").withColumnRenamed("book_id", "file_id").select(*claims.columns)


def chosen(resolved: DataFrame) -> DataFrame:
    """book_id, title and authors that are believed: the chosen title, unless it is weak, and the authors' clusters that
    are attested, confirmed or supported."""
    title = F.max(F.when((F.col("field") == "title") & F.col("chosen") & (F.col("status") != "weak"), F.col("value")))
    names = F.sort_array(F.collect_list(F.when((F.col("field") == "author") & F.col("status").isin("attested", "confirmed", "supported"), F.struct("cluster", "value"))))
    return resolved.groupBy(F.col("file_id").alias("book_id")).agg(F.coalesce(title, F.lit("")).alias("title"), F.transform(names, lambda n: n["value"]).alias("authors"))


def grouping_suspects(resolved: DataFrame) -> DataFrame:
    """file_id (or book) of those with a second title that isn't weak and no truncation of the first."""
    titles = resolved.where("field = 'title' AND status <> 'weak'")
    return titles.groupBy("file_id").agg(F.count("*").alias("n")).where("n > 1").select("file_id")
