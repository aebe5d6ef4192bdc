"""What is shown of a book where its files' metadata says nothing: what their names and folders say, in a fixed order.

Titles: the vote, the name of the first file whose name isn't an artifact, with the natural or strict reading of it
before the whole; authors: the vote, the natural and the strict reading of a name, an author at its end, a folder, an
archive. A title loses its author's name at either end. What resolved claims say stands over all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import paths
from inkloom.functions.titles import canonical_author, is_artifact_title, is_placeholder_title
from inkloom.session import Scratch

#: Where a field comes from, the best first.
TITLE_SOURCES = ["claim", "metadata", "natural", "calibre", "name"]
AUTHOR_SOURCES = ["claim", "metadata", "natural", "calibre", "calibre_author", "folder", "archive"]


def readings(files: DataFrame) -> DataFrame:
    """Readings of each file's path (book_id, path, path_order): field, source, value; those that say nothing are out."""
    read = files.select("book_id", "path_order", paths.calibre("path").alias("c"), paths.natural("path").alias("n"), paths.title_from_path("path").alias("whole"), paths.calibre_author("path").alias("at_end"), paths.folder_author("path").alias("folder"), paths.archive_reading("path")["author"].alias("archive"))
    read = Scratch(files.sparkSession, "readings").save(read, "readings")
    said = lambda field, source, value: F.struct(F.lit(field).alias("field"), F.lit(source).alias("source"), value.alias("value"))
    name = F.when(~is_artifact_title("whole") & ~is_placeholder_title("whole"), F.col("whole")).otherwise("")
    every = F.array(
        said("title", "natural", F.col("n.title")), said("title", "calibre", F.col("c.title")), said("title", "name", name), said("author", "natural", canonical_author("n.author")), said("author", "calibre", F.col("c.author")),
        said("author", "calibre_author", F.col("at_end")), said("author", "folder", F.col("folder")), said("author", "archive", F.col("archive")),
    )
    return read.select("book_id", "path_order", F.inline(every)).where("value <> ''")


def book_fields(books: DataFrame, files: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """book_id, title, title_source, authors and author_source of books (book_id, title, authors, as voted) from their
    files (book_id, path, path_order) and, if given, resolved claims (book_id, title, authors); an empty title or list
    says nothing. Of equal sources the first file's counts; a book that nothing is known of has an empty title and list."""
    title_rank = F.array_position(F.array(*map(F.lit, TITLE_SOURCES)), F.col("source"))
    author_rank = F.array_position(F.array(*map(F.lit, AUTHOR_SOURCES)), F.col("source"))
    given = [("metadata", books)] + ([("claim", claimed)] if claimed is not None else [])
    named = readings(files)
    titles = named.where("field = 'title'").select("book_id", "path_order", "source", "value")
    authors = named.where("field = 'author'").select("book_id", "path_order", "source", F.array("value").alias("value"))
    for source, rows in given:
        titles = titles.unionByName(rows.where("title <> ''").select("book_id", F.lit(-1).cast(titles.schema["path_order"].dataType).alias("path_order"), F.lit(source).alias("source"), F.col("title").alias("value")))
        authors = authors.unionByName(rows.where(F.size("authors") > 0).select("book_id", F.lit(-1).cast(authors.schema["path_order"].dataType).alias("path_order"), F.lit(source).alias("source"), F.col("authors").alias("value")))
    first = lambda rows, rank, name: rows.groupBy("book_id").agg(F.min_by(F.struct("value", "source"), F.struct(rank, "path_order", "value")).alias(name))
    out = books.select("book_id").join(first(titles, title_rank, "t"), "book_id", "left").join(first(authors, author_rank, "a"), "book_id", "left")
    raw, who = F.coalesce("t.value", F.lit("")), F.coalesce("a.value", F.array().cast("array<string>"))
    out = out.select("book_id", raw.alias("raw"), F.coalesce("t.source", F.lit("")).alias("title_source"), who.alias("authors"), F.coalesce("a.source", F.lit("")).alias("author_source"))
    # titles of names and metadata may carry an author; claims were judged already
    washed = F.when(F.col("title_source") == "claim", F.col("raw")).otherwise(F.aggregate("authors", F.col("raw"), lambda t, a: F.when(t == F.col("raw"), paths.wash_author(t, a)).otherwise(t)))
    return out.select("book_id", washed.alias("title"), "title_source", "authors", "author_source")
