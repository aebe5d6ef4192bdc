"""Reports as nested rows, ordered for reading, and their JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped_books(books: DataFrame, files: DataFrame) -> DataFrame:
    """Books (book_id and metadata) with their files (book_id, path, …), by title and first path."""
    rest = [c for c in files.columns if c not in ("book_id", "path")]
    listed = files.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("path", *rest))).alias("files"))
    return books.join(listed, "book_id").orderBy("title", F.col("files")[0]["path"])


def requested_books(report: DataFrame, ids: DataFrame, column: str = "book_id") -> DataFrame:
    """Report rows of the ids asked for (id column and position ``pos``), in that order, each once; unknown ids are
    skipped."""
    first = ids.groupBy(column).agg(F.min("pos").alias("_pos"))
    return report.join(first, column).orderBy("_pos").drop("_pos")


def duplicates(canonical: DataFrame, copies: DataFrame) -> DataFrame:
    """path of a canonical file and the paths that repeat it."""
    return canonical.join(copies, "content_hash").groupBy("path").agg(F.sort_array(F.collect_list("duplicate_path")).alias("duplicates")).orderBy("path")


def _filled(new: Column, old: Column) -> Column:
    return F.when(F.coalesce(new, F.lit("")) != "", new).otherwise(old)


def enriched_books(books: DataFrame, enrichment: DataFrame, matches: DataFrame) -> DataFrame:
    """Confirmed books: a field that the catalog has stands over what was scanned; identifiers are those of both,
    scanned ones first, each once by scheme and value."""
    ok = matches.where("status = 'confirmed'").select("book_id", "confidence", "method", "edition_key", "work_key")
    e = enrichment.select("book_id", *[F.col(c).alias(f"e_{c}") for c in ("title", "description", "series", "series_index", "subjects", "languages", "publications", "identifiers", "authors")])
    j = books.join(ok, "book_id").join(e, "book_id", "left")
    lists = lambda a, b: F.when(F.size(F.coalesce(F.col(a), F.array())) > 0, F.col(a)).otherwise(F.col(b))
    scanned = F.transform("identifiers", lambda i: F.struct(i["scheme"].alias("scheme"), i["value"].alias("value")))
    names = F.transform("e_authors", lambda a: a["name"])
    return j.select(
        "book_id", *[_filled(F.col(f"e_{c}"), F.col(c)).alias(c) for c in ("title", "description", "series", "series_index")],
        F.when(F.size(F.coalesce(names, F.array())) > 0, names).otherwise(F.col("authors")).alias("authors"),
        *[lists(f"e_{c}", c).alias(c) for c in ("subjects", "languages")], F.array_distinct(F.concat(scanned, F.coalesce("e_identifiers", F.array().cast("array<struct<scheme:string,value:string>>")))).alias("identifiers"),
        F.struct("confidence", "method", "edition_key", "work_key").alias("match"),
    ).orderBy("title", "book_id")


STATUSES = ["ambiguous", "needs_review", "probable", "not_found", "no_data"]


def review(matches: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Books that aren't confirmed, by status; the reason of a conflict stands over that of the review."""
    worst = conflicts.groupBy("book_id").agg(F.min(F.struct(F.when(F.col("reason") == "metadata_content_mismatch", 0).otherwise(1).alias("o"), "reason"))["reason"].alias("conflict"))
    rows = matches.where(F.col("status") != "confirmed").join(worst, "book_id", "left").withColumn("review_reason", F.coalesce("conflict", "review_reason")).drop("conflict")
    order = F.coalesce(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), F.lit(99))
    return rows.orderBy(order, "book_id")


def library_counts(books: DataFrame, title: str, author: str) -> DataFrame:
    """n_books, n_titles and n_authors of a library, in one pass."""
    return books.agg(F.count("*").alias("n_books"), F.count_distinct(title).alias("n_titles"), F.count_distinct(author).alias("n_authors"))


def identified_books(*sources: DataFrame) -> DataFrame:
    """How many books (the first column of each source) any of the sources knows, each once."""
    ids = [s.select(F.col(s.columns[0]).alias("k")) for s in sources]
    every = ids[0]
    for more in ids[1:]:
        every = every.unionByName(more)
    return every.distinct().agg(F.count("*").alias("n"))


def joined_names(books: DataFrame, names: DataFrame, key: str, name: str, separator: str = ", ") -> DataFrame:
    """key and all its distinct names in order as one string; null where a book has none."""
    listed = names.where(F.col(name).isNotNull()).select(key, name).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(name)), separator).alias(name))
    return books.select(key).distinct().join(listed, key, "left")


def file_totals(books: DataFrame, files: DataFrame, key: str, amount: str) -> DataFrame:
    """Books with the number of their files and the sum of an amount; files are added up before they are joined."""
    per_book = files.groupBy(key).agg(F.count("*").alias("n_files"), F.sum(amount).alias("total"))
    return books.join(per_book, key, "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))


def status_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("status").agg(F.count("*").alias("books")).orderBy("status")


def scan_counts(parsed: DataFrame) -> DataFrame:
    """found, parsed, failed and skipped of parsed rows (error, skip_reason)."""
    failed, skipped = F.col("error").isNotNull(), F.col("error").isNull() & F.col("skip_reason").isNotNull()
    return parsed.agg(F.count("*").alias("found"), F.count_if(~failed & ~skipped).alias("parsed"), F.count_if(failed).alias("failed"), F.count_if(skipped).alias("skipped"))


def skips(parsed: DataFrame) -> DataFrame:
    """path and reason of files that were left out, by path; failed ones are not among them."""
    return parsed.where(F.col("error").isNull() & F.col("skip_reason").isNotNull()).select("path", F.col("skip_reason").alias("reason")).orderBy("path")


def console_lines(found: DataFrame, files: DataFrame) -> DataFrame:
    """book_id and a block of text of each book found (book_id, title, authors): ``Authors: Title`` and its files
    (book_id, path), a line each, indented."""
    listed = files.groupBy("book_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("path")), lambda p: F.concat(F.lit("\n  "), p)), "").alias("lines"))
    who = F.array_join("authors", ", ")
    head = F.when(who == "", F.col("title")).otherwise(F.concat_ws(": ", who, "title"))
    return found.join(listed, "book_id", "left").select("book_id", F.concat(head, F.coalesce("lines", F.lit(""))).alias("block"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, in their order; fields that are null are left out."""
    rows.write.mode("overwrite").json(path)


def write_buckets(rows: DataFrame, path: str, bucket: str = "status") -> None:
    """Rows as JSON lines, a folder for each value of a column."""
    rows.write.mode("overwrite").partitionBy(bucket).json(path)


def write_json_array(rows: DataFrame, path: str, when_empty: bool = True) -> bool:
    """One indented JSON array in a file of any store that Spark writes to, streamed row by row through the driver;
    whether a file was written."""
    import json

    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = None

    def put(text: str) -> None:
        nonlocal out
        if out is None:
            out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(text.encode()))

    try:
        first = True
        for (line,) in rows.select(F.to_json(F.struct("*"))).toLocalIterator():
            item = "\n".join("  " + x for x in json.dumps(json.loads(line), indent=2, ensure_ascii=False).split("\n"))
            put(("[\n" if first else ",\n") + item)
            first = False
        if not first:
            put("\n]\n")
        elif when_empty:
            put("[]\n")
    finally:
        if out is not None:
            out.close()
    return out is not None
