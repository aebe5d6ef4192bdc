"""Catalog dumps: tab-separated rows (type, key, revision, last modified, JSON), landed as tables by record type."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions.text import let

EDITION = (
    "key string, title string, subtitle string, isbn_10 array<string>, isbn_13 array<string>, authors array<struct<key:string,author:struct<key:string>>>, works array<struct<key:string>>, "
    "publishers array<string>, publish_date string, series array<string>, languages array<struct<key:string>>, oclc_numbers array<string>, oclc_number array<string>, lccn array<string>, "
    "dewey_decimal_class array<string>, lc_classifications array<string>, ocaid string, identifiers map<string,array<string>>, subjects array<string>"
)
WORK = "key string, title string, subjects array<string>, first_publish_date string, authors array<struct<key:string,author:struct<key:string>>>"
AUTHOR = "key string, name string, personal_name string, alternate_names array<string>, birth_date string, death_date string"
SCHEMAS = {"/type/edition": EDITION, "/type/work": WORK, "/type/author": AUTHOR}


def split_rows(lines: DataFrame) -> DataFrame:
    """type, key, revision, last_modified, json and malformed of lines (value, line_no); blank lines are skipped, a
    carriage return at the end is dropped, and the fifth column keeps its tabs."""
    v = F.regexp_replace("value", r"\r$", "")
    parts = F.split(v, "\t", 5)
    rows = lines.where(F.trim(v) != "").withColumn("p", parts)
    return rows.select("line_no", *[F.when(F.size("p") == 5, F.col("p")[i]).alias(n) for i, n in enumerate(("type", "key", "revision", "last_modified", "json"))], (F.size("p") != 5).alias("malformed"))


def read_dump(spark: SparkSession, path: str, line_numbers: bool = True) -> DataFrame:
    """Rows of a dump file or folder, compressed or not. Line numbers follow the order of files and of lines within
    them: a compressed file is one partition, so its order is the dump's."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id() if line_numbers else F.lit(None).cast("long"))
    return split_rows(lines)


def land(rows: DataFrame, path: str) -> None:
    """Writes rows as Parquet by record type, so that each later pass reads one type and the columns it needs."""
    rows.where("NOT malformed").withColumn("kind", F.regexp_extract("type", "([a-z]+)$", 1)).write.partitionBy("kind").mode("overwrite").parquet(path)


def _typed(json: Column, schema: str) -> Column:
    return F.from_json(json, schema, {"mode": "PERMISSIVE"})


def json_text(json, name: str) -> Column:
    """A field that is a string or an object with a value."""
    raw = F.get_json_object(json, f"$.{name}")
    return F.coalesce(F.get_json_object(json, f"$.{name}.value"), F.when(~raw.rlike(r"^\s*[{\[]"), raw), F.lit(""))


def ref_keys(refs) -> Column:
    """Keys of author references, of the plain form or of the one nested in a work, each once."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(refs, F.array().cast("array<struct<key:string,author:struct<key:string>>>")), lambda r: F.coalesce(F.nullif(r["key"], F.lit("")), r["author"]["key"])), lambda k: k.isNotNull() & (k != "")))


def _sound(json: Column) -> Column:
    """Whether JSON is an object whose title, name and ISBNs are of their types."""

    def typed(v):
        is_kind = lambda field, kinds: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")).rlike(kinds), F.lit(True))
        text, texts = "^(STRING|VOID)$", "^(ARRAY<(STRING|VOID)>|VOID)$"
        return is_kind("title", text) & is_kind("name", text) & is_kind("isbn_13", texts) & is_kind("isbn_10", texts)

    return F.json_object_keys(json).isNotNull() & let(F.try_parse_json(json), typed)


def records(rows: DataFrame, kind: str) -> DataFrame:
    """line_no, key, r (the typed record) and json of rows of a type; the JSON's key wins over the row's. Rows whose
    JSON can't be read, or whose title or list of ISBNs is of another type, are malformed and left out."""
    schema = SCHEMAS[kind]
    own = rows.where((F.col("type") == kind) & ~F.col("malformed"))
    # Spark puts a row's own expressions in for its columns where it filters, so the JSON is named and parsed once
    typed = own.where(let("json", _sound)).withColumn("r", _typed(F.col("json"), schema))
    key = F.coalesce(F.nullif(F.col("r.key"), F.lit("")), F.col("key"))
    return typed.select("line_no", key.alias("key"), "r", "json")


def editions(rows: DataFrame) -> DataFrame:
    """What matching reads of editions: line_no, edition_key, title (or the subtitle), isbns, work_key, author_keys."""
    r = records(rows, "/type/edition")
    lists = [F.coalesce(F.col(f"r.{c}"), F.array().cast("array<string>")) for c in ("isbn_13", "isbn_10")]
    return r.select(
        "line_no", F.col("key").alias("edition_key"), F.coalesce(F.nullif(F.col("r.title"), F.lit("")), F.col("r.subtitle"), F.lit("")).alias("title"), F.concat(*lists).alias("isbns"),
        F.coalesce(F.get("r.works", F.lit(0))["key"], F.lit("")).alias("work_key"), ref_keys(F.col("r.authors")).alias("author_keys"),
    )


def works(rows: DataFrame) -> DataFrame:
    r = records(rows, "/type/work")
    return r.select(F.col("key").alias("work_key"), F.coalesce("r.title", F.lit("")).alias("title"), ref_keys(F.col("r.authors")).alias("author_keys"))


def authors(rows: DataFrame) -> DataFrame:
    r = records(rows, "/type/author")
    names = F.concat(F.array("r.name", "r.personal_name"), F.coalesce("r.alternate_names", F.array().cast("array<string>")))
    return r.select(F.col("key").alias("author_key"), F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != ""))).alias("names"))


def keyed(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is among the keys: a semi join, before any JSON is read."""
    return rows.join(keys.select(F.col(column).alias("key")).where("key <> ''").distinct(), "key", "left_semi")


@dataclass(frozen=True)
class DumpFile:
    family: str
    date: str
    path: str


def parse_name(path: str) -> DumpFile | None:
    """Family (editions, works, authors, or combined) and date of a dump's file name, None for other names."""
    m = re.fullmatch(r"ol_dump_(?:(editions|works|authors)_)?(latest|\d{4}-\d{2}-\d{2})\.txt(?:\.gz)?", path.rsplit("/", 1)[-1])
    return m and DumpFile(m[1] or "combined", m[2], path)


def newest(paths: list[str]) -> dict[str, DumpFile]:
    """Of each family, the newest file; ``latest`` is newer than any date."""
    out: dict[str, DumpFile] = {}
    for f in filter(None, map(parse_name, paths)):
        if f.family not in out or (f.date == "latest", f.date) > (out[f.family].date == "latest", out[f.family].date):
            out[f.family] = f
    return out


def list_dumps(spark: SparkSession, folder: str) -> dict[str, DumpFile]:
    """The newest dumps of a folder in any store that Spark reads; editions, works and authors may come from a combined
    dump."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = newest([s.getPath().toString() for s in fs.listStatus(path) if s.isFile() and s.getLen() > 0])
    if "combined" in found:
        for family in ("editions", "authors"):
            found.setdefault(family, found["combined"])
    return found


def dataset_version(files: dict[str, DumpFile]) -> str:
    """One string that changes with any of the files."""
    return ",".join(f"{k}={files[k].date}:{files[k].path.rsplit('/', 1)[-1]}" for k in sorted(files))
