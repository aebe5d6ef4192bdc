"""What the external catalog adds to confirmed books: one enrichment for each, from its edition, work and authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.dates import dump_date, marc_language
from inkloom.functions.identifiers import isbn13
from inkloom.sources.dump import json_text, keyed, records, ref_keys

STRINGS = "array<string>"
INDEX = r"(?i)^(?:v\.?|vol\.?|volume|no\.?|number|pt\.?|part|bd\.?|band)?\s*(\d+(?:\s*[-–]\s*\d+)?)$"


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(STRINGS))


def unique(values: Column) -> Column:
    """Trimmed values that aren't empty, each once whatever its case, in the order met."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    lower = F.transform(clean, lambda v: F.lower(v))
    return F.filter(clean, lambda v, i: F.array_position(lower, F.lower(v)) == i + 1)


def series_of(values: Column) -> Column:
    """name and number of a list of series statements: the first is the name, the next that is a number the number."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    rest = F.filter(F.slice(clean, 2, 1000), lambda v: v.rlike(INDEX))
    name = F.coalesce(F.trim(F.rtrim(F.get(clean, F.lit(0)), F.lit(" ;:,"))), F.lit(""))
    number = F.coalesce(F.replace(F.regexp_extract(F.get(rest, F.lit(0)), INDEX, 1), F.lit(" "), F.lit("")), F.lit(""))
    return F.struct(name.alias("series"), number.alias("series_index"))


def identifiers_of() -> Column:
    """All identifiers of an edition record ``r``: ISBNs in 13 digits, numbers of libraries, then others by scheme."""
    make = lambda scheme, values: F.transform(values, lambda v: F.struct(F.lit(scheme).alias("scheme"), F.trim(v).alias("value")))
    isbns = make("ISBN", F.filter(F.transform(F.concat(_list("r.isbn_10"), _list("r.isbn_13")), lambda v: isbn13(v)), lambda v: v.isNotNull()))
    numbers = [make(s, _list(f"r.{f}")) for s, f in (("OCLC", "oclc_numbers"), ("OCLC", "oclc_number"), ("LCCN", "lccn"), ("DEWEY", "dewey_decimal_class"), ("LC", "lc_classifications"))]
    archive = make("OCAID", F.array(F.coalesce("r.ocaid", F.lit(""))))
    entries = F.array_sort(F.map_entries(F.coalesce("r.identifiers", F.create_map().cast("map<string,array<string>>"))))
    others = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda v: F.struct(F.upper(F.trim(e["key"])).alias("scheme"), F.trim(v).alias("value")))))
    return F.array_distinct(F.filter(F.concat(isbns, *numbers, archive, others), lambda x: (x["value"] != "") & (x["scheme"] != "")))


def publications_of() -> Column:
    date = dump_date(F.coalesce("r.publish_date", F.lit("")))
    publishers = unique(_list("r.publishers"))
    publishers = F.when((F.size(publishers) == 0) & (date != ""), F.array(F.lit(""))).otherwise(publishers)
    return F.transform(publishers, lambda p: F.struct(p.alias("publisher"), date.alias("publication_date")))


def enrich(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each confirmed target (book_id, edition_key, work_key) whose edition the dump's rows hold. Only the
    keys asked for are parsed: editions first, then their works, then the authors of either."""
    editions = records(keyed(rows, targets, "edition_key"), "/type/edition")
    e = editions.select(
        F.col("key").alias("edition_key"), F.coalesce(F.get("r.works", F.lit(0))["key"], F.lit("")).alias("e_work"), F.coalesce("r.title", F.lit("")).alias("e_title"), F.coalesce("r.subtitle", F.lit("")).alias("subtitle"),
        json_text("json", "description").alias("e_description"), _list("r.subjects").alias("e_subjects"), series_of(_list("r.series")).alias("s"),
        F.array_distinct(F.filter(F.transform(F.coalesce("r.languages", F.array().cast("array<struct<key:string>>")), lambda l: marc_language(l["key"])), lambda l: l != "")).alias("languages"),
        publications_of().alias("publications"), identifiers_of().alias("identifiers"), ref_keys(F.col("r.authors")).alias("e_authors"),
    )
    base = targets.select("book_id", "edition_key").join(e, "edition_key")
    works = records(keyed(rows, base, "e_work"), "/type/work").select(
        F.col("key").alias("work_key"), F.coalesce("r.title", F.lit("")).alias("w_title"), json_text("json", "description").alias("w_description"), _list("r.subjects").alias("w_subjects"),
        F.coalesce("r.first_publish_date", F.lit("")).alias("first_publish_date"), ref_keys(F.col("r.authors")).alias("w_authors"),
    )
    j = base.join(works, F.col("e_work") == F.col("work_key"), "left")
    j = j.withColumn("author_keys", F.when(F.size("e_authors") > 0, F.col("e_authors")).otherwise(F.coalesce("w_authors", F.array().cast(STRINGS))))
    asked = j.select("book_id", F.posexplode("author_keys").alias("pos", "author_key"))
    people = records(keyed(rows, asked, "author_key"), "/type/author").select(
        F.col("key").alias("author_key"), F.coalesce(F.nullif(F.col("r.name"), F.lit("")), F.col("r.personal_name"), F.lit("")).alias("name"), unique(_list("r.alternate_names")).alias("alternate_names"),
        F.trim(F.coalesce("r.birth_date", F.lit(""))).alias("birth_date"), F.trim(F.coalesce("r.death_date", F.lit(""))).alias("death_date"), json_text("json", "bio").alias("bio"),
    )
    listed = asked.join(people, "author_key").groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("pos", "author_key", "name", "alternate_names", "birth_date", "death_date", "bio"))).alias("authors"))
    j = j.join(listed, "book_id", "left")
    has = lambda a, b: F.when(F.coalesce(F.col(a), F.lit("")) != "", F.col(a)).otherwise(F.coalesce(F.col(b), F.lit("")))
    return j.select(
        "book_id", "edition_key", has("work_key", "e_work").alias("work_key"), has("e_title", "w_title").alias("title"), "subtitle", has("w_description", "e_description").alias("description"),
        F.col("s.series").alias("series"), F.col("s.series_index").alias("series_index"), F.coalesce("first_publish_date", F.lit("")).alias("first_publish_date"),
        unique(F.concat("e_subjects", _coalesced("w_subjects"))).alias("subjects"), "languages", "publications", "identifiers",
        F.transform(F.coalesce("authors", F.array().cast("array<struct<pos:int,author_key:string,name:string,alternate_names:array<string>,birth_date:string,death_date:string,bio:string>>")), lambda a: a.dropFields("pos")).alias("authors"),
    )


def _coalesced(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(STRINGS))


def missing(targets: DataFrame, enriched: DataFrame) -> DataFrame:
    """Targets whose edition the dump doesn't hold."""
    return targets.join(enriched.select("book_id"), "book_id", "left_anti")
