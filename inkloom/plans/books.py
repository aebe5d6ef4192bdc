"""Queries of what books are put together from: heads of texts, claims, attestation, washed titles and the fallback
chain, each with SQL. Files are made of the names of parts, so that each case of a rule is met many times."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import paths
from inkloom.operators import claims, enrich, fallback, headers, match, reports, votes
from inkloom.plans.catalog import query, table
from inkloom.session import Scratch
from inkloom.sources import dump


def _case(k, *values):
    out = F.lit(values[-1]) if isinstance(values[-1], str) else values[-1]
    for n, v in enumerate(values[:-1]):
        out = F.when(k == n, v).otherwise(out)
    return out


@query(
    "header_fields",
    """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' x' WHEN 2 THEN 'The ' || p_name WHEN 3 THEN upper(p_name) WHEN 4 THEN 'The ' || p_name WHEN 5 THEN 'The ' || p_name || ': A guide to ' || p_type ELSE '' END AS title,
    CASE p_partkey % 7 WHEN 0 THEN 'Ada Brook|Carl Stone' WHEN 2 THEN 'Ada Brook' WHEN 4 THEN 'Ada Brook' WHEN 5 THEN 'Ada Brook|Carl Stone' ELSE '' END AS authors FROM part""",
)
def header_fields(spark, sf_dir):
    p, name = table(spark, sf_dir, "part"), F.col("p_name")
    text = _case(
        F.col("p_partkey") % 7,
        F.concat(F.lit("Title: "), name, F.lit("\nAuthors: Ada Brook and Carl Stone\n\nIt began.")), F.concat(F.lit("---\ntitle: \""), name, F.lit(" x\"\n---\nSome Other\nAda Brook\n")), F.concat(F.lit("Copyright 2001\r\n\r\nThe "), name, F.lit("\r\nAda Brook\r\n\r\nIt began at night and it went on.\r\n")),
        F.concat(F.lit("*** START OF THE PROJECT GUTENBERG EBOOK "), F.upper("p_name"), F.lit(" ***\nAda Brook\n")), F.concat(F.lit("Ada Brook: The "), name, F.lit("\n")),
        F.concat(F.lit("The "), name, F.lit("\nA guide to "), F.col("p_type"), F.lit("\nAda Brook\nby Carl Stone\n© 2007\n")), F.concat(F.lit("It was late and nobody came to the door of the house where "), name, F.lit(" lay.\nAda Brook\n")),
    )
    found = headers.header_metadata(Scratch(spark, "claims").save(headers.header_claims(p.select("p_partkey", text.alias("text")), "p_partkey"), "claims"))
    out = p.select("p_partkey").join(found, F.col("file_id") == F.col("p_partkey"), "left")
    return out.select("p_partkey", F.coalesce("title", F.lit("")).alias("title"), F.array_join(F.coalesce("authors", F.array().cast("array<string>")), "|").alias("authors"))


@query(
    "attested_values",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'full' WHEN 1 THEN 'substring' WHEN 2 THEN 'partial' WHEN 3 THEN 'secondary' WHEN 4 THEN 'none' ELSE 'substring' END AS attested FROM part""",
)
def attested_values(spark, sf_dir):
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    value = _case(k, F.upper("p_name"), name, F.concat(F.lit("12 "), name), name, name, F.split("p_name", " ")[0])
    line = _case(k, F.concat(name, F.lit("!")), F.concat(F.lit("On "), name, F.lit(" again")), name, F.lit("nothing"), F.lit("nothing"), F.split("p_name", " ")[0])
    head = _case(k, F.lit(""), F.lit(""), F.lit(""), F.concat(F.lit("so "), F.array_join(F.reverse(F.split("p_name", " ")), " it was "), F.lit(" then")), F.lit("other words"), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", claims.attestation(value, F.array(F.lit("first"), line), head).alias("attested"))


_CLAIMS_SQL = """t AS (SELECT p_partkey AS file_id, 'title' AS field, p_name AS value, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 <> 0 THEN 'confirmed' WHEN p_partkey % 3 = 0 THEN 'attested' WHEN p_partkey % 4 <> 0 THEN 'supported' ELSE 'weak' END AS status, 0 AS cluster, true AS chosen, CASE WHEN p_partkey % 4 <> 0 THEN 2 ELSE 1 END AS support FROM part),
a AS (SELECT p_partkey, 'author', CASE WHEN p_partkey % 2 = 0 THEN 'Brook, Ada' ELSE 'Ada Brook' END, CASE WHEN p_partkey % 2 = 0 THEN 'confirmed' ELSE 'weak' END, 0, true, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END FROM part)"""


def _claims(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), "p_name")
    said = lambda field, value, source, at: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(source).alias("source"), F.lit(source).alias("set"), F.lit(0).alias("ordinal"), at.alias("attestation"))
    none, k = F.lit("none"), F.col("file_id")
    rows = F.array(
        said("title", F.col("p_name"), "metadata", F.when(k % 3 == 0, "full").otherwise("none")), F.when(k % 4 != 0, said("title", F.concat(F.lit("The "), F.col("p_name")), "filename", none)), said("title", F.lit("Untitled"), "folder", none),
        said("author", F.lit("Ada Brook"), "metadata", none), F.when(k % 2 == 0, said("author", F.lit("Brook, Ada"), "header", F.lit("full"))), said("author", F.lit("Unknown"), "filename", none), said("author", F.col("p_name"), "folder", none),
    )
    return p.select("file_id", F.inline(F.filter(rows, lambda r: r.isNotNull())))


@query("resolved_claims", f"WITH {_CLAIMS_SQL} SELECT * FROM t UNION ALL SELECT * FROM a")
def resolved_claims(spark, sf_dir):
    return claims.resolve(claims.prepare(_claims(spark, sf_dir)))


@query(
    "book_claims",
    """WITH c AS (SELECT p_partkey AS f, p_size AS book, p_name AS witness FROM part), w AS (SELECT book, witness, min(f) AS f FROM c GROUP BY 1, 2)
    SELECT book AS file_id, count(*) AS witnesses, sum(5 + (f % 4 <> 0)::INTEGER + (f % 2 = 0)::INTEGER)::BIGINT AS n FROM w GROUP BY 1""",
)
def book_claims(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_size").alias("book_id"), F.col("p_name").alias("content_hash"))
    of_books = claims.book_claims(_claims(spark, sf_dir), files)
    return of_books.groupBy("file_id").agg(F.count_distinct(F.regexp_extract("set", "^([0-9]+):", 1)).alias("witnesses"), F.count("*").alias("n"))


@query(
    "washed_titles",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN 'Ada Brook' WHEN 5 THEN p_name || ' - part' ELSE p_name END AS title FROM part""",
)
def washed_titles(spark, sf_dir):
    name = F.col("p_name")
    raw = _case(F.col("p_partkey") % 6, F.concat(F.lit("Ada Brook - "), name), F.concat(name, F.lit(" – Brook Ada")), F.concat(name, F.lit(" by Ada Brook")), name, F.lit("Ada Brook"), F.concat(name, F.lit(" - part")))
    return table(spark, sf_dir, "part").select("p_partkey", paths.wash_author(raw, F.lit("Brook, Ada")).alias("title"))


@query(
    "book_fallback",
    """SELECT p_partkey AS book_id, CASE p_partkey % 6 WHEN 0 THEN 'Voted ' || p_name WHEN 1 THEN 'The ' || p_name || ' it was' WHEN 2 THEN 'The ' || p_name WHEN 3 THEN p_name || ' over there' WHEN 4 THEN p_name ELSE 'Claimed' END AS title,
    CASE p_partkey % 6 WHEN 0 THEN 'metadata' WHEN 3 THEN 'name' WHEN 4 THEN 'metadata' WHEN 5 THEN 'claim' ELSE 'natural' END AS title_source,
    CASE p_partkey % 6 WHEN 0 THEN 'Voter One' WHEN 1 THEN 'Ada Brook' WHEN 2 THEN 'Ada Brook' WHEN 3 THEN 'Jane Austen' WHEN 4 THEN 'Ada Brook' ELSE 'Carl Stone' END AS authors,
    CASE p_partkey % 6 WHEN 0 THEN 'metadata' WHEN 3 THEN 'folder' WHEN 4 THEN 'metadata' WHEN 5 THEN 'archive' ELSE 'natural' END AS author_source FROM part""",
)
def book_fallback(spark, sf_dir):
    p, k, name = table(spark, sf_dir, "part"), F.col("p_partkey") % 6, F.col("p_name")
    no = F.array().cast("array<string>")
    title = _case(k, F.concat(F.lit("Voted "), name), F.lit(""), F.lit(""), F.lit(""), F.concat(name, F.lit(" - Ada Brook")), F.lit("Voted"))
    authors = F.when(k == 0, F.array(F.lit("Voter One"))).when(k == 4, F.array(F.lit("Ada Brook"))).otherwise(no)
    path = _case(
        k, F.lit("x/Ada Brook - Something it was.epub"), F.concat(F.lit("x/Ada Brook - The "), name, F.lit(" it was.epub")), F.concat(F.lit("x/"), name, F.lit(", The - Brook, Ada.epub")), F.concat(F.lit("lib/Jane_Austen/"), name, F.lit(" over there.txt")),
        F.lit("x/a.epub"), F.lit("lib/Carl Stone - Some old songs.zip!a.txt"),
    )
    books = p.select(F.col("p_partkey").alias("book_id"), title.alias("title"), authors.alias("authors"))
    files = p.select(F.col("p_partkey").alias("book_id"), path.alias("path"), F.lit(0).alias("path_order"))
    claimed = p.where(k == 5).select(F.col("p_partkey").alias("book_id"), F.lit("Claimed").alias("title"), no.alias("authors"))
    return fallback.book_fields(books, files, claimed).withColumn("authors", F.array_join("authors", "|"))


# enrichment from a dump: an edition for each part, a work for each size, an author for each brand


def _dump(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey < 1000")
    line = lambda kind, key, json: F.concat_ws("\t", F.lit(f"/type/{kind}"), key, F.lit("1"), F.lit("2020-01-01"), F.to_json(json))
    key = F.concat(F.lit("/books/"), "p_partkey")
    edition = F.struct(
        key.alias("key"), F.col("p_name").alias("title"), F.array(F.lit(" Bright Books :"), F.concat(F.lit("vol. "), F.col("p_size"))).alias("series"), F.array(F.struct(F.lit("/languages/eng").alias("key")), F.struct(F.lit("/languages/xxx").alias("key"))).alias("languages"),
        F.array(F.col("p_type"), F.lit("pier")).alias("publishers"), F.lit("May 3, 1999").alias("publish_date"), F.array(F.col("p_partkey").cast("string")).alias("oclc_numbers"), F.array(F.lit("Sea"), F.lit("river")).alias("subjects"),
        F.array(F.struct(F.concat(F.lit("/works/"), "p_size").alias("key"))).alias("works"),
    )
    editions = p.select(line("edition", key, edition).alias("value"))
    works = p.select("p_size").distinct().select(line("work", F.concat(F.lit("/works/"), "p_size"), F.struct(F.lit("A work").alias("title"), F.struct(F.lit("/type/text").alias("type"), F.concat(F.lit("About "), "p_size").alias("value")).alias("description"), F.array(F.lit("sea"), F.lit("Rope")).alias("subjects"), F.array(F.struct(F.struct(F.concat(F.lit("/authors/"), F.col("p_size") % 7).alias("key")).alias("author"))).alias("authors"))).alias("value"))
    authors = spark.range(7).select(line("author", F.concat(F.lit("/authors/"), "id"), F.struct(F.concat(F.lit("Author "), "id").alias("name"), F.lit("1900").alias("birth_date"))).alias("value"))
    return editions.unionByName(works).unionByName(authors).withColumn("line_no", F.monotonically_increasing_id())


_ENRICHED_SQL = """SELECT p_partkey AS book_id, '/works/' || p_size AS work_key, p_name AS title, 'About ' || p_size AS description, 'Bright Books' AS series, p_size::VARCHAR AS series_index, 'Sea,river,Rope' AS subjects, 'en' AS languages,
    p_type || ':1999-05-03,pier:1999-05-03' AS publications, 'OCLC:' || p_partkey AS identifiers, 'Author ' || (p_size % 7) AS authors FROM part WHERE p_partkey < 1000 AND p_partkey % 2 = 0"""


def _targets(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("book_id"), F.concat(F.lit("/books/"), "p_partkey").alias("edition_key"), F.lit("").alias("work_key"))


@query("enriched_editions", _ENRICHED_SQL)
def enriched_editions(spark, sf_dir):
    e = enrich.enrich(_targets(spark, sf_dir), Scratch(spark, "dump").save(dump.split_rows(_dump(spark, sf_dir)), "rows"))
    pairs = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a], x[b])), ",")
    return e.select(
        "book_id", "work_key", "title", "description", "series", "series_index", F.array_join("subjects", ",").alias("subjects"), F.array_join("languages", ",").alias("languages"), pairs("publications", "publisher", "publication_date").alias("publications"),
        pairs("identifiers", "scheme", "value").alias("identifiers"), F.array_join(F.transform("authors", lambda a: a["name"]), ",").alias("authors"),
    )


@query("missing_editions", "SELECT p_partkey AS book_id FROM part WHERE p_partkey % 2 = 0 AND p_partkey >= 1000")
def missing_editions(spark, sf_dir):
    targets = _targets(spark, sf_dir)
    found = enrich.enrich(targets, dump.split_rows(_dump(spark, sf_dir)))
    return enrich.missing(targets, found).select("book_id")


# authors and works of candidates: the customer is the book, the order the edition, the priority the work


def _found(spark, sf_dir):
    none = F.lit(None)
    first = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("book_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("edition_key"), F.col("o_orderpriority").alias("work_key"), (F.col("o_totalprice") / 1e6).alias("score"), none.cast("string").alias("isbn"), none.cast("int").alias("priority"),
        F.lit(0.5).alias("title_score"), F.lit(0.0).alias("author_score"), F.when(first <= "2", "Same").otherwise(F.col("o_orderpriority")).alias("edition_title"), F.lit("").alias("work_title"), F.array(F.concat(F.lit("A"), F.when(first == "2", "1").otherwise(first))).alias("author_keys"),
    )


@query(
    "resolved_authors",
    """SELECT o_custkey AS book_id, lpad(o_orderkey::VARCHAR, 12, '0') AS edition_key, CASE WHEN o_custkey % 3 = 2 THEN 0.0 WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CASE o_custkey % 3 WHEN 0 THEN 1.0 ELSE 0.5 END ELSE 0.0 END::DOUBLE AS author_score,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Kis Pál|Brook, Ada' WHEN o_orderpriority = '3-MEDIUM' THEN 'Carl Stone' ELSE '' END AS names FROM orders""",
)
def resolved_authors(spark, sf_dir):
    people = spark.createDataFrame([("A1", ["Kis Pál", "Brook, Ada"]), ("A3", ["Carl Stone"])], "author_key string, names array<string>")
    k = F.col("c_custkey") % 3
    tokens = F.when(k == 0, F.array(F.array(F.lit("ada"), F.lit("brook")))).when(k == 1, F.array(F.array(F.lit("brook")))).otherwise(F.array().cast("array<array<string>>"))
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), tokens.alias("author_tokens"))
    out = match.resolve_authors(_found(spark, sf_dir), people, books)
    return out.select("book_id", "edition_key", F.round("author_score", 6).alias("author_score"), F.array_join("author_names", "|").alias("names"))


@query(
    "folded_works",
    """WITH b AS (SELECT o_custkey AS book_id, o_orderpriority AS base, count(*) AS size, max(o_totalprice) AS s, arg_max(o_orderkey, o_totalprice * 1e9 - o_orderkey) AS e FROM orders GROUP BY 1, 2),
    h AS (SELECT book_id, arg_min(base, -size * 1e15 - s) AS head FROM b WHERE base IN ('1-URGENT', '2-HIGH') GROUP BY 1)
    SELECT o_custkey AS book_id, lpad(o_orderkey::VARCHAR, 12, '0') AS edition_key, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN head ELSE o_orderpriority END AS work_group FROM orders LEFT JOIN h ON h.book_id = o_custkey""",
)
def folded_works(spark, sf_dir):
    found = _found(spark, sf_dir).withColumn("author_names", F.array().cast("array<string>"))
    return match.work_groups(found).select("book_id", "edition_key", "work_group")


@query(
    "book_metadata",
    """WITH c AS (SELECT p_size, lower(p_name) AS k, count(*) AS n, min(p_partkey) AS o, arg_min(p_name, p_partkey) AS v FROM part GROUP BY 1, 2),
    t AS (SELECT p_size, v FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY n DESC, length(v) DESC, o) AS r FROM c) x WHERE r = 1),
    d AS (SELECT p_size, p_type AS k, count(*) AS n, min(p_partkey) AS o FROM part GROUP BY 1, 2), d2 AS (SELECT p_size, k FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY n DESC, length(k) DESC, o) AS r FROM d) x WHERE r = 1),
    s AS (SELECT p_size, p_type, min(p_partkey) AS o FROM part GROUP BY 1, 2), s2 AS (SELECT p_size, string_agg(p_type, '; ' ORDER BY o) AS subjects FROM s GROUP BY 1)
    SELECT p_size AS book_id, t.v AS title, d2.k AS description, subjects, 'en' AS languages FROM t JOIN d2 USING (p_size) JOIN s2 USING (p_size)""",
)
def book_metadata(spark, sf_dir):
    none = F.array().cast("array<struct<scheme:string,value:string,source:string>>")
    files = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("book_id"), F.col("p_partkey").alias("path_order"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.col("p_type").alias("description"), F.lit("").alias("publisher"), F.lit("").alias("publication_date"), F.lit("").alias("series"), F.lit("").alias("series_index"),
        F.array("p_type").alias("subjects"), F.array(F.lit("EN"), F.lit("und")).alias("languages"), none.alias("identifiers"),
    )
    out = votes.book_metadata(files)
    return out.select("book_id", "title", "description", F.array_join("subjects", "; ").alias("subjects"), F.array_join("languages", ",").alias("languages"))


@query(
    "enriched_report",
    """SELECT p_partkey AS book_id, CASE WHEN p_partkey < 1000 THEN p_name ELSE 'scanned ' || p_partkey END AS title, CASE WHEN p_partkey < 1000 THEN 'Author ' || (p_size % 7) ELSE 'Scanned One' END AS authors,
    CASE WHEN p_partkey < 1000 THEN 'ISBN:1|OCLC:' || p_partkey ELSE 'ISBN:1' END AS identifiers, CASE WHEN p_partkey < 1000 THEN 'en' ELSE 'hu' END AS languages, 'isbn' AS method FROM part WHERE p_partkey % 4 = 0""",
)
def enriched_report(spark, sf_dir):
    p, strings = table(spark, sf_dir, "part"), "array<string>"
    scanned = p.select(
        F.col("p_partkey").alias("book_id"), F.concat(F.lit("scanned "), "p_partkey").alias("title"), F.lit("").alias("description"), F.lit("").alias("series"), F.lit("").alias("series_index"), F.array(F.lit("Scanned One")).alias("authors"),
        F.array().cast(strings).alias("subjects"), F.array(F.lit("hu")).alias("languages"), F.array(F.struct(F.lit("ISBN").alias("scheme"), F.lit("1").alias("value"), F.lit("TEXT").alias("source"))).alias("identifiers"),
    )
    status = F.when(F.col("p_partkey") % 4 == 0, "confirmed").otherwise("probable")
    matches = p.select(F.col("p_partkey").alias("book_id"), status.alias("status"), F.lit(0.9).alias("confidence"), F.lit("isbn").alias("method"), F.concat(F.lit("/books/"), "p_partkey").alias("edition_key"), F.lit("").alias("work_key"))
    scratch = Scratch(spark, "dump")
    e = scratch.save(enrich.enrich(_targets(spark, sf_dir), scratch.save(dump.split_rows(_dump(spark, sf_dir)), "rows")), "enriched")
    out = reports.enriched_books(scanned, e, matches)
    ids = F.array_join(F.transform("identifiers", lambda i: F.concat_ws(":", i["scheme"], i["value"])), "|")
    return out.select("book_id", "title", F.array_join("authors", ",").alias("authors"), ids.alias("identifiers"), F.array_join("languages", ",").alias("languages"), F.col("match.method").alias("method"))
