"""Linkage from dump lines to decisions, claims, reports, archives and incremental scans, on hand-built rows."""

import bz2
import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from inkloom.operators import claims, enrich, match, reports, tables
from inkloom.sources import dump, files, parsers
from inkloom.streaming import incremental

BOOK = "book_id long, title string, authors array<string>, identifiers array<struct<scheme:string,value:string,source:string>>, head_tokens array<string>"


def line(kind, key, data):
    return f"/type/{kind}\t{key}\t1\t2024-01-31\t{json.dumps(data) if isinstance(data, dict) else data}"


@pytest.fixture(scope="module")
def rows(spark):
    lines = [
        line("edition", "/books/1", {"key": "/books/1", "title": "The Quiet River", "isbn_10": ["0306406152"], "works": [{"key": "/works/1"}], "authors": [{"key": "/authors/1"}], "publishers": ["North"], "publish_date": "May 2001", "languages": [{"key": "/languages/eng"}], "series": ["Rivers ;", "vol. 3"], "oclc_numbers": ["77"], "identifiers": {"goodreads": ["5"]}, "description": {"type": "t", "value": "An edition"}}),
        line("edition", "/books/2", {"title": "Quiet River of Stones", "works": [{"key": "/works/2"}], "authors": []}),
        line("edition", "/books/3", {"key": "/books/3", "title": "", "subtitle": "Lonely Mountain Song", "works": [{"key": "/works/3"}]}),
        line("edition", "/books/4", {"title": 5}),
        line("edition", "/books/5", "{broken"),
        "too\tfew",
        "   ",
        line("work", "/works/1", {"key": "/works/1", "title": "The Quiet River", "description": "A work", "subjects": ["Water", "water", "Stones"]}) + "\r",
        line("work", "/works/2", {"key": "/works/2", "title": "Quiet River of Stones", "authors": [{"author": {"key": "/authors/2"}}]}),
        line("work", "/works/3", {"key": "/works/3", "title": "Lonely Mountain Song", "authors": [{"author": {"key": "/authors/2"}}]}),
        line("author", "/authors/1", {"key": "/authors/1", "name": "Ada Brook", "alternate_names": ["A. Brook"], "bio": "wrote"}),
        line("author", "/authors/2", {"key": "/authors/2", "name": "Ben Cliff"}),
    ]
    return dump.split_rows(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")).cache()


def test_dump_rows(rows):
    assert rows.count() == 11 and rows.where("malformed").count() == 1
    editions = {r["edition_key"]: r for r in dump.editions(rows).collect()}
    assert sorted(editions) == ["/books/1", "/books/2", "/books/3"]
    assert editions["/books/3"]["title"] == "Lonely Mountain Song" and editions["/books/1"]["author_keys"] == ["/authors/1"]
    assert {r["work_key"]: r["author_keys"] for r in dump.works(rows).collect()}["/works/2"] == ["/authors/2"]


def test_dump_names():
    names = ["x/ol_dump_editions_2024-01-31.txt.gz", "x/ol_dump_editions_latest.txt.gz", "x/ol_dump_2023-01-01.txt", "x/other.txt"]
    found = dump.newest(names)
    assert found["editions"].date == "latest" and found["combined"].date == "2023-01-01" and len(found) == 2


def test_matching(spark, rows):
    isbn = lambda v, s: {"scheme": "ISBN", "value": v, "source": s}
    books = spark.createDataFrame(
        [
            (1, "The quiet river", ["Brook, Ada"], [isbn("978-0-306-40615-7", "METADATA")], ["quiet", "river"]),
            (2, "Quiet River of Stone", ["Ben Cliff"], [], []),
            (3, "Lonely Mountain Song", ["Ben Cliff"], [], ["lonely", "mountain", "song", "ben", "cliff"]),
            (4, "Nothing Alike", ["Nobody"], [], []),
            (5, "", [], [], []),
        ],
        BOOK,
    )
    got = {r["book_id"]: r for r in match.match(books, dump.editions(rows), dump.works(rows), dump.authors(rows)).collect()}
    assert (got[1]["status"], got[1]["edition_key"], got[1]["method"]) == ("confirmed", "/books/1", "isbn+content")
    assert got[2]["edition_key"] == "/books/2" and got[2]["status"] in ("probable", "needs_review")
    assert (got[3]["status"], got[3]["method"], got[3]["work_key"]) == ("confirmed", "title_exact", "/works/3")
    assert (got[4]["status"], got[5]["status"]) == ("not_found", "no_data")


def test_strong_hit_retires_a_book(spark):
    books = match.prepare_books(spark.createDataFrame([(1, "Quiet River", [], [{"scheme": "ISBN", "value": "0306406152", "source": "METADATA"}], [])], BOOK))
    e = [(1, "E1", "Quiet River", []), (2, "E2", "Quiet River", ["0306406152"]), (3, "E3", "Quiet River", [])]
    editions = match.prepare_editions(spark.createDataFrame([(*x, "", []) for x in e], "line_no long, edition_key string, title string, isbns array<string>, work_key string, author_keys array<string>"))
    keys = lambda o: sorted(r["edition_key"] for r in match.candidates(books, editions, o).collect())
    assert keys(match.Options()) == ["E1", "E2"] and keys(match.Options(dump_order=False)) == ["E1", "E2", "E3"]


def test_enrichment(spark, rows):
    targets = spark.createDataFrame([(1, "/books/1", "/works/1"), (3, "/books/3", ""), (9, "/books/9", "")], "book_id long, edition_key string, work_key string")
    out = enrich.enrich(targets, rows)
    got = {r["book_id"]: r for r in out.collect()}
    one = got[1]
    assert sorted(got) == [1, 3] and enrich.missing(targets, out).first()["book_id"] == 9
    assert (one["title"], one["description"], one["series"], one["series_index"], one["subjects"], one["languages"]) == ("The Quiet River", "A work", "Rivers", "3", ["Water", "Stones"], ["en"])
    assert [tuple(i) for i in one["identifiers"]] == [("ISBN", "9780306406157"), ("OCLC", "77"), ("GOODREADS", "5")]
    assert one["authors"][0]["name"] == "Ada Brook" and one["publications"][0]["publication_date"] == "2001-05"
    assert got[3]["title"] == "Lonely Mountain Song" and got[3]["authors"][0]["name"] == "Ben Cliff"


def test_attestation(spark):
    window = ["The Quiet River", "by Ada Brook", "3 Songs"]
    cases = ["The Quiet River", "Ada Brook", "7 Quiet River", "Lost", ""]
    df = spark.createDataFrame([(c, window, "far lost words") for c in cases], "v string, w array<string>, h string")
    got = [r[0] for r in df.select(claims.attestation(F.col("v"), F.col("w"), F.col("h"))).collect()]
    assert got == ["full", "substring", "partial", "secondary", "none"]


def test_claims(spark):
    rows = [
        (1, "title", "The Quiet River", "metadata", "m", 0, "full"), (1, "title", "The Quiet River, Part of Stones", "filename", "f", 0, "none"), (1, "title", "untitled", "header", "h", 0, "none"),
        (1, "author", "Ada Brook", "metadata", "m", 1, "substring"), (1, "author", "Brook, Ada", "filename", "f", 1, "none"), (1, "author", "The Quiet River", "folder", "d", 0, "none"),
        (2, "title", "One Thing", "metadata", "m", 0, "full"), (2, "title", "Other Matter", "header", "h", 0, "full"),
    ]
    df = spark.createDataFrame(rows, "file_id long, field string, value string, source string, set string, ordinal int, attestation string")
    out = claims.resolve(claims.prepare(df))
    chosen = {(r["file_id"], r["field"]): (r["value"], r["status"]) for r in out.where("chosen").collect()}
    assert chosen[1, "author"] == ("Ada Brook", "confirmed") and chosen[1, "title"] == ("The Quiet River", "confirmed")
    assert [r["file_id"] for r in claims.grouping_suspects(out).collect()] == [2]


def test_archives_and_parsers(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/b.txt", "text b")
        z.writestr("skip.xyz", "no")
    outer = io.BytesIO()
    with tarfile.open(fileobj=outer, mode="w:gz") as t:
        for name, body in (("in.zip", inner.getvalue()), ("a.rtf", rb"{\rtf1\ansicpg1252{\info{\title A Book}{\author Ada; Ben}}Caf\'e9 \u8364?\par{\v hidden}end}")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.tar.gz").write_bytes(outer.getvalue())
    (tmp_path / "c.txt.gz").write_bytes(gzip.compress("árvíz".encode("cp1250")))
    (tmp_path / "d.txt.bz2").write_bytes(bz2.compress("plain".encode("utf-16")))
    (tmp_path / "e.zip").write_bytes(b"broken")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    found = files.expand(files.walk(spark, f"file://{tmp_path}", content=True))
    got = {r["path"].rsplit("/", 1)[-1] if "!" not in r["path"] else r["path"].split("/")[-1 if "deep" not in r["path"] else -2] + ("" if "deep" not in r["path"] else "/b"): r for r in parsers.parse(found).collect()}
    texts = sorted(r["text"] for r in got.values() if r["error"] is None)
    assert texts == sorted(["text b", "Café €\nend", "árvíz", "plain"])
    rtf = next(r for r in got.values() if r["title"])
    assert rtf["title"] == "A Book" and rtf["authors"] == ["Ada", "Ben"]
    assert parsers.failures(parsers.parse(found)).count() == 2
    assert files.expand(files.walk(spark, f"file://{tmp_path}/sub", content=True), max_depth=1).where("error IS NOT NULL").count() == 1


def test_incremental_scan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a")
    seen = []
    handle = lambda df, n: seen.extend(r["path"].rsplit("/", 1)[-1] for r in df.select("path").collect())
    for name in ("b.txt", "c.doc", "d.epub"):
        incremental.follow(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/ckpt", handle).awaitTermination()
        (tmp_path / "in" / name).write_text(name)
    incremental.follow(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/ckpt", handle).awaitTermination()
    assert sorted(seen) == ["a.txt", "b.txt", "d.epub"]
    done = spark.createDataFrame([(f"file:{tmp_path}/in/a.txt",)], "path string")
    assert incremental.new_files(spark, f"file://{tmp_path}/in", done).count() == 2


def test_tables_and_reports(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "k long, v string")
    assert sorted(map(tuple, tables.insert_ignore(old, new, ["k"], "v").collect())) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(map(tuple, tables.upsert(old, new.where("v <> 'y'"), ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "z")]
    books = spark.createDataFrame([(1, "B"), (2, "A")], "book_id long, title string")
    held = spark.createDataFrame([(1, "p2"), (1, "p1"), (2, "p3")], "book_id long, path string")
    report = reports.grouped_books(books, held)
    assert [(r["title"], [f["path"] for f in r["files"]]) for r in report.collect()] == [("A", ["p3"]), ("B", ["p1", "p2"])]
    ids = spark.createDataFrame([(1, 0), (9, 1), (2, 2), (1, 3)], "book_id long, pos int")
    assert [r["book_id"] for r in reports.requested_books(report, ids).collect()] == [1, 2]


def test_tokens_of_names_are_made_before_the_join(spark):
    found = spark.createDataFrame([(1, "E1", ["A1", "A2"], 0.5, None, None), (2, "E1", ["A1"], 0.5, None, None), (3, "E2", [], 0.5, None, None)], "book_id long, edition_key string, author_keys array<string>, title_score double, isbn string, priority int")
    authors = spark.createDataFrame([("A1", ["Kis Pál", ""]), ("A2", ["Brook, Ada"])], "author_key string, names array<string>")
    books = spark.createDataFrame([(1, [["ada", "brook"], ["other"]]), (2, [["pal"]]), (3, [["ada"]])], "book_id long, author_tokens array<array<string>>")
    out = match.resolve_authors(found.withColumn("author_score", F.lit(0.0)), authors, books)
    assert {r["book_id"]: (r["author_score"], r["author_names"]) for r in out.collect()} == {1: (1.0, ["Kis Pál", "Brook, Ada"]), 2: (0.5, ["Kis Pál"]), 3: (0.0, [])}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Relation" if "Relation" in plan else "LogicalRDD")]
    assert "_tokens" in plan and "translate" not in above.split("Join")[0]


def test_json_of_a_dump_is_named_few_times(spark):
    rows = dump.split_rows(spark.createDataFrame([("/type/edition\t/books/1\t1\t2\t{\"key\": \"/books/1\", \"title\": \"A\"}", 1), ("/type/edition\t/books/2\t1\t2\t{\"title\": 5}", 2), ("/type/edition\t/books/3\t1\t2\t[1]", 3)], "value string, line_no long"))
    out = dump.editions(rows)
    assert [(r["line_no"], r["title"]) for r in out.collect()] == [(1, "A")]
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") + out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 2
