"""Books from their files: claims, the fallback chain, repaired paths, runs, backfills, reports and downloads."""

import http.server
import os
import threading

import pytest
from pyspark.sql import functions as F

from inkloom.functions import paths, text
from inkloom.operators import claims, fallback, quality, reports, tables
from inkloom.sources import download, files

CLAIMS = "file_id long, field string, value string, source string, set string, ordinal int, attestation string"


def claim_rows():
    out = []
    for i in range(60):
        out += [(i, "title", "The Quiet River", "metadata", "m", 0, "full" if i % 3 == 0 else "none"), (i, "title", "Quiet River", "filename", "f", 0, "none"), (i, "author", "Ada Brook", "metadata", "m", 0, "none")]
        if i % 4 == 0:
            out += [(i, "title", "Another Book", "header", "h", 0, "substring"), (i, "author", "Brook, Ada", "header", "h", 0, "full"), (i, "author", "Unknown", "filename", "f", 0, "none")]
    return out


def test_claims_are_resolved_in_a_stream(spark):
    rows = claims.prepare(spark.createDataFrame(claim_rows(), CLAIMS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # files go over the ends of batches
    try:
        got = {tuple(r) for r in claims.resolve(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = set()
    for _, g in rows.toPandas().groupby("file_id"):
        expected |= {tuple(r) for r in claims._resolve(g).itertuples(index=False)}
    assert {tuple(str(x) for x in r) for r in got} == {tuple(str(x) for x in r) for r in expected} and len(got) > 100
    by = {(r[0], r[1], r[2]): r[3] for r in got}
    assert by[0, "title", "Another Book"] in ("conflicted", "attested") and by[1, "title", "The Quiet River"] == "supported" and by[4, "author", "Brook, Ada"] == "confirmed"


def test_book_claims_count_a_content_once(spark):
    rows = [(1, "title", "A River", "metadata", "m", 0, "none"), (2, "title", "A River", "metadata", "m", 0, "none"), (3, "title", "The Sea", "filename", "f", 0, "none"), (3, "author", "Ada Brook", "metadata", "m", 0, "full")]
    held = spark.createDataFrame([(1, 10, "x"), (2, 10, "x"), (3, 10, "y"), (4, 11, None)], "file_id long, book_id long, content_hash string")
    of_books = claims.book_claims(spark.createDataFrame(rows, CLAIMS), held)
    assert sorted((r["file_id"], r["value"], r["set"]) for r in of_books.collect()) == [(10, "A River", "1:m"), (10, "Ada Brook", "3:m"), (10, "The Sea", "3:f")]
    (got,) = claims.chosen(claims.resolve(claims.prepare(of_books))).collect()
    assert got["book_id"] == 10 and got["authors"] == ["Ada Brook"]
    assert claims.resolve(claims.prepare(spark.createDataFrame([], CLAIMS))).count() == 0


@pytest.mark.parametrize(
    "title,author,washed",
    [
        ("Ada Brook - The River", "Ada Brook", "The River"), ("Brook Ada – The River", "Ada Brook", "The River"), ("The River - Ada Brook", "Ada Brook", "The River"), ("The River by Ada Brook", "Brook, Ada", "The River"),
        ("Ada Brook", "Ada Brook", "Ada Brook"), ("A fekete folt", "Fekete", "A fekete folt"), ("Ada Brook - Untitled", "Ada Brook", "Ada Brook - Untitled"), ("The River - Part", "Ada Brook", "The River - Part"), ("The River", "", "The River"),
    ],
)
def test_wash(spark, title, author, washed):
    assert spark.range(1).select(paths.wash_author(F.lit(title), F.lit(author))).first()[0] == washed


def test_fallback_chain(spark):
    books = spark.createDataFrame([(1, "Voted", ["Voter One"]), (2, "", []), (3, "", []), (4, "", []), (5, "", []), (6, "The River - Ada Brook", ["Ada Brook"]), (7, "Voted", []), (8, "", [])], "book_id long, title string, authors array<string>")
    found = spark.createDataFrame(
        [
            (1, "x/Ada Brook - The River it was.epub", 0), (2, "x/Ada Brook - The River it was.epub", 1), (2, "y/other_name_here.pdf", 0), (3, "x/River, The - Brook, Ada.epub", 0), (4, "lib/Jane_Austen/A long walk.txt", 0),
            (5, "lib/0001.epub", 0), (6, "x/a.epub", 0), (7, "lib/Carl Stone - Some old songs.zip!a.txt", 0), (8, "lib/x/doc.pdf", 0),
        ],
        "book_id long, path string, path_order int",
    )
    claimed = spark.createDataFrame([(1, "Claimed", []), (8, "", ["Ian Reed"])], "book_id long, title string, authors array<string>")
    got = {r["book_id"]: (r["title"], r["title_source"], r["authors"], r["author_source"]) for r in fallback.book_fields(books, found, claimed).collect()}
    assert got[1] == ("Claimed", "claim", ["Voter One"], "metadata")
    assert got[2] == ("The River it was", "natural", ["Ada Brook"], "natural")
    assert got[3][2] == ["Ada Brook"] and got[3][0] == "The River"
    assert got[4] == ("A long walk", "name", ["Jane Austen"], "folder")
    assert got[6] == ("The River", "metadata", ["Ada Brook"], "metadata")
    assert got[7][:2] == ("Voted", "metadata") and got[7][2:] == (["Carl Stone"], "archive")
    assert got[8][2:] == (["Ian Reed"], "claim") and len(got) == 8


def test_repaired_paths(spark):
    raw = "lib/Jókai Mór/".encode("cp1250") + "Őszi.zip!".encode() + "Csónak.txt".encode("cp1250")
    assert files.repair_path(raw) == "lib/Jókai Mór/Őszi.zip!Csónak.txt" and files.repair_path(b"plain\\x") == "plain\\x"
    rows = spark.createDataFrame([(bytearray(raw),), (None,)], "p binary")
    assert [r[0] for r in rows.select(files.repaired_path("p")).collect()] == ["lib/Jókai Mór/Őszi.zip!Csónak.txt", None]


def test_runs(spark):
    runs = spark.createDataFrame([], "run_id long, root string, mode string, status string, started long, finished long")
    one = tables.end_run(tables.start_run(runs, "/a", "fresh", 5), 1, "done", 9)
    two = tables.start_run(one, "/a", "resume", 12)
    assert [tuple(r) for r in two.orderBy("run_id").collect()] == [(1, "/a", "fresh", "done", 5, 9), (2, "/a", "resume", "running", 12, None)]
    with pytest.raises(ValueError, match="/a"):
        tables.start_run(two, "/b", "fresh", 20)


def test_backfill(spark):
    rows = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (3, "c", None)], "id long, key string, version int")
    got = tables.backfill(rows, "version", 2, lambda df: df.withColumn("key", F.upper("key")))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 2), (2, "B", 2), (3, "C", 2)]


def test_skips_and_console(spark):
    parsed = spark.createDataFrame([("b", None, "html"), ("a", None, "min_size"), ("c", "bad", "html"), ("d", None, None)], "path string, error string, skip_reason string")
    assert [tuple(r) for r in reports.skips(parsed).collect()] == [("a", "min_size"), ("b", "html")]
    books = spark.createDataFrame([(1, "A River", ["Ada Brook", "Carl Stone"]), (2, "The Sea", [])], "book_id long, title string, authors array<string>")
    held = spark.createDataFrame([(1, "y"), (1, "x")], "book_id long, path string")
    assert {r["block"] for r in reports.console_lines(books, held).collect()} == {"Ada Brook, Carl Stone: A River\n  x\n  y", "The Sea"}
    formats = spark.createDataFrame([("pdf",), ("txt",)], "f string")
    assert [r[0] for r in formats.select(quality.format_disabled("f", ["txt", "epub"])).collect()] == [True, False]


def test_list_codec(spark):
    rows = spark.createDataFrame([(["a", 'b"', "é"],), ([],), (None,)], "x array<string>").withColumn("j", text.encode_list("x"))
    assert [(r["j"], r["back"]) for r in rows.select("j", text.decode_list("j").alias("back")).collect()] == [('["a","b\\"","é"]', ["a", 'b"', "é"]), ("[]", []), ("[]", [])]
    assert spark.range(1).select(text.decode_list(F.lit("nonsense"))).first()[0] == []


class Server(http.server.BaseHTTPRequestHandler):
    data, ranges, cut = bytes(range(256)) * 5000, True, None

    def do_HEAD(self):
        self.send_response(200)
        self.send_header("Content-Length", str(len(self.data)))
        self.end_headers()

    def do_GET(self):
        asked, start = self.headers.get("Range"), 0
        if asked and self.ranges:
            start = int(asked[6:-1])
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {start}-{len(self.data) - 1}/{len(self.data)}")
        else:
            self.send_response(200)
        body = self.data[start:]
        self.send_header("Content-Length", str(len(body) if self.cut is None else self.cut))
        self.end_headers()
        self.wfile.write(body if self.cut is None else body[: self.cut])

    def log_message(self, *_):
        pass


@pytest.fixture()
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/dump.txt.gz"
    s.shutdown()


@pytest.mark.parametrize("ranges", [True, False])
def test_download_is_taken_up_again(server, tmp_path, monkeypatch, ranges):
    monkeypatch.setattr(Server, "ranges", ranges)
    monkeypatch.setattr(Server, "cut", 300_000)
    with pytest.raises(OSError, match="300000 of 1280000"):
        download.fetch(server, str(tmp_path))
    assert os.path.getsize(tmp_path / "dump.txt.gz.part") == 300_000 and not (tmp_path / "dump.txt.gz").exists()
    monkeypatch.setattr(Server, "cut", None)
    seen = []
    path = download.fetch(server, str(tmp_path), report=lambda have, total: seen.append((have, total)))
    assert open(path, "rb").read() == Server.data and seen[-1] == (1_280_000, 1_280_000) and not os.path.exists(f"{path}.part")
    monkeypatch.setattr(Server, "cut", 1)  # nothing is fetched again
    assert download.fetch(server, str(tmp_path)) == path


def test_json_arrays(spark, tmp_path):
    import json

    rows = spark.createDataFrame([(1, "é", None), (2, 'a"b', ["x"])], "id long, name string, list array<string>").orderBy("id")
    assert reports.write_json_array(rows, f"file://{tmp_path}/a.json")
    assert json.loads((tmp_path / "a.json").read_text()) == [{"id": 1, "name": "é"}, {"id": 2, "name": 'a"b', "list": ["x"]}]
    assert reports.write_json_array(rows.limit(0), f"file://{tmp_path}/b.json") and (tmp_path / "b.json").read_text() == "[]\n"
    assert not reports.write_json_array(rows.limit(0), f"file://{tmp_path}/c.json", when_empty=False) and not (tmp_path / "c.json").exists()
    matches = spark.createDataFrame([(1, "ambiguous", "x"), (2, "no_data", ""), (3, "confirmed", "")], "book_id long, status string, review_reason string")
    found = reports.review(matches, spark.createDataFrame([(1, "possible_duplicate")], "book_id long, reason string"))
    reports.write_buckets(found, f"file://{tmp_path}/review")
    assert {p.name for p in (tmp_path / "review").iterdir() if p.is_dir()} == {"status=ambiguous", "status=no_data"}


def test_scan_path_of_a_file(spark):
    from inkloom.operators.scan import scanned

    body = b"It began at night by the river and went on for a long while. " * 400
    rows = [
        ("a.txt", "txt", body, None), ("b.txt", "txt", body.replace(b"  ", b" ").replace(b" by", b"\r\n by"), None), ("small.txt", "txt", b"tiny", None), ("off.pdf", "pdf", b"%PDF-" * 9000, None), ("bad.rtf", "rtf", b"x" * 20000, None),
        ("page.txt", "txt", b"<html><body>" + body, None), ("odd.txt", "txt", b"\x01\x02" * 9000, None), ("gone.txt", "txt", None, "encrypted"), ("e.epub", "epub", b"PK", None), ("blank.txt", "txt", b" " * 20000, None),
    ]
    files_ = spark.createDataFrame([(p, f, None if c is None else len(c), None if c is None else bytearray(c), e) for p, f, c, e in rows], "path string, format string, length long, content binary, error string")
    got = {r["path"]: r for r in scanned(files_, enabled=["txt", "rtf", "epub"]).collect()}
    assert {p: r["skip_reason"] for p, r in got.items() if r["skip_reason"]} == {"small.txt": "min_size", "off.pdf": "format_disabled", "page.txt": "html", "odd.txt": "binary"}
    assert {p for p, r in got.items() if r["error"]} == {"bad.rtf", "gone.txt", "e.epub"} and len(got) == 10
    assert got["a.txt"]["content_hash"] == got["b.txt"]["content_hash"] and got["a.txt"]["content_hash"] and "river" in got["a.txt"]["head_tokens"]
    assert [got[p]["content_hash"] for p in ("blank.txt", "small.txt", "bad.rtf")] == [None] * 3
    assert reports.scan_counts(spark.createDataFrame([(r["error"], r["skip_reason"]) for r in got.values()], "error string, skip_reason string")).first().asDict() == {"found": 10, "parsed": 3, "failed": 3, "skipped": 4}
    assert scanned(files_.limit(0)).count() == 0


def test_progress(spark):
    from inkloom import progress

    seen = []
    with progress.reported(spark, lambda done, total: seen.append((done, total)), every=0.05):
        spark.range(8).repartition(8).mapInPandas(lambda batches: (slow(b) for b in batches), "id long").count()
    assert seen and all(0 <= done <= total for done, total in seen)


def slow(batch):
    import time

    time.sleep(0.3)
    return batch


def test_claims_travel_by_value():
    """What runs on executors names nothing that would have to be imported there, and makes no frame for a file."""
    import subprocess
    import sys

    import pandas as pd
    from pyspark import cloudpickle

    n = 2000
    rows = pd.DataFrame({"file_id": [i // 4 for i in range(4 * n)], "field": ["title", "title", "author", "author"] * n, "value": ["A River", "The River", "Ada Brook", "Brook, Ada"] * n, "source": ["metadata", "filename"] * 2 * n, "set": ["s"] * 4 * n, "ordinal": [0] * 4 * n, "attestation": ["none"] * 4 * n, "junk": [False] * 4 * n, "weak": [False] * 4 * n})
    f = cloudpickle.dumps((claims.in_stream, rows))
    code = "import pickle, sys, time; f, rows = pickle.load(sys.stdin.buffer); t = time.process_time(); n = sum(len(x) for x in f([rows])); print(n, time.process_time() - t < 4)"
    out = subprocess.run([sys.executable, "-P", "-c", code], input=f, capture_output=True, cwd="/", env={})
    assert out.stdout.split() == [str(3 * n).encode(), b"True"], out.stderr[-500:]
