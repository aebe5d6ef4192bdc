"""Functions on cases of our own."""

import pytest
from pyspark.sql import functions as F

from inkloom.functions import dates, identifiers, paths, text, titles
from inkloom.operators import dedup, quality


def values(spark, inputs, *exprs):
    rows = spark.createDataFrame([(x,) for x in inputs], "x string").select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).collect()
    return [tuple(r) if len(exprs) > 1 else r[0] for r in rows]


def test_keys_and_tokens(spark):
    assert values(spark, ["Őrült  Ñandú: Øre – Straße й", "The Art of War, Vol. 2", "", "  "], text.title_key("x")) == ["orult nandu ore strasse й", "the art of war vol 2", "", ""]
    assert values(spark, ["Tolkien, J.R.R. van der Berg"], text.author_tokens("x")) == [["berg", "tolkien"]]
    assert values(spark, ["The Art of War"], text.content_tokens("x")) == [["art", "war"]]
    assert values(spark, ["Йод и"], text.fold_all("x")) == ["иод и"]


def test_agreement(spark):
    rows = spark.createDataFrame([("The Hobbit", "The Hobbit, or There and Back"), ("Dune", "Dune Messiah"), ("Dune 1", "Dune 2"), ("Foundation and Empire", "Empire Foundation")], "a string, b string")
    assert [tuple(r) for r in rows.select(text.titles_agree("a", "b"), text.titles_equivalent("a", "b")).collect()] == [(True, False), (False, False), (False, False), (False, True)]


def test_query_words():
    assert text.sanitize_query('dune* AND ("herbert" OR not)') == "dune herbert"
    with pytest.raises(ValueError):
        text.sanitize_query("and ** or")


def test_isbns(spark):
    cases = {"0-306-40615-2": "9780306406157", "978-0-306-40615-7": "9780306406157", "ISBN: 080442957X": "9780804429573", "0306406153": None, "1111111111": None, "": None, "٠-٣٠٦-٤٠٦١٥-٢": "9780306406157"}
    assert values(spark, list(cases), identifiers.isbn13("x")) == list(cases.values())
    heads = ["ISBN 978-0-306-40615-7\nfoo 0306406152", "ISBN: 0306406152 (pbk)", "see ISBN 0306406152 in prose", ""]
    assert values(spark, heads, identifiers.line_isbns("x")) == [["9780306406157"], ["9780306406157"], [], []]


def test_isbns_that_begin_like_a_label(spark):
    """Ten digits that begin with 10 or 13 aren't the number of a label, which still goes where it is one."""
    cases = {"ISBN 100048646X": "9781000486469", "ISBN 1-302-86216-2": "9781302862169", "ISBN-10 0306406152": "9780306406157", "ISBN-10: 100048646X": "9781000486469", "ISBN 10 1-00-048646-X": "9781000486469", "ISBN-13 978-0-306-40615-7": "9780306406157", "ISBN-139780306406157": "9780306406157", "ISBN 100048646": None}
    assert values(spark, list(cases), identifiers.isbn13("x")) == list(cases.values())
    assert values(spark, ["ISBN 100048646X", "ISBN-10 100048646X", "ISBN 13 9780306406157 (pbk)"], identifiers.line_isbns("x")) == [["9781000486469"], ["9781000486469"], ["9780306406157"]]


def test_head_never_cuts_a_character(spark):
    cases = ["abc", "aé", "aéb", "a€b", "a€", "ab😀", "a😀b", "😀", "", "€�€"]
    for most in range(4, 8):
        want = [x.encode()[:most].decode(errors="ignore") for x in cases]
        assert values(spark, cases, text.head("x", most)) == want
    long = "x" + "é" * 40_000
    assert values(spark, [long], text.head("x")) == [long[:32_768]]


def test_gates_of_long_texts_with_cut_characters(spark):
    """The 65,536th byte of these texts is within a letter."""
    rows = spark.createDataFrame([(1, "xyz" + "é à\n" * 20_000), (2, "und " * 5 + "und" + "der Fluß und die See € im Tal\n" * 4_000)], "doc_id long, text string")
    assert [r[0] for r in rows.select(quality.junk_reason("text", F.length("text"))).collect()] == [None, None]
    assert {r["doc_id"]: r["code"] for r in quality.detect_languages(rows).collect()}[2] == "de"


def test_dates_and_languages(spark):
    assert values(spark, ["2001-05-06", "2001-05", "2001", "2001-13", "0999", "2001-05-06T10:00:00Z", "May 2001"], dates.publication_date("x")) == ["2001-05-06", "2001-05", "2001", "", "", "2001-05-06", ""]
    assert values(spark, ["January 2, 2006", "2 Jan 2006", "Jan 2006", "2006", "soon"], dates.dump_date("x")) == ["2006-01-02", "2006-01-02", "2006-01", "2006", ""]
    assert values(spark, ["en_us", "UND", "zh-hant-tw", "x", "hu"], dates.language_tag("x")) == ["en-US", "", "zh-Hant-TW", "", "hu"]
    assert values(spark, ["/languages/eng", "/languages/qqq"], dates.marc_language("x")) == ["en", ""]


def test_title_heuristics(spark):
    cases = ["C:\\books\\x", "report_final_v2", "3/4", "TCP/IP Illustrated", "table of contents", "1984", "X", "Dune", "chapter 3", "book.pdf"]
    assert values(spark, cases, titles.is_artifact_title("x")) == [True, True, False, False, True, False, True, False, True, True]
    assert values(spark, ["Jane Austen", "Austen, Jane", "the end", "Oxford University", "J. R. R. Tolkien", "Chapter 2"], titles.is_name("x")) == [True, True, False, False, True, False]
    assert values(spark, ["Pride and Prejudice", "Translated by John Smith", "He went home and he slept."], titles.is_title("x")) == [True, False, False]
    assert values(spark, ["unknown", "Jane"], titles.is_placeholder_author("x")) == [True, False]


def test_paths(spark):
    path = "lib/a.tar.gz!x/The_Title - Last, First.txt"
    assert values(spark, [path, "odd!name.txt"], paths.title_from_path("x")) == ["The Title - Last, First", "odd!name"]
    assert values(spark, [path], paths.calibre("x"))[0].asDict() == {"title": "The Title", "author": "First Last"}
    assert values(spark, [path, "a/b/c.txt"], paths.source_group("x")) == ["lib/a.tar.gz", "a/b"]


def test_quality(spark):
    page = "<html><body>hi</body></html>"
    cache = "HTTP/1.1 200 OK\nContent-Type: text/html\n"
    contents = "\n".join(f"Part {i} ...... {i}" for i in range(9))
    assert values(spark, [page, cache, "ab", contents, "A proper text with many letters that goes on and on\nand on"], quality.junk_reason("x", F.length("x"))) == ["html", "http_cache", "few_letters", "contents", None]
    assert values(spark, ["a\x00b\x01c", "plain"], quality.looks_binary("x")) == [True, False]


def test_band_hash_wraps_like_unsigned(spark):
    rows = [[1, 2, 3, 4, 5], [2**31 - 2, 7, 0, 123456789, 99]]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "r array<long>").select(dedup.band_hash(F.col("r"))).collect()]

    def expected(values):
        h = 14695981039346656037
        for v in values:
            h = ((h ^ v) * 1099511628211) % 2**64
            h ^= h >> 32
        return h - 2**64 if h >= 2**63 else h

    assert got == [expected(r) for r in rows]


def test_signature_forms_agree(spark):
    files = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c"), (3, "A b c d e f g h")], "doc_id long, text string")
    slow = {r["doc_id"]: r["signature"] for r in dedup.signatures_sql(dedup.shingled(files), "doc_id", 20).collect()}
    fast = {r["doc_id"]: r["signature"] for r in dedup.signatures(files, n=20).collect()}
    assert slow == fast and slow[1] == slow[3] and 2 not in slow


def test_member_names_of_old_archives():
    from inkloom.sources import files

    assert files.CODE_PAGES == ["cp437", "cp850", "cp852", "cp1250", "cp1252"]
    for name, page in (("Café déjà.txt", "cp437"), ("Jókai Mór – Az arany ember.txt", "cp1250"), ("plain (1).txt", "ascii"), ("Größe.txt", "utf-8")):
        assert files.decode_member_name(name.encode(page)) == name


def test_word_lists_of_titles(spark):
    """Each article, particle and chapter word, and words that aren't."""
    from pyspark.sql import functions as F

    from inkloom.functions import titles

    def of(f, values):
        rows = spark.createDataFrame([(v,) for v in values], "v string")
        return {r["v"]: r["x"] for r in rows.select("v", f("v").alias("x")).collect()}

    assert not any(v for v in of(titles.is_chapter_heading, ["Introduction", "Preface", "Contents", "Resz", "Kotet", "The river", "Mottos"]).values())
    assert all(of(titles.is_chapter_heading, ["Prolog", "Epilog here", "Impresszum", "Ajánlás", "The motto", "Függelék", "Jegyzetek", "Epilógus", "A prológus", "3.", "XI"]).values())
    scores = of(titles.name_score, ["Egy Kis", "Ein Mann", "Eine Frau", "Un Homme", "Une Femme", "Una Casa", "Gli Amici", "I Malavoglia"])
    assert set(scores.values()) == {-10}
    particles = of(titles.name_score, [f"Jan {p} Berg" for p in titles.PARTICLES] + ["Jan da Berg", "Jan y Berg"])
    assert {particles[f"Jan {p} Berg"] for p in titles.PARTICLES} == {4} and particles["Jan da Berg"] == particles["Jan y Berg"] == 1
    led = of(titles.is_credit, ["The press", "Egy press", "Una press", "Big press", "The old press house"])
    assert led == {"The press": False, "Egy press": False, "Una press": False, "Big press": True, "The old press house": True}
    assert F is not None


def nodes(spark, *columns) -> int:
    """Operations of the expressions as Spark keeps them: what is named twice in an expression is there twice."""
    plan = spark.createDataFrame([("x", "y")], "x string, y string").select(*columns)._jdf.queryExecution().analyzed()
    todo, n = [plan.expressions().apply(i) for i in range(plan.expressions().size())], 0
    while todo and n < 5000:
        e, n = todo.pop(), n + 1
        todo += [e.children().apply(i) for i in range(e.children().size())]
    return n


@pytest.mark.parametrize("f, most", [(paths.natural, 2000), (paths.calibre, 1200), (paths.folder_author, 1200), (paths.calibre_author, 2000), (titles.name_score, 1200), (titles.title_score, 1200), (lambda c: paths.wash_author(c, F.col("y")), 1200)])
def test_expressions_make_their_parts_once(spark, f, most):
    assert nodes(spark, f(F.col("x"))) < most


def test_ascii_and_other_texts_fold_alike(spark):
    cases = ["A  Plain\tTitle", "Ünïcode\u00a0and ASCII", "\u212aelvin", "İstanbul", "no_break\u2003space", "ﬁ Æ", "e\u0301clat"]
    marked = [x + " é" for x in cases]
    assert [x + " e" for x in values(spark, cases, text.fold_all("x"))] == values(spark, marked, text.fold_all("x"))
    assert [x + " e" for x in values(spark, cases, text.fold_latin("x"))] == values(spark, marked, text.fold_latin("x"))


def test_parts_of_one_file_are_dealt_out(spark, tmp_path):
    from inkloom.plans import catalog

    spark.createDataFrame([(i, f"name {i}") for i in range(64)], "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert catalog.table(spark, str(tmp_path), "part").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_signatures_at_the_ends_of_the_residues(spark):
    """Against whole numbers of Python: 0, the largest residue, repeats, none, and more than fill a block."""
    a, b = dedup.coefficients(512)
    sets = [[0], [dedup.PRIME - 1], [dedup.PRIME - 1, 0, 0], [], None, [i * 7_654_321 % dedup.PRIME for i in range(1, 400)]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(sets)], "i int, h array<long>").select("i", dedup.signature_udf()("h").alias("s"))
    want = [[min((x * m + k) % dedup.PRIME for x in s) for m, k in zip(a, b)] if s else None for s in sets]
    assert [r["s"] for r in rows.orderBy("i").collect()] == want
