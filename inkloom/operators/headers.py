"""What the head of a text says of its title and authors: labels, front matter, a start marker, and the title page.

All in column expressions: lines become rows, are judged once each, and are put together again by document. Only the
first ``LINES`` lines of a document are looked at, so what is gathered of one is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.text import fold_all, head, normalize
from inkloom.functions.titles import (
    NAME_THRESHOLD, is_chapter_heading, is_credit, is_junk_value, is_placeholder_author, is_placeholder_title, looks_like_prose, name_score, split_authors, title_score,
)
from inkloom.session import Scratch

# Keys of labels, words of edition lines, and how far is looked.
TITLE_KEYS = ["title", "cím", "cim", "könyv címe", "konyv cime", "ti"]
AUTHOR_KEYS = ["author", "authors", "by", "creator", "szerző", "szerzo", "szerzők", "szerzok", "író", "iro", "au"]
EDITION_WORDS = ["edition", "editions", "kiadas", "version", "verzio", "volume", "kotet"]
LINES, MARKER_LINES, CANDIDATES, PAIR_SCORE = 100, 200, 12, 6

LABEL = r"^(\p{L}[\p{L}\p{N} _-]{0,31}):[ \t]*(.+?)[ \t]*$"
START = r"(?i)^[*]{3}\s*start of (?:the|this) project gutenberg ebook(?!\w)(.*?)[*]{0,3}\s*$"


def clean_value(c) -> Column:
    """A value without the quotes around it, with single spaces."""
    s = normalize(c)
    for a, b in (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’")):
        s = F.regexp_replace(s, f"^{a}\\s*(.*?)\\s*{b}$", "$1")
    return s


def _bad_title(c) -> Column:
    return (c == "") | is_placeholder_title(c) | is_placeholder_author(c) | is_junk_value(c)


def _bad_author(c) -> Column:
    return (c == "") | is_placeholder_author(c) | is_placeholder_title(c) | is_credit(c) | is_junk_value(c) | ~c.rlike(r"\p{L}")


def _heads(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """file_id and its first lines; a distributor's number among the first five that hold anything is left out."""
    lines = F.slice(F.split(F.regexp_replace(head(text), "^﻿", ""), r"\r\n|\r|\n"), 1, MARKER_LINES)
    rows = docs.select(F.col(ident).alias("file_id"), lines.alias("lines"))
    number = F.filter(F.transform("lines", lambda x, i: F.when(F.trim(x).rlike(r"(?i)^nncl[\s\w./-]*$"), i)), lambda i: i.isNotNull())
    at = F.get(number, F.lit(0))
    before = F.size(F.filter(F.slice("lines", 1, F.coalesce(at, F.lit(0))), lambda x: F.trim(x) != ""))
    drop = at.isNotNull() & (before < 5)
    rest = F.concat(F.slice("lines", 1, F.coalesce(at, F.lit(0))), F.slice("lines", F.coalesce(at, F.lit(0)) + 2, F.lit(MARKER_LINES)))
    rows = rows.withColumn("lines", F.when(drop, rest).otherwise(F.col("lines")))
    # the end of the front matter and the start marker, as positions from 1; 0 where there is none
    fence = F.array_position(F.transform(F.slice("lines", 2, LINES), lambda x: F.trim(x) == "---"), True)
    opened = F.coalesce(F.trim(F.get("lines", F.lit(0))) == "---", F.lit(False))
    marker = F.array_position(F.transform("lines", lambda x: F.trim(x).rlike(START)), True)
    return rows.select("file_id", "lines", F.when(opened, fence).otherwise(0).alias("fence"), marker.alias("marker"))


def label_claims(heads: DataFrame) -> DataFrame:
    """Of each block of labels (front matter, what precedes the start marker, the leading block) the first title and the
    first authors."""
    leading = F.array_position(F.transform("lines", lambda x: ~((F.trim(x) == "") | F.trim(x).rlike(LABEL) | F.trim(x).rlike(START))), True)
    upto = lambda n: F.slice("lines", 1, n.cast("int"))
    regions = F.array(
        F.when(F.col("fence") > 0, F.slice("lines", F.lit(2), (F.col("fence") - 1).cast("int"))),
        F.when(F.col("marker") > 1, upto(F.col("marker") - 1)),
        upto(F.least(F.when(leading == 0, F.lit(LINES)).otherwise(leading - 1), F.lit(LINES))),
    )
    lines = heads.select("file_id", F.posexplode(regions).alias("region", "r")).where("r IS NOT NULL").select("file_id", "region", F.posexplode("r").alias("at", "line"))
    said = lines.select("file_id", "region", "at", F.lower(F.trim(F.regexp_extract(F.trim("line"), LABEL, 1))).alias("key"), F.regexp_extract(F.trim("line"), LABEL, 2).alias("value")).where("key <> ''")
    title = clean_value("value")
    titles = said.where(F.col("key").isin(TITLE_KEYS)).withColumn("value", title).where(~_bad_title(F.col("value")))
    titles = titles.groupBy("file_id", "region").agg(F.min_by("value", "at").alias("value")).select("file_id", "region", F.lit("title").alias("field"), F.array("value").alias("values"))
    names = F.filter(F.transform(split_authors("value"), clean_value), lambda n: ~_bad_author(n))
    authors = said.where(F.col("key").isin(AUTHOR_KEYS)).select("file_id", "region", "at", names.alias("values")).where(F.size("values") > 0)
    authors = authors.groupBy("file_id", "region").agg(F.min_by("values", "at").alias("values")).select("file_id", "region", F.lit("author").alias("field"), "values")
    every = titles.unionByName(authors).select("file_id", "field", F.posexplode("values").alias("ordinal", "value"), F.concat(F.lit("labels:"), "region").alias("set"))
    return every.select("file_id", "field", "value", F.lit("header").alias("source"), "set", "ordinal")


def marker_claims(heads: DataFrame) -> DataFrame:
    """The title that a start marker names."""
    line = F.trim(F.get("lines", (F.col("marker") - 1).cast("int")))
    title = clean_value(F.regexp_replace(F.regexp_extract(line, START, 1), "^[ ,;:-]+", ""))
    rows = heads.where("marker > 0").select("file_id", title.alias("value")).where("value <> ''")
    return rows.select("file_id", F.lit("title").alias("field"), "value", F.lit("header").alias("source"), F.lit("marker").alias("set"), F.lit(0).alias("ordinal"))


def _page_lines(heads: DataFrame) -> DataFrame:
    """Candidate lines of title pages (file_id, nth from 0, line, name, title, credit, edition): leading noise is
    skipped, and noise or running text after the first candidate ends the page."""
    lines = heads.where("fence = 0 AND marker = 0").select("file_id", F.posexplode(F.slice("lines", 1, LINES)).alias("at", "raw")).withColumn("line", F.trim("raw")).where("line <> ''")
    label = F.lower(F.trim(F.regexp_extract("line", LABEL, 1)))
    known = F.col("line").rlike(r"^[A-Z]{2,6}[ \t]*:(\s|$)") | label.isin(TITLE_KEYS + AUTHOR_KEYS)
    noise = known | is_junk_value("line") | is_credit("line") | F.col("line").rlike(r"^\p{Nd}{1,4}$") | is_chapter_heading("line")
    words = F.split("line", r"\s+")
    body = looks_like_prose("line") | (F.col("line").endswith(".") & (F.size(words) >= 2) & F.exists(words, lambda w: F.btrim(w, F.lit("\"'()[]{}.,;:!?")).rlike(r"^\p{Ll}")))
    judged = lines.select("file_id", "at", "line", F.when(noise, "noise").when(body, "body").otherwise("").alias("kind"))
    whole = Window.partitionBy("file_id")
    first = F.min(F.when(F.col("kind") != "noise", F.col("at"))).over(whole)
    judged = judged.withColumn("first", first).where("at >= first")
    end = F.min(F.when(F.col("kind") != "", F.col("at"))).over(whole)
    page = judged.withColumn("end", end).where("end IS NULL OR at < end")
    page = page.withColumn("nth", F.row_number().over(Window.partitionBy("file_id").orderBy("at")) - 1).where(F.col("nth") < CANDIDATES)
    edition = F.exists(F.split(fold_all("line"), " "), lambda w: F.btrim(w, F.lit(".,;:()[]")).isin(EDITION_WORDS))
    return page.select("file_id", "nth", "line", edition.alias("edition"))


def _scored(pairs: DataFrame) -> DataFrame:
    """Rows (file_id, a, b) as titles with their author in the order that fits; none where both fit alike."""
    s = Scratch(pairs.sparkSession, "pairs").save(pairs.withColumn("na", name_score("a")).withColumn("nb", name_score("b")).withColumn("ta", title_score("a")).withColumn("tb", title_score("b")), "scored")
    c = F.col
    a_fits, b_fits = (c("na") >= NAME_THRESHOLD) & (c("tb") >= 1), (c("nb") >= NAME_THRESHOLD) & (c("ta") >= 1)
    first, second = c("na") + c("tb"), c("nb") + c("ta")
    a_leads = (a_fits & ~b_fits) | (a_fits & b_fits & (first >= second + 2))
    b_leads = (b_fits & ~a_fits) | (a_fits & b_fits & (second >= first + 2))
    out = s.withColumn("title", F.when(a_leads, c("b")).when(b_leads, c("a"))).withColumn("author", F.when(a_leads, c("a")).when(b_leads, c("b")))
    return out.where("title IS NOT NULL").select("file_id", "title", F.array("author").alias("authors"), F.when(a_leads, first).otherwise(second).alias("score"))


def title_page_claims(heads: DataFrame) -> DataFrame:
    """The title and authors of a title page: a pair on one line or on two, a title with subtitle or edition and a run of
    names, a name or a title over two lines. The best reading counts where it is clearly better than the next; a title
    page that can be read both ways says nothing."""
    scratch = Scratch(heads.sparkSession, "pages")  # the scores are long expressions over these rows
    lines = scratch.save(_page_lines(heads), "lines")
    page = lines.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("nth", "line", "edition"))).alias("p"))
    at = lambda i, f="line": F.get("p", F.lit(i))[f]
    # pairs of one line: at the first colon, or at one of up to three dashes
    cuts = [(r"^(.*?): (.*)$", 1)] + [(rf"^((?:.*? {d} ){{{k}}}.*?) {d} (.*)$", k) for d in ("-", "–", "—") for k in range(3)]
    one = lines.where("nth < 2").select("file_id", F.explode(F.array(*[F.struct(F.trim(F.regexp_extract("line", r, 1)).alias("a"), F.trim(F.regexp_extract("line", r, 2)).alias("b")) for r, _ in cuts])).alias("x")).select("file_id", "x.a", "x.b").where("a <> '' AND b <> ''")
    two = page.where(at(1).isNotNull() & ~F.coalesce(at(1, "edition"), F.lit(False))).select("file_id", at(0).alias("a"), at(1).alias("b"))
    readings = _scored(one.unionByName(two))
    # over two lines: a name and then a title, or a name and then a long title
    three = page.where(at(2).isNotNull())
    wrapped = three.select("file_id", F.concat_ws(" ", at(0), at(1)).alias("n"), at(2).alias("t")).unionByName(three.select("file_id", at(0).alias("n"), F.concat_ws(" ", at(1), at(2)).alias("t")))
    wrapped = wrapped.withColumn("ns", name_score("n")).withColumn("ts", title_score("t")).where((F.col("ns") >= NAME_THRESHOLD) & (F.col("ts") >= 1))
    readings = readings.unionByName(wrapped.select("file_id", F.col("t").alias("title"), F.array("n").alias("authors"), (F.col("ns") + F.col("ts")).alias("score")))
    # a title, perhaps with a subtitle or an edition, and the names after it
    second = page.where(at(1).isNotNull()).select("file_id", at(0).alias("t"), at(1).alias("s"), at(1, "edition").alias("edition"))
    second = second.withColumn("sub", ~F.col("edition") & (name_score("s") < NAME_THRESHOLD) & (title_score("s") >= 1))
    run = lines.drop("edition").join(second, "file_id").where(F.col("nth") >= F.when(F.col("edition") | F.col("sub"), 2).otherwise(1))
    name = F.regexp_replace("line", "(?i)^by ", "")
    run = run.withColumn("names", F.filter(split_authors(name), lambda n: n != "")).withColumn("isname", (name_score(name) >= NAME_THRESHOLD) & (F.size("names") > 0))
    stop = F.min(F.when(~F.col("isname"), F.col("nth"))).over(Window.partitionBy("file_id"))
    run = run.withColumn("stop", stop).where("stop IS NULL OR nth < stop").select("file_id", "t", "s", "edition", "sub", "nth", F.posexplode("names").alias("k", "name"))
    run = run.withColumn("score", name_score("name")).where(F.col("score") >= NAME_THRESHOLD)
    listed = run.groupBy("file_id", "t", "s", "edition", "sub").agg(F.sort_array(F.collect_list(F.struct("nth", "k", "name", "score"))).alias("x"))
    kept = F.filter("x", lambda y, i: ~F.exists(F.slice("x", F.lit(1), i), lambda z: F.lower(z["name"]) == F.lower(y["name"])))
    listed = listed.withColumn("x", kept).where(F.col("sub") | F.col("edition") | (F.size("x") >= 2))
    title = F.when(~F.col("sub"), F.col("t")).when(F.col("t").rlike("[:?!]$"), F.concat_ws(" ", "t", "s")).otherwise(F.concat_ws(": ", "t", "s"))
    listed = listed.withColumn("title", title).withColumn("ts", title_score("title"))
    readings = readings.unionByName(listed.select("file_id", "title", F.col("x.name").alias("authors"), (F.col("ts") + F.aggregate("x", F.lit(0), lambda n, y: n + y["score"])).alias("score")))
    good = scratch.save(readings, "readings").where("score > 0").where(~is_junk_value("title") & ~is_credit("title"))
    ranked = good.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("score", "title", "authors")), False).alias("r"))
    best, next_ = F.get("r", F.lit(0)), F.get("r", F.lit(1))["score"]
    chosen = ranked.where((best["score"] >= PAIR_SCORE) & (next_.isNull() | (best["score"] - next_ >= 2))).select("file_id", best["title"].alias("title"), best["authors"].alias("authors"))
    values = F.concat(F.array(F.struct(F.lit("title").alias("field"), F.lit(0).alias("ordinal"), clean_value("title").alias("value"))), F.transform("authors", lambda a, i: F.struct(F.lit("author").alias("field"), i.alias("ordinal"), clean_value(a).alias("value"))))
    return chosen.select("file_id", F.inline(values)).select("file_id", "field", "value", F.lit("title_page").alias("source"), F.lit("title_page").alias("set"), "ordinal")


def header_claims(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Claims (file_id, field, value, source, set, ordinal) of all these readings. Null and empty texts make none."""
    heads = Scratch(docs.sparkSession, "heads").save(_heads(docs.where(F.col(text).isNotNull()), ident, text), "heads")
    return label_claims(heads).unionByName(marker_claims(heads)).unionByName(title_page_claims(heads))


def header_metadata(claims: DataFrame) -> DataFrame:
    """file_id, title and authors: front matter, then what precedes the marker, then the leading labels, then the
    marker, then the title page. A title page fills a gap only where what is known agrees with it."""
    order = F.when(F.col("set") == "marker", 3).when(F.col("set") == "title_page", 4).otherwise(F.regexp_extract("set", "(\\d)$", 1).try_cast("int"))
    sets = claims.withColumn("o", order).groupBy("file_id", "o").agg(
        F.max(F.when(F.col("field") == "title", F.col("value"))).alias("title"), F.transform(F.sort_array(F.collect_list(F.when(F.col("field") == "author", F.struct("ordinal", "value")))), lambda x: x["value"]).alias("authors")
    )
    known = sets.where("o < 4").groupBy("file_id").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("o"))).alias("t"), F.min_by("authors", F.when(F.size("authors") > 0, F.col("o"))).alias("a"))
    page = sets.where("o = 4").select("file_id", F.col("title").alias("pt"), F.col("authors").alias("pa"))
    both = known.join(page, "file_id", "full").withColumn("a", F.coalesce("a", F.array().cast("array<string>"))).withColumn("pa", F.coalesce("pa", F.array().cast("array<string>")))
    folded = lambda c: F.transform(c, lambda n: fold_all(n))
    authors_agree = F.arrays_overlap(folded("a"), folded("pa"))
    a, b = fold_all("t"), fold_all("pt")
    inside = lambda x, y: F.contains(F.concat(F.lit(" "), x, F.lit(" ")), F.concat(F.lit(" "), y, F.lit(" ")))
    titles_agree = (a == b) | (a.contains(" ") & b.contains(" ") & (inside(a, b) | inside(b, a)))
    title = F.when(F.col("t").isNotNull(), F.col("t")).when((F.size("a") == 0) | (F.size("pa") == 0) | authors_agree, F.col("pt"))
    both = both.withColumn("title", title)
    authors = F.when(F.size("a") > 0, F.col("a")).when(F.col("t").isNull() | F.col("pt").isNull() | titles_agree, F.col("pa")).otherwise(F.array().cast("array<string>"))
    return both.select("file_id", F.coalesce("title", F.lit("")).alias("title"), F.filter(authors, lambda n: fold_all(n) != fold_all(F.coalesce("title", F.lit("")))).alias("authors"))
