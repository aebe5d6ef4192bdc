"""Queries of the column functions: titles, names, dates, identifiers, paths and display forms, each with SQL.

Their inputs are made of the tables' values, so that every case of a function is met many times: SAMPLES are spelt with
the names of parts, dates and paths with those of orders and events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import dates, identifiers, paths, text, titles
from inkloom.operators import quality
from inkloom.plans.catalog import query, table

#: Titles and names as they come out of files; {} is a part's name.
SAMPLES = [
    "{}", "The {}", "  {}\t and   more ", "Unknown", "Ismeretlen", "Sans titre", "Untitled", "-", "", "ISBN 963-07-1234", "issn: 99", "www.{}.hu", "mail me@{}.org now", "NNCL1234-567.v1",
    "***", "Chapter 5", "{}: the chapter", "XIV.", "12", "Prológus", "A Motto", "epilogues", "Borító: {}", "Translated by {}", "Copyright {}", "A Press", "The {} press", "{} Books",
    "Kiadja a {}", "ABC", "AB C", "Nagy Lajos", "Nagy, Lajos", "Lajos Nagy Books", "N. Lajos", "van der Berg", "Péter, a", "lajos nagy", "University of {}", "{} 1984",
    "What is {}?", "{}: a {}", "„{}”", "This is the story of a {} that nobody had ever told before, not once.", "A", "an", "Az {}", "Lajos-Péter O'Nagy", "Nagy & Kis",
]
_LIST = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in SAMPLES) + "]"
_SAMPLES_SQL = f"x AS (SELECT p_partkey, replace(({_LIST})[p_partkey % {len(SAMPLES)} + 1], '{{}}', p_name) AS raw FROM part), t AS (SELECT p_partkey, raw, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS s FROM x), f AS (SELECT *, strip_accents(lower(s)) AS f FROM t)"


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _list(words: list[str]) -> str:
    return "[" + _in(words)[1:-1] + "]"


def _samples(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    raw = F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("p_partkey") % len(SAMPLES) + 1).cast("int"))
    return p.select("p_partkey", F.replace(raw, F.lit("{}"), F.col("p_name")).alias("s"))


# junk, credits and chapter headings as SQL says them; `f` is folded, `s` has single spaces
_JUNK = r"(s = '' OR regexp_matches(s, '(?i)^nncl[\w\s./-]*$') OR regexp_matches(s, '(?i)^(isbn|issn)[\s:.-]') OR contains(lower(s), '://') OR contains(lower(s), 'www.') OR regexp_matches(s, '[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}') OR NOT regexp_matches(s, '[\p{L}\p{Nd}]'))"
_BARE = "trim({0}, '\"''()[]{{}}.,;:!?')"
_LED = f"({_BARE.format('split_part(f, chr(32), 1)')} IN {_in(titles.ARTICLES)} AND len(string_split(f, ' ')) <= 3)"


def _part(words: list[str]) -> str:
    """Whether f holds one of the words; one pattern, compiled once."""
    return f"regexp_matches(f, '{'|'.join(words)}')"


def _word(words: list[str]) -> str:
    return f"regexp_matches(f, '(^|[^\\p{{L}}\\p{{Nd}}])({'|'.join(words)})($|[^\\p{{L}}\\p{{Nd}}])')"


_CREDIT = (
    f"(f <> '' AND ({_part(titles.CREDIT_STEMS)} OR {_part(titles.CREDIT_PHRASES)} OR {_word(titles.CREDIT_WORDS)} OR "
    f"(({_part(titles.PUBLISHER_STEMS)} OR {_part(titles.PUBLISHER_PHRASES)} OR {_word(titles.PUBLISHER_WORDS)}) AND NOT {_LED})))"
)
_CHAPTER = (
    r"(regexp_matches(s, '^(\d{1,2}|[IVXLCDM]+)\.?$') OR regexp_matches(f, '^(" + "|".join(titles.CHAPTER_OPENINGS) + r")\b') OR "
    f"{_BARE.format('split_part(f, chr(32), 1)')} IN {_in(titles.CHAPTER_WORDS)} OR {_BARE.format('split_part(f, chr(32), 2)')} IN {_in(titles.CHAPTER_WORDS)})"
)


@query(
    "title_gates",
    f"""WITH {_SAMPLES_SQL} SELECT p_partkey, f IN {_in(titles.PLACEHOLDER_AUTHORS)} AS no_author, f IN {_in(titles.PLACEHOLDER_TITLES)} AS no_title, {_JUNK} AS junk, {_CREDIT} AS credit, {_CHAPTER} AS chapter,
    regexp_matches(s, '^\\p{{Lu}}{{1,3}}$') AS noise_author FROM f""",
)
def title_gates(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return s.select(
        "p_partkey", titles.is_placeholder_author("s").alias("no_author"), titles.is_placeholder_title("s").alias("no_title"), titles.is_junk_value("s").alias("junk"), titles.is_credit("s").alias("credit"),
        titles.is_chapter_heading("s").alias("chapter"), titles.is_noise_author("s").alias("noise_author"),
    )


_INITIAL = r"regexp_matches(w, '^\.?\p{Lu}\p{L}{0,2}\.?$')"
_UPPER = r"regexp_matches(w, '^[\"''(\[]*\p{Lu}')"
_PARTICLE = f"strip_accents(lower(w)) IN {_in(titles.PARTICLES)}"
_NAMES_SQL = f"""{_SAMPLES_SQL},
w AS (SELECT *, CASE WHEN s = '' THEN [] ELSE list_transform(string_split(s, ' '), lambda x: {_BARE.format("x")}) END AS ws, string_split(s, ',') AS parts FROM f),
c AS (SELECT *, len(ws) AS n, len(parts) - 1 AS commas, trim(parts[1]) AS l, trim(coalesce(parts[2], '')) AS r FROM w),
k AS (SELECT *, commas = 0 OR (commas = 1 AND l <> '' AND r <> '' AND len(string_split(l, ' ')) BETWEEN 1 AND 3 AND len(string_split(r, ' ')) BETWEEN 1 AND 4
        AND list_bool_and(list_transform(ws, lambda w: w = '' OR {_PARTICLE} OR {_INITIAL} OR {_UPPER})) AND NOT (len(string_split(r, ' ')) = 1 AND strip_accents(lower({_BARE.format("r")})) IN {_in(titles.ARTICLES)})) AS comma_ok,
      s = '' OR length(s) > 60 OR {_JUNK} OR {_CREDIT} OR regexp_matches(s, '[:;!?/\\\\@&]') OR {_part(titles.ORGANIZATION_STEMS)} OR n > 6 OR NOT regexp_matches(s, '\\p{{L}}') OR regexp_matches(s, '\\p{{Nd}}') AS rejected FROM c),
names AS (SELECT *, CASE WHEN rejected THEN -10 WHEN NOT comma_ok OR strip_accents(lower(coalesce(ws[1], ''))) IN {_in(titles.ARTICLES)} THEN -10
      ELSE CASE n WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END + CASE WHEN commas = 1 THEN 2 ELSE 0 END
        + CASE WHEN n = 1 THEN 0 ELSE list_sum(list_transform(ws, lambda w: CASE WHEN w = '' OR {_PARTICLE} THEN 0 WHEN {_INITIAL} OR {_UPPER} THEN 1 ELSE -3 END)) END END::INTEGER AS name_score FROM k)"""


@query("name_scores", f"WITH {_NAMES_SQL} SELECT p_partkey, name_score FROM names")
def name_scores(spark, sf_dir):
    return _samples(spark, sf_dir).select("p_partkey", titles.name_score("s").alias("name_score"))


_PROSE = r"(len(string_split(s, ' ')) >= 8 AND length(s) >= 60 AND regexp_matches(s, '[.!?]$'))"


@query(
    "title_scores",
    f"""WITH {_NAMES_SQL}, p AS (SELECT *, {_BARE.format("split_part(f, ' ', 1)")} IN {_in(titles.ARTICLES)} AS article FROM names)
    SELECT p_partkey, {_PROSE} AS prose, CASE WHEN s = '' OR length(s) > 200 OR {_JUNK} OR {_CREDIT} OR {_CHAPTER} OR n > 12 OR (n = 1 AND article) OR (ends_with(s, '.') AND n >= 5) OR {_PROSE} THEN -10
      ELSE CASE WHEN n = 1 THEN 1 WHEN n <= 10 THEN 2 ELSE 1 END + CASE WHEN article THEN 2 ELSE 0 END + CASE WHEN regexp_matches(s, '[?!]') THEN 1 ELSE 0 END + CASE WHEN contains(s, ':') THEN 1 ELSE 0 END
        + CASE WHEN list_bool_or(list_transform(ws, lambda w: regexp_matches(w, '^\\p{{Ll}}') AND NOT {_PARTICLE})) THEN 1 ELSE 0 END - CASE WHEN regexp_matches(s, '^["„“]') THEN 2 ELSE 0 END - CASE WHEN name_score >= 3 THEN 3 ELSE 0 END END::INTEGER AS title_score FROM p""",
)
def title_scores(spark, sf_dir):
    return _samples(spark, sf_dir).select("p_partkey", titles.looks_like_prose("s").alias("prose"), titles.title_score("s").alias("title_score"))


@query(
    "suspicious_titles",
    """WITH l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1)::INTEGER AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) x),
    n AS (SELECT doc_id, line_no, trim(regexp_replace(line, '[\\s\\x0B]+', ' ', 'g')) AS s FROM l), c AS (SELECT *, length(s) - length(replace(s, ',', '')) AS commas, length(s) - length(replace(s, '"', '')) AS quotes,
      (length(s) - length(replace(s, '“', ''))) + (length(s) - length(replace(s, '„', ''))) AS opened, length(s) - length(replace(s, '”', '')) AS closed FROM n),
    b AS (SELECT *, (length(s) > 100)::INTEGER + 2 * (commas >= 2)::INTEGER + 4 * (quotes % 2 = 1 OR opened <> closed)::INTEGER + 8 * (len(string_split(s, ' ')) >= 12 AND regexp_matches(s, '[(,]'))::INTEGER AS signals FROM c)
    SELECT doc_id, line_no, signals, bit_count(signals) >= 2 AS suspicious FROM b""",
)
def suspicious_titles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return docs.select("doc_id", (F.col("p") + 1).alias("line_no"), titles.suspicious_signals("line").alias("signals"), titles.is_suspicious("line").alias("suspicious"))


_KEYED = "trim(regexp_replace(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'))"
_PAIRS = f"""a AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' the Second' WHEN 2 THEN ' 2' ELSE '!' END AS x,
  CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'The ' || p_name WHEN 2 THEN p_name || ' 2' WHEN 3 THEN 'old ' || p_name ELSE p_name || ' second' END AS y FROM part),
k AS (SELECT *, {_KEYED.format("x")} AS kx, {_KEYED.format("y")} AS ky FROM a),
t AS (SELECT *, list_filter(list_distinct(string_split(kx, ' ')), lambda w: w NOT IN {_in(text.STOP_WORDS)}) AS tx, list_filter(list_distinct(string_split(ky, ' ')), lambda w: w NOT IN {_in(text.STOP_WORDS)}) AS ty FROM k)"""


@query(
    "title_agreement",
    f"""WITH {_PAIRS} SELECT p_partkey, kx = ky OR (least(len(string_split(kx, ' ')), len(string_split(ky, ' '))) >= 2 AND CASE WHEN length(kx) <= length(ky) THEN contains(' ' || ky || ' ', ' ' || kx || ' ') ELSE contains(' ' || kx || ' ', ' ' || ky || ' ') END) AS agree,
    kx = ky OR (least(len(tx), len(ty)) >= 2 AND len(list_intersect(tx, ty)) = least(len(tx), len(ty)) AND list_filter(tx, lambda w: regexp_full_match(w, '\\p{{N}}+')) = list_filter(ty, lambda w: regexp_full_match(w, '\\p{{N}}+'))) AS equivalent FROM t""",
)
def title_agreement(spark, sf_dir):
    k4, k5, name = F.col("p_partkey") % 4, F.col("p_partkey") % 5, F.col("p_name")
    x = F.concat(name, F.when(k4 == 0, "").when(k4 == 1, " the Second").when(k4 == 2, " 2").otherwise("!"))
    y = F.when(k5 == 0, name).when(k5 == 1, F.concat(F.lit("The "), name)).when(k5 == 2, F.concat(name, F.lit(" 2"))).when(k5 == 3, F.concat(F.lit("old "), name)).otherwise(F.concat(name, F.lit(" second")))
    return table(spark, sf_dir, "part").select("p_partkey", text.titles_agree(x, y).alias("agree"), text.titles_equivalent(x, y).alias("equivalent"))


@query(
    "author_agreement",
    """WITH a AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ['nagy', 'lajos'] WHEN 1 THEN ['lajos'] WHEN 2 THEN ['nagy', 'lajos', 'pal'] ELSE [] END AS x, CASE c_custkey % 3 WHEN 0 THEN ['lajos', 'nagy'] WHEN 1 THEN ['nagy', 'pal'] ELSE ['pal'] END AS y FROM customer)
    SELECT c_custkey, least(len(x), len(y)) > 0 AND len(list_intersect(x, y)) = least(len(x), len(y)) AS equivalent FROM a""",
)
def author_agreement(spark, sf_dir):
    k4, k3 = F.col("c_custkey") % 4, F.col("c_custkey") % 3
    x = F.when(k4 == 0, "Nagy, Lajos").when(k4 == 1, "LAJOS").when(k4 == 2, "Pál von Nagy-Lajos").otherwise("de Ab")
    y = F.when(k3 == 0, "Lajos Nagy").when(k3 == 1, "Nagy Pál").otherwise("van den Pál")
    return table(spark, sf_dir, "customer").select("c_custkey", text.authors_equivalent(x, y).alias("equivalent"))


@query(
    "author_names",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'A Kis|B Nagy' WHEN 1 THEN 'Kis|Nagy' WHEN 2 THEN 'Kis' WHEN 3 THEN 'A Kis' ELSE 'Nagy, Lajos' END AS names,
    CASE c_custkey % 5 WHEN 3 THEN 'A Kis' WHEN 4 THEN 'Lajos Nagy' ELSE CASE c_custkey % 5 WHEN 0 THEN 'A Kis & B Nagy' WHEN 1 THEN 'Kis; Nagy and Unknown' ELSE 'Kis és Kis' END END AS canonical FROM customer""",
)
def author_names(spark, sf_dir):
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, "A Kis & B Nagy").when(k == 1, "Kis;  Nagy and Unknown").when(k == 2, "Kis és Kis").when(k == 3, "  A   Kis ").otherwise("Nagy, Lajos")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(titles.split_authors(raw), "|").alias("names"), titles.canonical_author(raw).alias("canonical"))


@query(
    "dump_dates",
    """SELECT o_orderkey, CASE o_orderkey % 11 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m') WHEN 3 THEN strftime(o_orderdate, '%Y-%m') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 6 THEN strftime(o_orderdate, '%Y') WHEN 7 THEN strftime(o_orderdate, '%Y-%m') WHEN 8 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS said,
    CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE 'spring ' || strftime(o_orderdate, '%Y') END AS document FROM orders""",
)
def dump_dates(spark, sf_dir):
    k, d = F.col("o_orderkey") % 11, F.col("o_orderdate")
    out = F.lit("soon")
    for n, layout in enumerate(["MMMM d, yyyy", "MMM d, yyyy", "MMMM yyyy", "MMM yyyy", "d MMMM yyyy", "d MMM, yyyy", "yyyy", "yyyy-MM", "yyyy-MM-dd'T'HH:mm:ss'Z'"]):
        out = F.when(k == n, F.date_format(d, layout)).otherwise(out)
    out = F.when(k == 10, F.lit("0199-02-30")).otherwise(out)
    k3 = F.col("o_orderkey") % 3
    packed = F.when(k3 == 0, F.date_format(d, "'D:'yyyyMMddHHmmss")).when(k3 == 1, F.date_format(d, "'D:'yyyyMM")).otherwise(F.date_format(d, "'spring 'yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.dump_date(out).alias("said"), dates.document_date(packed).alias("document"))


_TAGS = {"EN_us": "en-US", "hu": "hu", "und": "", "ZH-hans-cn": "zh-Hans-CN", "": "", "english!": "", "mul": "", "de-AT": "de-AT"}
_CODES = {"/languages/eng": "en", "/languages/HUN": "hu", "/languages/xyz": "", "ger": "de", "/languages/fra": "fr", "/languages/fre": "fr"}


@query(
    "language_forms",
    f"""SELECT event_id, ({_list(list(_TAGS.values()))})[event_id % {len(_TAGS)} + 1] AS tag, ({_list(list(_CODES.values()))})[event_id % {len(_CODES)} + 1] AS marc,
    CASE WHEN event_id % 7 < 3 THEN CASE WHEN user_id % 2 = 0 THEN 'en-US,fr' ELSE '' END WHEN user_id % 2 = 1 THEN 'hu' WHEN event_id % 2 = 0 THEN 'en-US,fr' WHEN event_id % 7 = 6 THEN 'hu' ELSE 'en-US,fr' END AS reconciled FROM events""",
)
def language_forms(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % len(xs) + 1).cast("int"))
    declared = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("en-US"), F.lit("fr"))).otherwise(F.array().cast("array<string>"))
    detected = F.when((F.col("event_id") % 2 == 0) & (F.col("user_id") % 2 == 0), "en").otherwise("hu")
    k = F.col("event_id") % 7
    confidence = F.when(k < 3, 0.4).when(k == 6, 0.8).otherwise(0.6)
    return e.select("event_id", dates.language_tag(pick(list(_TAGS))).alias("tag"), dates.marc_language(pick(list(_CODES))).alias("marc"), F.array_join(dates.reconcile_language(declared, detected, confidence), ",").alias("reconciled"))


_THIRTEEN = "(core || ((10 - (list_sum(list_transform(range(1, 13), lambda i: substr(core, i, 1)::INT * (CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END))) % 10)) % 10)::INT::VARCHAR)"


@query(
    "line_identifiers",
    f"""WITH n AS (SELECT p_partkey, '978' || lpad(((p_partkey + 1) * 7919 % 1000000000)::VARCHAR, 9, '0') AS core FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE {_THIRTEEN} END AS isbns, '10.1234/p' || p_partkey AS dois FROM n""",
)
def line_identifiers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey")
    core = F.lpad(((F.col("p_partkey") + 1) * 7919 % 1000000000).cast("string"), 9, "0")
    total = sum((F.substring(core, i + 1, 1).cast("int") * (10 - i) for i in range(9)), F.lit(0))
    check = F.pmod(11 - F.pmod(total, F.lit(11)), F.lit(11))
    ten = F.concat(core, F.when(check == 10, "X").otherwise(check.cast("string")))
    wrong = F.concat(core, F.when(check == 0, "1").otherwise("0")) if False else F.concat(F.lit("the ISBN "), ten, F.lit(" is in prose"))
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat(F.lit("ISBN-10: "), ten)).when(k == 1, F.concat(F.lit("e-ISBN 13 "), ten, F.lit(" (paper).\nISBN: "), ten)).otherwise(wrong)
    head = F.concat(F.lit("A title\r\n"), line, F.lit("\nsee doi:10.1234/p"), F.col("p_partkey"), F.lit(").\n"))
    return p.select("p_partkey", F.array_join(identifiers.line_isbns(head), ",").alias("isbns"), F.array_join(identifiers.dois(head), ",").alias("dois"))


@query(
    "path_forms",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'lib/a' WHEN 1 THEN 'lib/x.zip' WHEN 2 THEN 'lib/Wow! x.tar.gz' ELSE '' END AS source, CASE event_id % 4 WHEN 0 THEN 'The book ' || event_id WHEN 1 THEN 'Kis Pál - A ' || event_id ELSE 'b ' || event_id END AS title,
    CASE event_id % 4 WHEN 1 THEN 'in/Kis_Pál - A ' || event_id || '.epub' WHEN 2 THEN 'b_' || event_id || '.txt' WHEN 3 THEN 'b_' || event_id || '.rtf' ELSE 'lib/a/The_book ' || event_id || '.pdf' END AS member, CASE event_id % 4 WHEN 1 THEN 'x.zip' ELSE '' END AS first_archive FROM events""",
)
def path_forms(spark, sf_dir):
    k, n = F.col("event_id") % 4, F.col("event_id")
    path = F.when(k == 0, F.concat(F.lit("lib/a/The_book "), n, F.lit(".pdf"))).when(k == 1, F.concat(F.lit("lib/x.zip!in/Kis_Pál - A "), n, F.lit(".epub"))).when(k == 2, F.concat(F.lit("lib/Wow! x.tar.gz!b_"), n, F.lit(".txt"))).otherwise(F.concat(F.lit("b_"), n, F.lit(".rtf")))
    first = F.when(k == 1, F.regexp_extract(F.coalesce(F.get(paths.archives(path), F.lit(0)), F.lit("")), "([^/]*)$", 1)).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", paths.source_group(path).alias("source"), paths.title_from_path(path).alias("title"), paths.member_name(path).alias("member"), first.alias("first_archive"))


@query(
    "path_names",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN p_name || ' 1' ELSE '' END AS calibre_title, CASE p_partkey % 5 WHEN 0 THEN 'Lajos Nagy' WHEN 1 THEN 'Mary Ann Lee' ELSE '' END AS calibre_author,
    CASE p_partkey % 5 WHEN 2 THEN p_name || ' it was' WHEN 3 THEN p_name ELSE '' END AS natural_title, CASE p_partkey % 5 WHEN 2 THEN 'Lajos Nagy' WHEN 3 THEN 'Anna Kis' ELSE '' END AS natural_author, CASE WHEN p_partkey % 2 = 0 THEN 'Jane Austen' ELSE '' END AS folder FROM part""",
)
def path_names(spark, sf_dir):
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    file = F.when(k == 0, F.concat(name, F.lit(", The - Nagy, Lajos"))).when(k == 1, F.concat(name, F.lit(" 1 - Lee, Mary Ann"))).when(k == 2, F.concat(F.lit("Lajos Nagy - "), name, F.lit(" it was"))).when(k == 3, F.concat(name, F.lit(" - Anna Kis"))).otherwise(name)
    folder = F.when(F.col("p_partkey") % 2 == 0, "lib/Jane_Austen [all]/ebooks").otherwise("lib/various")
    path = F.concat_ws("/", folder, F.concat(file, F.lit(".epub")))
    c, n = paths.calibre(path), paths.natural(path)
    blank = lambda x: F.when(k < 2, F.lit("")).otherwise(x)
    return table(spark, sf_dir, "part").select("p_partkey", c["title"].alias("calibre_title"), c["author"].alias("calibre_author"), blank(n["title"]).alias("natural_title"), blank(n["author"]).alias("natural_author"), paths.folder_author(path).alias("folder"))


@query(
    "display_forms",
    """WITH n AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 1000 WHEN 1 THEN o_orderkey * 1013 + 1 WHEN 2 THEN o_orderkey * 2 * 5000011 + 3 ELSE o_orderkey * 2 * 3000000019 + 1 END AS c FROM orders),
    o AS (SELECT *, c + (c % 2 = 0 AND c >= 1024)::INTEGER AS b FROM n)
    SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576.0::DOUBLE) WHEN b < 1099511627776 THEN printf('%.1f GiB', b / 1073741824.0::DOUBLE) ELSE printf('%.1f TiB', b / 1099511627776.0::DOUBLE) END AS size,
    CASE WHEN o_custkey % 9 = 0 THEN '0.0%' ELSE printf('%.1f', 100.0::DOUBLE * (o_orderkey % 7) / 7) || '%' END AS share FROM o""",
)
def display_forms(spark, sf_dir):
    k, n = F.col("o_orderkey") % 4, F.col("o_orderkey")
    c = F.when(k == 0, n % 1000).when(k == 1, n * 1013 + 1).when(k == 2, n * 2 * 5000011 + 3).otherwise(n * 2 * 3000000019 + 1)
    rows = table(spark, sf_dir, "orders").withColumn("c", c).withColumn("b", F.col("c") + F.when((F.col("c") % 2 == 0) & (F.col("c") >= 1024), 1).otherwise(0))
    whole = F.when(F.col("o_custkey") % 9 == 0, 0).otherwise(7)
    return rows.select("o_orderkey", text.human_size("b").alias("size"), text.percent(F.col("o_orderkey") % 7, whole).alias("share"))


@query(
    "clean_forms",
    """SELECT doc_id, sha256(regexp_replace(text || CASE WHEN doc_id % 3 = 0 THEN chr(1) || chr(9) || 'x' || chr(127) ELSE '' END, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS cleaned,
    CASE WHEN doc_id % 2 = 0 THEN 'The ' || source ELSE source || ', of' END AS title FROM documents WHERE text IS NOT NULL""",
)
def clean_forms(spark, sf_dir):
    odd = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "\x01\tx\x7f").otherwise(""))
    title = F.concat("source", F.when(F.col("doc_id") % 2 == 0, ", The").otherwise(", of"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(text.clean_control(odd), 256).alias("cleaned"), text.article_to_front(title).alias("title"))


@query(
    "match_tokens",
    f"""WITH {_SAMPLES_SQL}, w AS (SELECT p_partkey, list_filter(string_split(regexp_replace(f, '[\\s.,;:!?''"()\\[\\]{{}}_–—/&+-]+', ' ', 'g'), ' '), lambda x: length(x) > 2 AND x NOT IN {_in(text.NAME_PARTICLES)}) AS w FROM f),
    i AS (SELECT p_partkey, unnest(w) AS t, generate_subscripts(w, 1) AS o FROM w), d AS (SELECT p_partkey, t, min(o) AS o FROM i GROUP BY 1, 2), g AS (SELECT p_partkey, string_agg(t, ' ' ORDER BY o) AS tokens, count(*) AS n FROM d GROUP BY 1)
    SELECT x.p_partkey, coalesce(tokens, '') AS tokens, coalesce(n, 0)::INTEGER AS hashes FROM x LEFT JOIN g USING (p_partkey)""",
)
def match_tokens(spark, sf_dir):
    tokens = text.match_tokens("s")
    return _samples(spark, sf_dir).select("p_partkey", F.array_join(tokens, " ").alias("tokens"), F.size(text.token_hashes(tokens)).alias("hashes"))


# junk reasons, language and plain text, line by line

_DOCS_AND_PAGES = "d AS (SELECT doc_id AS id, text, n_chars FROM documents WHERE text IS NOT NULL UNION ALL SELECT -page_id - 1, html, length(html) FROM pages)"
_CUT_LINES = r"lines AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS o FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_replace(regexp_replace(x, '^[\s\x0B]+', ''), '[\s\x0B]+$', '')), lambda x: x <> '') AS l FROM d) y)"
_JUNK_SQL = f"""WITH {_DOCS_AND_PAGES}, {_CUT_LINES},
f AS (SELECT id, line, o, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS s, strip_accents(lower(trim(regexp_replace(line, '\\s+', ' ', 'g')))) AS f, regexp_matches(line, '^\\p{{Nd}}{{1,4}}$') AS page FROM lines),
c AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE {_CREDIT} OR {_JUNK} OR page) AS credits, arg_min(f, o) AS opening,
      count(*) FILTER (WHERE starts_with(f, 'tartalom') OR ends_with(line, '.') OR contains(line, '...') OR regexp_matches(line, '(^|\\s)\\p{{Nd}}{{1,4}}$')) AS toc FROM f GROUP BY id),
t AS (SELECT d.id, n_chars, coalesce(n, 0) AS n, coalesce(credits, 0) AS credits, opening, coalesce(toc, 0) AS toc, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS x, lower(substr(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 1, 4096)) AS h, lower(substr(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 1, 8192)) AS k, len(regexp_extract_all(text, '\\p{{L}}')) AS letters FROM d LEFT JOIN c USING (id)),
m AS (SELECT *, length(h) - length(replace(replace(h, '<', ''), '>', '')) AS tags, (SELECT count(*) FROM (SELECT unnest(['http/1.', 'content-type:', 'content-length:', 'last-modified:', 'accept-ranges:']) AS w) q WHERE contains(k, w)) AS headers,
      (length(k) - length(replace(k, 'http://', ''))) / 7 + (length(k) - length(replace(k, 'https://', ''))) / 8 AS urls, len(regexp_extract_all(k, '\\S+')) AS words FROM t)
SELECT id, CASE WHEN x = '' THEN NULL WHEN starts_with(h, '<!doctype') OR starts_with(h, '<html') OR starts_with(h, '<head') OR starts_with(h, '<body') OR (tags > 40 AND tags * 100 > length(h)) THEN 'html'
  WHEN contains(k, 'hts-cache') OR headers >= 2 OR (urls >= 5 AND urls * 20 > words) THEN 'http_cache' WHEN n_chars < 4096 AND letters < 32 THEN 'few_letters' WHEN n_chars < 4096 AND n > 0 AND credits * 100 >= n * 70 AND letters < 1000 THEN 'credits'
  WHEN n_chars < 4096 AND n BETWEEN 1 AND 12 AND starts_with(opening, 'fulszoveg') THEN 'blurb' WHEN n_chars < 20480 AND n >= 5 AND toc * 100 >= n * 60 THEN 'contents' END AS reason FROM m"""


@query("junk_reasons", _JUNK_SQL)
def junk_reasons(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text", "n_chars")
    pages = table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("id"), F.col("html").alias("text"), F.length("html").cast("long").alias("n_chars"))
    return docs.unionByName(pages).select("id", quality.junk_reason("text", "n_chars").alias("reason"))


_SHARES = ", ".join(f"{{'share': len(list_filter(w, lambda x: x IN {_in(words.split())})) / greatest(len(w), 1)::DOUBLE, 'code': '{code}'}}" for code, words in quality.FREQUENT.items())


@query(
    "detected_language",
    f"""WITH d AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), {_CUT_LINES},
    p AS (SELECT id, substr(string_agg(line, ' ' ORDER BY o), 1, 2000) AS s FROM lines WHERE NOT regexp_matches(line, '[{{}};]\\s*$|^\\s*(#|//|<)|[=<>]{{2}}') AND len(regexp_extract_all(line, '\\p{{L}}')) * 2 >= length(line) GROUP BY id),
    w AS (SELECT doc_id, lang, coalesce(s, '') AS s, regexp_split_to_array(lower(coalesce(s, '')), '[^\\p{{L}}]+') AS w FROM documents LEFT JOIN p ON p.id = doc_id WHERE text IS NOT NULL),
    r AS (SELECT doc_id, lang, len(regexp_extract_all(s, '\\p{{L}}')) >= 40 AS enough, list_reverse_sort([{_SHARES}]) AS r FROM w),
    c AS (SELECT doc_id, lang, r[1].code AS found, CASE WHEN enough AND r[1].share > 0 THEN r[1].share / (r[1].share + r[2].share) ELSE 0 END AS confidence FROM r),
    e AS (SELECT *, CASE WHEN confidence > 0 THEN found ELSE '' END AS code FROM c)
    SELECT doc_id, code, round(confidence, 6) AS confidence, CASE WHEN confidence < 0.5 OR code = '' OR lower(split_part(lang, '-', 1)) = code THEN coalesce(lang, '') WHEN confidence >= 0.75 THEN code ELSE coalesce(lang, '') END AS languages FROM e""",
)
def detected_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.array("lang").alias("declared"))
    found = quality.detect_languages(docs)
    return found.select("doc_id", "code", F.round("confidence", 6).alias("confidence"), F.array_join(dates.reconcile_language("declared", "code", "confidence"), ",").alias("languages"))


@query(
    "plain_text_of_pages",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head\s*>', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(t, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g') AS t FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS t FROM b)
    SELECT page_id, sha256(trim(regexp_replace(t, '[\s\x0B]+', ' ', 'g'))) AS text_sha256 FROM c WHERE t IS NOT NULL""",
)
def plain_text_of_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.sha2(text.plain_text("html"), 256).alias("text_sha256"))
