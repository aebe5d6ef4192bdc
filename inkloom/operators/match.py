"""Record linkage: books against the editions, works and authors of an external catalog.

Editions come with a line number, as landed from the dump. Candidates are found by ISBN, by exact title key and by the
two rarest title tokens; then scored, cut to the best of each book, resolved against authors and works, grouped into
works, ranked and classified. All joins are on keys; nothing is broadcast by hand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.identifiers import is_isbn_scheme, isbn13, isbn_priority
from inkloom.functions.text import author_tokens, containment, content_tokens, jaccard, jaccard_bound, title_key, title_tokens
from inkloom.session import Scratch

EPSILON = 1e-9


@dataclass(frozen=True)
class Options:
    candidates: int = 20
    works: int = 5
    posting: int = 5000
    title: float = 0.35
    isbn_title: float = 0.60
    confirm: float = 0.90
    probable: float = 0.75
    review: float = 0.60
    gap: float = 0.05
    ambiguity: float = 0.05
    ranked: int = 10
    content: float = 0.60
    content_title: float = 0.60
    content_author: float = 0.40
    dump_order: bool = True


def at_least(a, b) -> Column:
    return a + EPSILON >= b


def less(a, b) -> Column:
    return a + EPSILON < b


def prepare_books(books: DataFrame) -> DataFrame:
    """Books (book_id, title, authors, identifiers, head_tokens) with their keys and tokens, and their ISBNs in 13
    digits, each with its best priority."""
    isbns = F.filter(F.transform("identifiers", lambda i: F.struct(isbn13(i["value"]).alias("isbn"), isbn_priority(i["source"]).alias("priority"), i["source"].alias("source"), is_isbn_scheme(i["scheme"]).alias("ok"))), lambda i: i["ok"] & i["isbn"].isNotNull())
    return books.select(
        "book_id", "title", "authors", title_key("title").alias("title_key"), title_tokens("title").alias("tokens"),
        F.filter(F.transform("authors", lambda a: author_tokens(a)), lambda t: F.size(t) > 0).alias("author_tokens"), isbns.alias("isbns"), "head_tokens",
    )


def prepare_editions(editions: DataFrame) -> DataFrame:
    """Editions (line_no, edition_key, title, isbns, work_key, author_keys) with keys and tokens; without a key they go."""
    return editions.where("edition_key <> ''").select(
        "line_no", "edition_key", "work_key", "author_keys", "title", title_key(F.coalesce("title", F.lit(""))).alias("title_key"), title_tokens(F.coalesce("title", F.lit(""))).alias("tokens"),
        F.array_distinct(F.filter(F.transform("isbns", lambda i: isbn13(i)), lambda i: i.isNotNull())).alias("isbns"),
    )


def isbn_candidates(books: DataFrame, editions: DataFrame) -> DataFrame:
    """book_id, edition_key, isbn, source, priority and title score of pairs that share an ISBN."""
    held = books.select("book_id", F.col("tokens").alias("bt"), F.inline("isbns")).where("ok").groupBy("book_id", "isbn").agg(F.min(F.struct("priority", "source")).alias("p"), F.first("bt").alias("bt"))
    given = editions.select("edition_key", "line_no", F.col("tokens").alias("et"), F.explode("isbns").alias("isbn"))
    out = held.join(given, "isbn").select("book_id", "edition_key", "line_no", "isbn", F.col("p.source").alias("isbn_source"), F.col("p.priority").alias("priority"), jaccard("et", "bt").alias("title_score"), (F.size("bt") == 0).alias("untitled"))
    return out


def retire(found: DataFrame, options: Options) -> DataFrame:
    """book_id and the line of its first strong ISBN hit, after which a book takes no more candidates."""
    strong = found.where((F.col("priority") <= 1) & (F.col("untitled") | (F.col("title_score") >= options.isbn_title)))
    return strong.groupBy("book_id").agg(F.min("line_no").alias("last_line"))


def exact_candidates(books: DataFrame, editions: DataFrame) -> DataFrame:
    named = editions.where("title_key <> ''").select("edition_key", "line_no", "title_key")
    return books.select("book_id", "title_key").join(named, "title_key").select("book_id", "edition_key", "line_no")


def token_frequencies(books: DataFrame) -> DataFrame:
    return books.select("book_id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def rarest_tokens(books: DataFrame, editions: DataFrame, options: Options = Options(), n: int = 2) -> DataFrame:
    """edition_key and its n rarest tokens among those of 1 to ``posting`` books; ties by the token itself."""
    asked = editions.select("edition_key", F.explode("tokens").alias("token"))
    known = asked.join(token_frequencies(books).where(F.col("df") <= options.posting), "token")
    order = Window.partitionBy("edition_key").orderBy("df", "token")
    return known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).select("edition_key", "token")


def fuzzy_candidates(books: DataFrame, editions: DataFrame, exact: DataFrame, options: Options = Options()) -> DataFrame:
    """Pairs that share one of the edition's two rarest tokens and are similar enough, for editions without an exact
    match; pairs whose sizes alone rule the score out are dropped before their tokens are compared."""
    open_ = editions.where("title_key <> ''").join(exact.select("edition_key").distinct(), "edition_key", "left_anti")
    posted = books.select("book_id", F.explode("tokens").alias("token"))
    met = rarest_tokens(books, open_, options).join(posted, "token").select("book_id", "edition_key").distinct()
    sized = met.join(books.select("book_id", F.col("tokens").alias("bt")), "book_id").join(open_.select("edition_key", "line_no", F.col("tokens").alias("et")), "edition_key")
    sized = sized.where(jaccard_bound(F.size("bt"), F.size("et")) >= options.title)
    return sized.withColumn("title_score", jaccard("et", "bt")).where(F.col("title_score") >= options.title).select("book_id", "edition_key", "line_no", "title_score")


def strength(priority: Column) -> Column:
    return F.when(priority == 0, 1.0).when(priority == 1, 0.9).when(priority == 2, 0.75).otherwise(0.5)


def base_score(title, author, content, isbn, priority) -> Column:
    text = 0.6 * title + 0.3 * author + 0.1 * content
    return F.when(isbn.isNull(), text).otherwise(0.7 * strength(priority) + 0.3 * text)


def worst_last() -> list[Column]:
    """Order of candidates from the best to the worst."""
    return [F.desc("score"), F.col("isbn").isNull(), F.coalesce("priority", F.lit(9)), F.desc("title_score"), F.desc("author_score"), F.col("edition_key")]


def candidates(books: DataFrame, editions: DataFrame, options: Options = Options()) -> DataFrame:
    """The best candidates of each book, one row for each edition: isbn, isbn_source, priority, title_score, methods,
    score, and the edition's title, work and author keys. Books and editions are prepared ones."""
    by_isbn = isbn_candidates(books, editions)
    exact = exact_candidates(books, editions)
    if options.dump_order:
        ends = retire(by_isbn, options)
        cut = lambda df, strict: df.join(ends, "book_id", "left").where(F.col("last_line").isNull() | ((F.col("line_no") < F.col("last_line")) if strict else (F.col("line_no") <= F.col("last_line")))).drop("last_line")
        by_isbn, exact = cut(by_isbn, False), cut(exact, True)
        fuzzy = cut(fuzzy_candidates(books, editions, exact, options), True)
    else:
        fuzzy = fuzzy_candidates(books, editions, exact, options)
    none = F.lit(None)
    rows = by_isbn.select("book_id", "edition_key", "isbn", "isbn_source", "priority", "title_score", F.lit("isbn").alias("method"))
    for df, score, method in ((exact.withColumn("title_score", F.lit(1.0)), "title_score", "title_exact"), (fuzzy, "title_score", "title_fuzzy")):
        rows = rows.unionByName(df.select("book_id", "edition_key", none.cast("string").alias("isbn"), none.cast("string").alias("isbn_source"), none.cast("int").alias("priority"), score, F.lit(method).alias("method")))
    best_isbn = F.min(F.when(F.col("isbn").isNotNull(), F.struct("priority", "isbn", "isbn_source")))
    merged = rows.groupBy("book_id", "edition_key").agg(best_isbn.alias("i"), F.max("title_score").alias("title_score"), F.array_sort(F.collect_set("method")).alias("methods"))
    merged = merged.select("book_id", "edition_key", F.col("i.isbn").alias("isbn"), F.col("i.isbn_source").alias("isbn_source"), F.col("i.priority").alias("priority"), "title_score", "methods", F.lit(0.0).alias("author_score"))
    merged = merged.withColumn("score", base_score(F.col("title_score"), F.lit(0.0), F.lit(0.0), F.col("isbn"), F.col("priority")))
    top = merged.withColumn("r", F.row_number().over(Window.partitionBy("book_id").orderBy(*worst_last()))).where(F.col("r") <= options.candidates).drop("r")
    return top.join(editions.select("edition_key", F.col("title").alias("edition_title"), "work_key", "author_keys"), "edition_key", "left")


def resolve_works(found: DataFrame, works: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds work_title for the first candidates of each book, and fills missing author keys from the work; works have
    work_key, title, author_keys."""
    first = Window.partitionBy("book_id").orderBy(*worst_last())
    keyed = found.withColumn("_r", F.row_number().over(first)).withColumn("_w", F.when(F.col("_r") <= options.works, F.col("work_key")))
    w = works.select(F.col("work_key").alias("_w"), F.col("title").alias("work_title"), F.col("author_keys").alias("_keys"))
    return keyed.join(w, "_w", "left").withColumn("author_keys", F.when(F.size("author_keys") > 0, F.col("author_keys")).otherwise(F.coalesce("_keys", "author_keys"))).drop("_r", "_w", "_keys")


def resolve_authors(found: DataFrame, authors: DataFrame, books: DataFrame) -> DataFrame:
    """author_names and author_score: the best agreement of any author's name with any of the book's; authors have
    author_key and names."""
    keys = found.select("book_id", "edition_key", F.posexplode("author_keys").alias("pos", "author_key"))
    # tokens of names once for each author, not for each candidate and each of the book's authors
    told = authors.select("author_key", "names", F.transform("names", lambda n: author_tokens(n)).alias("_tokens"))
    named = keys.join(told, "author_key").join(books.select("book_id", "author_tokens"), "book_id")
    score = F.array_max(F.transform("_tokens", lambda n: F.coalesce(F.array_max(F.transform("author_tokens", lambda t: jaccard(n, t))), F.lit(0.0))))
    each = named.select("book_id", "edition_key", "pos", "names", F.coalesce(score, F.lit(0.0)).alias("s"))
    summed = each.groupBy("book_id", "edition_key").agg(F.max("s").alias("_s"), F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "names"))), lambda x: x["names"]))).alias("_n"))
    out = found.drop("author_score", "author_names").join(summed, ["book_id", "edition_key"], "left")
    out = out.withColumn("author_score", F.coalesce("_s", F.lit(0.0))).withColumn("author_names", F.filter(F.coalesce("_n", F.array().cast("array<string>")), lambda n: n != "")).drop("_s", "_n")
    return out.withColumn("score", base_score(F.col("title_score"), F.col("author_score"), F.lit(0.0), F.col("isbn"), F.col("priority")))


def content_scores(found: DataFrame, books: DataFrame) -> DataFrame:
    """How far the book's own text holds the candidate's title and authors, and what that does to the score."""
    head = F.col("head_tokens")
    best = lambda names, tokens: F.coalesce(F.array_max(F.transform(names, lambda n: containment(tokens(n), head))), F.lit(0.0))
    b = books.select("book_id", "head_tokens", F.col("title").alias("_title"), F.col("authors").alias("_authors"))
    b = b.withColumn("orig_title_hit", containment(content_tokens("_title"), head)).withColumn("orig_author_hit", best(F.col("_authors"), author_tokens))
    j = found.join(b, "book_id")
    title_hit = best(F.filter(F.array("edition_title", "work_title"), lambda t: t.isNotNull() & (t != "")), content_tokens)
    j = j.withColumn("title_hit", title_hit).withColumn("author_hit", best(F.col("author_names"), author_tokens))
    j = j.withColumn("content_score", 0.75 * F.col("title_hit") + 0.25 * F.col("author_hit"))
    score = base_score(F.col("title_score"), F.col("author_score"), F.col("content_score"), F.col("isbn"), F.col("priority"))
    score = score + F.when((F.col("title_hit") >= 0.60) & (F.col("author_hit") >= 0.40), 0.10).otherwise(0.0)
    disagreement = 1 - F.greatest("title_score", "author_score")
    score = score - F.when((F.col("orig_title_hit") >= 0.70) & (disagreement > 0.50), 0.15 * F.col("orig_title_hit") * disagreement).otherwise(0.0)
    return j.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).drop("head_tokens", "_title", "_authors")


def group_key(work: Column, edition: Column) -> Column:
    return F.when(F.coalesce(work, F.lit("")) != "", work).otherwise(F.concat(F.lit("edition:"), edition))


def work_groups(found: DataFrame) -> DataFrame:
    """Adds work_group: the candidate's work, or the one that it is folded into. Groups of a book are taken from
    the best candidate's down; a group joins an earlier seed with a common title key and compatible authors (a
    common key, or equal tokens of the first author). Not transitive, so each book's are
    folded in order, as one expression."""
    keyed = found.withColumn("base", group_key(F.col("work_key"), F.col("edition_key")))
    titles = F.array_distinct(F.filter(F.array(title_key(F.coalesce("edition_title", F.lit(""))), title_key(F.coalesce("work_title", F.lit("")))), lambda t: t != ""))
    order = F.struct((-F.col("score")).alias("s"), F.col("isbn").isNull().alias("i"), F.coalesce("priority", F.lit(9)).alias("p"), (-F.col("title_score")).alias("t"), (-F.col("author_score")).alias("a"), "edition_key")
    facts = keyed.select(
        "book_id", "base", order.alias("order"), titles.alias("titles"), F.coalesce("author_keys", F.array().cast("array<string>")).alias("author_keys"),
        F.array_join(author_tokens(F.coalesce(F.get("author_names", F.lit(0)), F.lit(""))), " ").alias("first_author"),
    )
    best = facts.groupBy("book_id", "base").agg(F.count("*").alias("size"), F.min("order").alias("order"), F.min_by(F.struct("titles", "author_keys", "first_author"), "order").alias("of"))
    listed = best.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("order", "base", "size", "of"))).alias("bases"))
    empty = F.expr("cast(array() AS array<struct<titles:array<string>,author_keys:array<string>,first_author:string,members:array<struct<size:bigint,rank:int,base:string>>>>)")
    overlap = lambda x, y: F.coalesce(F.arrays_overlap(x, y), F.lit(False))

    def take(seeds, b):
        me = F.struct((-b["size"]).alias("size"), F.aggregate(seeds, F.lit(0), lambda n, s: n + F.size(s["members"])).alias("rank"), b["base"].alias("base"))
        fits = F.transform(seeds, lambda s: overlap(s["titles"], b["of"]["titles"]) & (overlap(s["author_keys"], b["of"]["author_keys"]) | ((s["first_author"] != "") & (s["first_author"] == b["of"]["first_author"]))))
        at = F.array_position(fits, True)
        joined = F.transform(seeds, lambda s, i: F.when(i + 1 == at, s.withField("members", F.concat(s["members"], F.array(me)))).otherwise(s))
        opened = F.struct(b["of"]["titles"].alias("titles"), b["of"]["author_keys"].alias("author_keys"), b["of"]["first_author"].alias("first_author"), F.array(me).alias("members"))
        return F.when(at > 0, joined).otherwise(F.concat(seeds, F.array(opened)))

    seeds = listed.select("book_id", F.explode(F.aggregate("bases", empty, take)).alias("seed"))
    folded = seeds.select("book_id", F.explode("seed.members.base").alias("base"), F.array_min("seed.members")["base"].alias("work_group"))
    return keyed.join(folded, ["book_id", "base"]).drop("base")


def rank_works(grouped: DataFrame, options: Options = Options()) -> DataFrame:
    """The works of each book from the best, with editions counted, the first selected."""
    columns = [c for c in grouped.columns if c not in ("book_id", "work_group")]
    order = F.row_number().over(Window.partitionBy("book_id", "work_group").orderBy(*worst_last()))
    count = F.count("*").over(Window.partitionBy("book_id", "work_group"))
    best = grouped.withColumn("_n", order).withColumn("edition_count", count).where("_n = 1").drop("_n")
    per_book = Window.partitionBy("book_id").orderBy(*worst_last(), "work_group")
    ranked = best.withColumn("rank", F.row_number().over(per_book)).withColumn("next_score", F.lead("score").over(per_book)).withColumn("work_count", F.count("*").over(Window.partitionBy("book_id")))
    return ranked.where(F.col("rank") <= options.ranked).withColumn("selected", F.col("rank") == 1).select("book_id", "work_group", *columns, "edition_count", "rank", "next_score", "work_count", "selected")


def method_of(methods: Column, isbn: Column) -> Column:
    has = lambda m: F.array_contains(methods, m)
    text = F.when(has("title_exact"), "title_exact").when(has("title_fuzzy"), "title_fuzzy")
    return F.when(isbn.isNotNull(), F.concat_ws("+", F.lit("isbn"), text)).otherwise(F.coalesce(text, F.lit("unknown")))


def classify(books: DataFrame, grouped: DataFrame, options: Options = Options()) -> DataFrame:
    """One row for each book: status, reason, method, confidence, gap, the selected edition and work. Books and
    candidates are those of the steps before."""
    o = options
    ranked = rank_works(grouped, o)
    best = ranked.where("selected")
    each = grouped.groupBy("book_id").agg(
        F.count("*").alias("candidate_count"),
        F.count_distinct(F.when(F.col("isbn").isNotNull() & (F.col("priority") <= 1), F.col("work_group"))).alias("strong_works"),
        F.collect_list(F.struct("edition_key", "work_group", "isbn", "title_score", "title_hit", "author_hit")).alias("all"),
    )
    b = books.select("book_id", (F.size("tokens") > 0).alias("titled"), (F.size("author_tokens") > 0).alias("authored"), (F.size("isbns") > 0).alias("numbered"), (F.col("title_key") == "").alias("untitled"))
    j = b.join(best, "book_id", "left").join(each, "book_id", "left")
    c = F.col
    has_isbn = c("isbn").isNotNull()
    gap = F.coalesce(c("score") - c("next_score"), F.lit(1.0))
    other = lambda x: (x["edition_key"] != c("edition_key")) & (x["work_group"] != c("work_group"))
    confirmed = lambda x: at_least(x["title_hit"], 0.60) & at_least(x["author_hit"], 0.40)
    weak_isbn = has_isbn & less(c("title_score"), 0.5) & F.exists("all", lambda x: other(x) & confirmed(x))
    advertised = ~has_isbn & at_least(c("author_hit"), 0.40) & (less(c("title_score"), 0.9) | less(c("author_score"), 0.5)) & F.exists("all", lambda x: other(x) & x["isbn"].isNotNull() & less(x["title_score"], 0.5) & at_least(x["title_hit"], 0.60) & less(x["author_hit"], 0.40))
    conflict = ~less(c("orig_title_hit"), 0.70) & (weak_isbn | advertised)
    weak_author = (F.size("author_names") > 0) & less(c("author_score"), 0.5) & less(c("title_score"), 0.5) & ~at_least(c("author_hit"), o.content_author)
    confirms = has_isbn & (c("priority") <= 2) & at_least(c("content_score"), o.content) & at_least(c("title_hit"), o.content_title) & ~weak_author
    floor = max(o.probable - o.ambiguity, o.review)
    contradiction = c("titled") & c("authored") & less(c("title_score"), 0.20) & less(c("author_score"), 0.20)
    verdict = lambda status, reason="": F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    strong = has_isbn & (c("priority") <= 1)
    decision = (
        F.when(c("edition_key").isNull(), F.when(c("untitled") & ~c("numbered"), verdict("no_data")).otherwise(verdict("not_found")))
        .when(c("strong_works") > 1, verdict("needs_review", "conflicting_isbns"))
        .when(conflict, verdict("ambiguous", "content_conflict"))
        .when(confirms, verdict("confirmed"))
        .when(c("next_score").isNotNull() & at_least(c("next_score"), floor) & less(gap, o.ambiguity), verdict("ambiguous", "ambiguous_work"))
        .when(~has_isbn & less(c("author_score"), 0.5), F.when(at_least(c("content_score"), 0.5) & at_least(c("title_score"), 0.9), verdict("probable")).otherwise(verdict("needs_review", "title_only")))
        .when(strong & contradiction, verdict("needs_review", "isbn_title_mismatch"))
        .when(has_isbn & (c("priority") == 0), verdict("confirmed"))
        .when(has_isbn & (c("priority") == 1) & ~c("titled") & ~c("authored"), verdict("probable"))
        .when(at_least(c("score"), o.confirm) & at_least(gap, o.gap), verdict("confirmed"))
        .when(at_least(c("score"), o.probable) & at_least(gap, o.ambiguity), verdict("probable"))
        .when(at_least(c("score"), o.review), verdict("needs_review", "low_confidence"))
        .otherwise(verdict("not_found"))
    )
    j = j.withColumn("d", decision).withColumn("_confirms", F.coalesce(confirms, F.lit(False)))
    raised = F.when(c("d.status") == "confirmed", F.greatest(c("score"), F.lit(o.confirm))).when(c("d.status") == "probable", F.greatest(c("score"), F.lit(o.probable))).otherwise(c("score"))
    return j.select(
        "book_id", c("d.status").alias("status"), c("d.reason").alias("review_reason"), F.coalesce(raised, F.lit(0.0)).alias("confidence"), F.when(c("edition_key").isNull(), 0.0).otherwise(gap).alias("score_gap"),
        F.when(c("edition_key").isNull(), "").when(c("_confirms"), "isbn+content").otherwise(method_of(c("methods"), c("isbn"))).alias("method"), "edition_key", F.col("work_group").alias("work_key"), "isbn",
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.coalesce("work_count", F.lit(0)).alias("work_count"), F.coalesce("content_score", F.lit(0.0)).alias("content_score"),
    )


def match_prepared(books: DataFrame, editions: DataFrame, works: DataFrame, authors: DataFrame, options: Options = Options()) -> DataFrame:
    """From prepared books and editions to one decision for each book. Each step's rows are written and read again: they
    are used several times, and their expressions are long."""
    scratch = Scratch(books.sparkSession, "match")
    b, e = scratch.save(books, "books"), scratch.save(editions, "editions")
    found = scratch.save(candidates(b, e, options), "candidates")
    resolved = scratch.save(resolve_authors(resolve_works(found, works, options), authors, b), "resolved")
    scored = scratch.save(content_scores(resolved, b), "scored")
    return classify(b, scratch.save(work_groups(scored), "groups"), options)


def match(books: DataFrame, editions: DataFrame, works: DataFrame, authors: DataFrame, options: Options = Options()) -> DataFrame:
    """From raw books and landed dump tables to one decision for each book."""
    return match_prepared(prepare_books(books), prepare_editions(editions), works, authors, options)


def pending(books: DataFrame, matches: DataFrame, matcher: str, dump: str) -> DataFrame:
    """Books without a match row, or with one of another matcher or dump version."""
    m = matches.select("book_id", F.lit(True).alias("_m"), "matcher_version", "dump_version")
    j = books.join(m, "book_id", "left")
    return j.where(F.col("_m").isNull() | (F.col("matcher_version") != matcher) | (F.col("dump_version") != dump)).select(*[books[c] for c in books.columns])
