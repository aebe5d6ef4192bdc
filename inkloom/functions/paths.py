"""What file paths say of books: archive boundaries, stems, Calibre and natural names, source groups, folders of authors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.text import article_to_front, col, fold_latin, let, normalize, phrase_in, title_key, title_tokens
from inkloom.functions.titles import is_artifact_title, is_placeholder_author, is_placeholder_title, name_score, title_score

# Suffixes that are cut from names, and those that make a "!" the border of an archive.
EBOOK = r"(?i)\.(epub|mobi|azw3|azw|prc|pdf|fb2|djvu|txt|text|rtf)$"
BORDER = r"(?i)^(.*\.(?:zip|tar|tgz|tar\.gz|gz|tar\.bz2|tbz2|bz2|rar|7z))!"
# Words of folders that name no person.
GENERIC = ["books", "ebooks", "library", "konyvek", "konyvtar", "download", "downloads", "calibre", "various", "misc", "temp", "new", "archive", "texts", "documents"]


def member_name(path) -> Column:
    """The part of a display path after its last archive, the whole path where there is none; other "!" stay."""
    return F.regexp_replace(col(path), BORDER, "")


def archives(path) -> Column:
    """Names of the archives that a path goes through, outermost first."""
    parts = F.split(F.regexp_replace(col(path), r"(?i)(\.(?:zip|tar|tgz|gz|bz2|tbz2|rar|7z))!", "$1\u0000"), "\u0000")
    return F.slice(parts, 1, F.size(parts) - 1)


def stem(path) -> Column:
    """File name without folders, archives and a known suffix, underscores as spaces."""
    name = F.regexp_extract(member_name(path), r"([^/]*)$", 1)
    return F.replace(F.regexp_replace(name, EBOOK, ""), F.lit("_"), F.lit(" "))


def title_from_path(path) -> Column:
    return normalize(stem(path))


def source_group(path) -> Column:
    """Where a file comes from, for telling independent sources: the outermost archive, or the folder."""
    a = archives(path)
    return F.when(F.size(a) > 0, a[0]).otherwise(F.regexp_replace(col(path), r"/?[^/]*$", ""))


def calibre(path) -> Column:
    """title and author of ``Title - Last, First``; empty where the shape isn't strictly that."""
    m = r"^(.+) - ([^,\-]+), ([^,\-]+)$"
    none = F.struct(F.lit("").alias("title"), F.lit("").alias("author"))

    def read(s, author):
        return F.when(name_score(author) >= 3, F.struct(article_to_front(F.trim(F.regexp_extract(s, m, 1))).alias("title"), author.alias("author"))).otherwise(none)

    author = lambda s: F.concat_ws(" ", F.trim(F.regexp_extract(s, m, 3)), F.trim(F.regexp_extract(s, m, 2)))
    return let(title_from_path(path), lambda s: F.when(s.rlike(m), let(author(s), lambda a: read(s, a))).otherwise(none))


def natural(path) -> Column:
    """title and author of ``Author - Title`` or the other way round; nothing where both sides could be either."""
    none = F.struct(F.lit("").alias("title"), F.lit("").alias("author"))
    person = lambda x: (name_score(x) >= 3) & ~is_placeholder_author(x)
    read = lambda title, author: F.struct(article_to_front(title).alias("title"), author.alias("author"))

    def sides(left, right):
        both = F.struct(person(left).alias("l"), person(right).alias("r"))
        return let(both, lambda p: F.when(p["l"] & ~p["r"] & (right != ""), read(right, left)).when(p["r"] & ~p["l"] & (left != ""), read(left, right)).otherwise(none))

    return let(F.split(title_from_path(path), r"\s+[-–—]\s+"), lambda parts: F.when(F.size(parts) == 2, sides(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(none))


def folder_author(path) -> Column:
    """The nearest folder that looks like a person's name, empty where none does or it is part of the title."""
    folders = F.reverse(F.filter(F.split(F.regexp_replace(F.regexp_replace(col(path), r"[^/!]*$", ""), r"(?i)\.(zip|tar|tgz|gz|bz2|tbz2|rar|7z)!", "/"), "/"), lambda p: p != ""))
    clean = F.transform(folders, lambda p: normalize(F.regexp_replace(F.regexp_replace(p, "_", " "), r"\s*[\[(][^\])]*[\])]\s*$", "")))
    persons = F.filter(clean, lambda p: ~fold_latin(p).rlike(r"\b(" + "|".join(GENERIC) + r")\b") & (name_score(p) >= 3) & ~phrase_in(title_key(p), title_key(stem(path))))
    return F.coalesce(F.get(persons, F.lit(0)), F.lit(""))


def wash_author(title, author) -> Column:
    """A title without its author before a dash at its front, after a dash at its end, or after ``by``. The part has to
    have the words of the author's name, in any order; nothing changes where nothing, or no title, would be left."""
    front, back, by = r"^(.+?)(?:\s+[-–—]+\s*|\s*[-–—]+\s+)(.+)$", r"^(.+)(?:\s+[-–—]+\s*|\s*[-–—]+\s+)(.+?)$", r"(?i)^(.+)\sby\s(.+)$"
    edges = F.lit(" \t-–—,.;:!?()[]\"'/_")

    def washed(t, name):
        part = lambda pattern, k: F.trim(F.regexp_extract(t, pattern, k))
        cut = lambda pattern, k: t.rlike(pattern) & (F.size(name) > 0) & (title_tokens(part(pattern, k)) == name)
        out = F.when(cut(front, 1), part(front, 2)).when(cut(back, 2), part(back, 1)).when(cut(by, 2), part(by, 1)).otherwise(t)
        return let(normalize(F.btrim(out, edges)), lambda o: F.when((o == "") | is_placeholder_title(o), t).when(o == F.btrim(t, edges), t).otherwise(o))

    return let(normalize(title), lambda t: let(title_tokens(author), lambda name: washed(t, name)))


def calibre_author(path) -> Column:
    """The author of ``Title - Last, First`` or ``Title - First Last``, where only he is wanted: the part after the last
    dash, if it looks like a name and no other part does; empty else."""

    def read(parts, last):
        turned = F.when(last.rlike(r"^[^,]+, [^,]+$"), F.regexp_replace(last, r"^([^,]+), ([^,]+)$", "$2 $1")).otherwise(last)
        others = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: name_score(p) >= 3)
        return let(turned, lambda x: F.when((F.size(parts) >= 2) & (name_score(x) >= 3) & ~is_placeholder_author(x) & ~others, x).otherwise(""))

    return let(F.split(title_from_path(path), r"\s+[-–—]\s+"), lambda parts: read(parts, F.element_at(parts, -1)))


def archive_reading(path) -> Column:
    """title and author of the natural reading of the name of the archive that a path goes through last."""
    outer = let(archives(path), lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit("")))
    return natural(F.regexp_replace(outer, r"(?i)(\.tar)?\.[a-z0-9]+$", ""))


def hypotheses(path) -> Column:
    """What a path may say: (kind, title, author) of the strict, the natural and the bare reading of its name, of its
    folder and of the archive it is in; readings that say nothing are left out."""
    make = lambda kind, title, author: F.struct(F.lit(kind).alias("kind"), title.alias("title"), author.alias("author"))
    read = lambda kind, found: let(found, lambda x: make(kind, x["title"], x["author"]))
    name = let(title_from_path(path), lambda plain: F.when(~is_artifact_title(plain) & (title_score(plain) > -10), plain).otherwise(""))
    rows = F.array(read("calibre", calibre(path)), read("natural", natural(path)), make("name", name, F.lit("")), make("folder", F.lit(""), folder_author(path)), read("archive", archive_reading(path)))
    return F.filter(rows, lambda r: (r["title"] != "") | (r["author"] != ""))
