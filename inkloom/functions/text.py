"""Text keys and tokens as column expressions: normal forms, folds, token sets and their similarity.

Everything stays in the JVM. Letters that carry marks are mapped by ``translate`` with tables built from Unicode's own
decompositions; marks that stand alone are removed by pattern.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that have no decomposition, and what they fold to.
LEFTOVERS = {"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "þ": "th", "ı": "i"}
# Particles of personal names that say nothing about the person.
NAME_PARTICLES = ["van", "von", "del", "dos", "das", "der", "den", "ter", "ten"]
# Words too frequent to tell one title from another.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "he", "her", "his", "if", "in", "into", "is", "it", "its", "no", "not", "of", "on", "or", "over",
    "so", "than", "that", "the", "then", "these", "this", "those", "to", "was", "were", "will", "with", "de", "la", "le", "les", "el", "los", "las", "un", "una", "und", "der",
    "die", "das", "des", "dem", "den", "et", "en", "du", "au", "aux", "sur",
]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def _tables(latin_only: bool) -> tuple[str, str]:
    """Letters with marks and the letters without, for ``translate``."""
    have, give = [], []
    for n in range(0xC0, min(0x10000, sys.maxunicode)):
        if 0xD800 <= n < 0xE000 or 0xAC00 <= n < 0xD7A4:
            continue
        ch = chr(n)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) < 2 or any(unicodedata.category(p) != "Mn" for p in parts[1:]) or unicodedata.category(parts[0]) == "Mn":
            continue
        if latin_only and not unicodedata.name(parts[0], "").startswith("LATIN"):
            continue
        have.append(ch)
        give.append(parts[0])
    return "".join(have), "".join(give)


def let(value, body) -> Column:
    """body(value) with the value made once, however often the body names it. Expressions are trees, so that what is named
    twice in one is otherwise made twice, and what is named twice on each of ten levels a thousand times."""
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))


def is_ascii(c) -> Column:
    """Whether there is nothing that folding could change."""
    return F.length(col(c)) == F.octet_length(col(c))


def normalize(c) -> Column:
    """Without white space at the ends, and with one space for each run inside."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def meta_key(c) -> Column:
    """Lower-cased normal form, for comparing metadata."""
    return F.lower(normalize(c))


def fold_latin(c) -> Column:
    """Lower-cased normal form with Latin letters bare of their marks; other scripts keep theirs."""

    def fold(m):
        out = F.regexp_replace(F.translate(m, *_tables(True)), r"(\p{IsLatin})\p{Mn}+", "$1")
        for a, b in LEFTOVERS.items():
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.when(is_ascii(m), m).otherwise(out)

    return let(meta_key(c), fold)


def fold_marks(s: Column) -> Column:
    """Lower case without the marks of all scripts, of what is a normal form already."""
    return let(F.lower(s), lambda m: F.when(is_ascii(m), m).otherwise(F.regexp_replace(F.translate(m, *_tables(False)), r"\p{Mn}+", "")))


def fold_all(c) -> Column:
    """Lower-cased normal form with the marks of all scripts removed."""
    return fold_marks(normalize(c))


def title_key(c) -> Column:
    """What two spellings of a title have in common: folded letters, digits and marks, single spaces."""
    return F.trim(F.regexp_replace(fold_latin(c), r"[^\p{L}\p{N}\p{M}]+", " "))


def tokens_of_key(key: Column) -> Column:
    return let(key, lambda k: F.when(k == "", F.array().cast("array<string>")).otherwise(F.sort_array(F.array_distinct(F.split(k, " ")))))


def title_tokens(c) -> Column:
    return tokens_of_key(title_key(c))


def author_words(tokens) -> Column:
    """Of title tokens, those of three characters and more that are no particle."""
    return F.filter(col(tokens), lambda t: (F.length(t) > 2) & ~t.isin(NAME_PARTICLES))


def content_words(tokens) -> Column:
    """Of title tokens, those that aren't too frequent."""
    return F.filter(col(tokens), lambda t: ~t.isin(STOP_WORDS))


def author_tokens(c) -> Column:
    """Tokens of three characters and more that are no particle."""
    return author_words(title_tokens(c))


def content_tokens(c) -> Column:
    return content_words(title_tokens(c))


def match_tokens(c) -> Column:
    """Tokens longer than two characters in the order they are met, particles left out."""
    words = F.split(F.regexp_replace(fold_latin(c), r"[\s.,;:!?'\"()\[\]{}_\-–—/&+]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(NAME_PARTICLES)))


def token_hashes(tokens) -> Column:
    """64-bit hashes of tokens, sorted, each once."""
    return F.array_sort(F.array_distinct(F.transform(col(tokens), lambda t: F.xxhash64(t))))


def jaccard(a, b) -> Column:
    """Share of common members of two token sets; 0 where either is empty."""
    a, b = col(a), col(b)
    share = let(F.size(F.array_intersect(a, b)), lambda common: common / (F.size(a) + F.size(b) - common))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def jaccard_bound(a, b) -> Column:
    """The most that sets of these sizes can reach."""
    a, b = col(a), col(b)
    return F.when((a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def containment(tokens, of) -> Column:
    """Share of tokens that the other set holds; 0 where there are none."""
    of = col(of)
    return let(tokens, lambda t: F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.array_intersect(t, of)) / F.size(t)))


def phrase_in(a: Column, b: Column) -> Column:
    """Whether key a's words occur in key b in a row."""
    return F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))


def titles_agree(a, b) -> Column:
    """Equal keys, or one's words, two at least, in a row within the other."""

    def agree(a, b):
        words = F.least(F.size(F.split(a, " ")), F.size(F.split(b, " ")))
        inside = F.when(F.length(a) <= F.length(b), phrase_in(a, b)).otherwise(phrase_in(b, a))
        return (a != "") & (b != "") & ((a == b) | ((words >= 2) & inside))

    return let(title_key(a), lambda x: let(title_key(b), lambda y: agree(x, y)))


def numbers_of(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(r"^\p{N}+$"))


def titles_equivalent(a, b) -> Column:
    """Equal keys, or the one's content tokens among the other's, two at least in each, with the same numbers."""

    def inside(ta, tb):
        least = F.least(F.size(ta), F.size(tb))
        return (least >= 2) & (F.size(F.array_intersect(ta, tb)) == least) & (numbers_of(ta) == numbers_of(tb))

    held = lambda ka, kb: let(content_words(tokens_of_key(ka)), lambda ta: let(content_words(tokens_of_key(kb)), lambda tb: inside(ta, tb)))
    return let(title_key(a), lambda ka: let(title_key(b), lambda kb: ((ka == kb) & (ka != "")) | held(ka, kb)))


def authors_equivalent(a, b) -> Column:
    """One's tokens among the other's; none matches none."""

    def within(ta, tb):
        least = F.least(F.size(ta), F.size(tb))
        return (least > 0) & (F.size(F.array_intersect(ta, tb)) == least)

    return let(author_tokens(a), lambda ta: let(author_tokens(b), lambda tb: within(ta, tb)))


def article_to_front(c) -> Column:
    """``Title, The`` as ``The Title``."""
    return F.regexp_replace(col(c), r"(?i)^(.+), (the|a|an|der|die|das|le|la|les|el|los|las)$", "$2 $1")


def sanitize_query(raw: str) -> str:
    """Letter and number runs of a search string without the words AND, OR and NOT; an error where nothing is left."""
    words = "".join(ch if unicodedata.category(ch)[0] in "LN" else " " for ch in raw).split()
    words = [w for w in words if w.upper() not in ("AND", "OR", "NOT")]
    if not words:
        raise ValueError("empty search query")
    return " ".join(words)


def clean_control(c) -> Column:
    """Without ASCII control characters but tab, line feed and carriage return."""
    return F.regexp_replace(col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def head(c, most: int = 65536) -> Column:
    """The first so many bytes of a text, without a character that is cut. The cut is moved to where a character begins:
    no part of one is ever decoded, which Spark takes for an error."""
    raw = col(c).cast("binary")
    inside = lambda at: F.hex(F.substring(raw, at, 1)).between("80", "BF")  # noqa: E731  a byte that goes on with a character
    size = F.when(~inside(most + 1), most).when(~inside(most), most - 1).when(~inside(most - 1), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(col(c)) <= most, col(c)).otherwise(F.substring(raw, F.lit(1), size).cast("string"))


def plain_text(c) -> Column:
    """Text of an HTML fragment: script, style and head dropped, tags as spaces, entities of common use decoded."""
    out = F.regexp_replace(col(c), r"(?is)<(script|style|head)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, value in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}.items():
        out = F.replace(out, F.lit(entity), F.lit(value))
    return normalize(out)


def encode_list(c) -> Column:
    """A list as JSON text, for stores without lists; null and empty lists are ``[]``."""
    return F.coalesce(F.to_json(col(c)), F.lit("[]"))


def decode_list(c) -> Column:
    """The list in JSON text; empty where there is none or it can't be read."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


def human_size(c) -> Column:
    """Bytes in the largest unit that leaves one at least."""
    c = col(c)
    out = F.format_string("%d B", c.cast("long"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(c >= 1024**k, F.format_string(f"%.1f {unit}", c / float(1024**k))).otherwise(out)
    return out


def percent(part, whole) -> Column:
    return F.when(col(whole) == 0, F.lit("0.0%")).otherwise(F.format_string("%.1f%%", 100.0 * col(part) / col(whole)))
