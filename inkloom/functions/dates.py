"""Partial dates and language tags as column expressions. An empty string means that nothing is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.text import col

# Layouts of publication dates in bibliographic dumps, and how much of a date each gives.
DUMP_LAYOUTS = [
    ("MMMM d, yyyy", "yyyy-MM-dd"), ("MMM d, yyyy", "yyyy-MM-dd"), ("MMMM yyyy", "yyyy-MM"), ("MMM yyyy", "yyyy-MM"),
    ("d MMMM yyyy", "yyyy-MM-dd"), ("d MMM yyyy", "yyyy-MM-dd"), ("d MMMM, yyyy", "yyyy-MM-dd"), ("d MMM, yyyy", "yyyy-MM-dd"),
]
# MARC language codes and their ISO 639-1 codes.
MARC = {
    "eng": "en", "fre": "fr", "fra": "fr", "ger": "de", "deu": "de", "spa": "es", "ita": "it", "hun": "hu", "rus": "ru", "por": "pt", "dut": "nl", "nld": "nl", "pol": "pl",
    "swe": "sv", "dan": "da", "nor": "no", "fin": "fi", "cze": "cs", "ces": "cs", "rum": "ro", "ron": "ro", "gre": "el", "ell": "el", "lat": "la", "jpn": "ja", "chi": "zh",
    "zho": "zh", "kor": "ko", "ara": "ar", "heb": "he", "tur": "tr", "ukr": "uk", "cat": "ca", "hrv": "hr", "srp": "sr", "slv": "sl", "slo": "sk", "slk": "sk", "bul": "bg",
}


def _year_ok(y: Column) -> Column:
    return y.try_cast("int").between(1000, F.year(F.current_date()) + 1)


def publication_date(c) -> Column:
    """yyyy, yyyy-MM or yyyy-MM-dd of a publication date; date and time give the date; anything else is empty."""
    s = F.trim(col(c))
    day = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$", 1)
    good_day = (day != "") & F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull()
    out = F.when(s.rlike(r"^\d{4}$") | s.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), s).when(good_day, day).otherwise("")
    return F.when((out != "") & _year_ok(F.substring(out, 1, 4)), out).otherwise("")


def dump_date(c) -> Column:
    """Publication dates of the dump, in words or figures, in the same partial forms."""
    s = F.regexp_replace(F.trim(col(c)), r"\s+", " ")
    out = F.lit("")
    for layout, mask in reversed(DUMP_LAYOUTS):
        t = F.try_to_timestamp(s, F.lit(layout))
        out = F.when(t.isNotNull() & _year_ok(F.date_format(t, "yyyy")), F.date_format(t, mask)).otherwise(out)
    plain = publication_date(s)
    return F.when(plain != "", plain).otherwise(out)


def document_date(c) -> Column:
    """Dates of document information, ``D:yyyyMMdd…`` among them; what can't be read stays as it is."""
    s = F.trim(col(c))
    digits = F.regexp_extract(s, r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?", 0)
    d = F.regexp_replace(digits, "^D:", "")
    packed = F.when(F.length(d) >= 8, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).when(F.length(d) == 6, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2))).when(F.length(d) == 4, d)
    plain = publication_date(s)
    return F.when(plain != "", plain).when(s.startswith("D:") & packed.isNotNull(), packed).otherwise(s)


def language_tag(c) -> Column:
    """A language tag in its canonical case; undetermined, multiple and empty ones are empty."""
    s = F.regexp_replace(F.trim(col(c)), "_", "-")
    parts = F.split(s, "-")
    cased = F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).when(F.length(p) == 4, F.initcap(F.lower(p))).when(F.length(p) == 2, F.upper(p)).otherwise(F.lower(p)))
    out = F.array_join(cased, "-")
    good = s.rlike(r"^(?i)[a-z]{2,3}(-[a-z0-9]{2,8})*$") & ~F.lower(parts[0]).isin("und", "mul", "zxx", "mis")
    return F.when(good, out).otherwise("")


def marc_language(key) -> Column:
    """``/languages/eng`` as ``en``; empty where the code isn't known."""
    code = F.lower(F.regexp_extract(col(key), r"([^/]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in MARC.items() for x in kv])
    return F.coalesce(F.element_at(known, code), F.lit(""))


def reconcile_language(declared, detected, confidence) -> Column:
    """Declared languages in the light of a detected one: under 0.5 nothing changes, none declared is filled, a
    declared one of the same base stays, and from 0.75 on the detected one replaces the rest."""
    declared, detected, confidence = col(declared), col(detected), col(confidence)
    base = lambda t: F.split(F.lower(t), "-")[0]
    same = F.exists(declared, lambda t: base(t) == base(detected))
    return F.when((confidence < 0.5) | (detected == "") | same, declared).when((F.size(declared) == 0) | (confidence >= 0.75), F.array(detected)).otherwise(declared)
