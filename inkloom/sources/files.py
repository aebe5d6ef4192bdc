"""Files of a tree as rows, the taxonomy of formats, and the members of archives within archives."""

from __future__ import annotations

import bz2
import gzip
import io
import re
import tarfile
import unicodedata
import zipfile
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkloom.functions.text import col

# Suffixes of documents and of archives, and their formats.
DOCUMENTS = {
    ".epub": "epub", ".mobi": "mobi", ".azw3": "azw3", ".azw": "azw", ".prc": "prc", ".lit": "lit", ".fb2": "fb2", ".fb3": "fb3", ".fbz": "fb2", ".kepub": "kepub", ".pdb": "pdb",
    ".chm": "chm", ".lrf": "lrf", ".txt": "txt", ".text": "txt", ".rtf": "rtf", ".pdf": "pdf",
}
ARCHIVES = {".zip": "zip", ".tar": "tar", ".tgz": "tgz", ".gz": "gz", ".bz2": "bz2", ".tbz2": "tbz2", ".rar": "rar", ".7z": "7z"}
COMPOUND = {".tar.gz": "tgz", ".tar.bz2": "tbz2", ".fb2.zip": "fb2"}
NO_EXTENSION = "(noext)"
# Code pages that names of old zip members are tried in.
CODE_PAGES = ["cp437", "cp850", "cp852", "cp1250", "cp1252"]


def format_of_name(name: str) -> str | None:
    lower = name.lower()
    for suffix, fmt in COMPOUND.items():
        if lower.endswith(suffix):
            return fmt
    base = lower.rsplit("/", 1)[-1]
    suffix = base[base.rfind(".") :] if "." in base else ""
    return ARCHIVES.get(suffix) or DOCUMENTS.get(suffix)


def format_of(path) -> Column:
    """Format of a path by its suffix, compound suffixes first; null where it isn't known."""
    lower = F.lower(col(path))
    suffix = F.regexp_extract(lower, r"(\.[^./]*)$", 1)
    known = F.create_map(*[F.lit(x) for kv in (ARCHIVES | DOCUMENTS).items() for x in kv])
    out = F.element_at(known, suffix)
    for compound, fmt in COMPOUND.items():
        out = F.when(lower.endswith(compound), fmt).otherwise(out)
    return out


def is_archive(fmt) -> Column:
    return col(fmt).isin(*ARCHIVES.values())


def extension_key(path) -> Column:
    """What a file counts as in statistics: its format, else its suffix, else (noext); of a member, the innermost name."""
    name = F.regexp_extract(col(path), r"([^!]*)$", 1)
    plain = F.regexp_extract(F.lower(name), r"\.([^./]+)$", 1)
    return F.coalesce(format_of(name), F.when(plain != "", plain), F.lit(NO_EXTENSION))


def extension_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """ext, whether it is supported, count and share among its kind; archives don't count."""
    ext = files.select(extension_key(path).alias("ext"))
    ext = ext.where(~F.col("ext").isin(*ARCHIVES.values())).groupBy("ext").agg(F.count("*").alias("n"))
    ext = ext.withColumn("supported", F.col("ext").isin(*DOCUMENTS.values()))
    totals = ext.groupBy("supported").agg(F.sum("n").alias("total"))
    return ext.join(totals, "supported").select("ext", "supported", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("percent")).orderBy(F.desc("n"), "ext")


def walk(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, length, format (and content) of files of known formats below a root in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select("path", "length", *(["content"] if content else []))
    return files.withColumn("format", format_of("path")).where("format IS NOT NULL")


def decode_member_name(raw: bytes) -> str:
    """A zip member's name: UTF-8, or the code page whose letters are the most and of one script."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    return max((raw.decode(page, "replace") for page in CODE_PAGES), key=_name_quality)


# What a character of a kind adds to a name's quality.
NAME_WEIGHTS = {"letter": 3, "letter of another script": -6, "digit": 2, "space": 1, "punctuation": 1, "symbol": -4, "control": -20, "unreadable": -20, "other": -4}


def _name_quality(name: str) -> int:
    """High where a name is of letters of one script, digits and punctuation."""
    kind = {"N": "other", "Z": "space", "P": "punctuation", "S": "symbol"}
    scripts = Counter(unicodedata.name(c, "?").split(" ")[0] for c in name if unicodedata.category(c)[0] == "L")
    main = max(scripts, key=scripts.get, default="")

    def of(c: str) -> str:
        general = unicodedata.category(c)
        if c == "\ufffd":
            return "unreadable"
        if general[0] == "L":
            return "letter" if unicodedata.name(c, "?").split(" ")[0] == main else "letter of another script"
        if general == "Nd":
            return "digit"
        if c.isspace():
            return "space"
        return "control" if general == "Cc" else kind.get(general[0], "other")

    return sum(NAME_WEIGHTS[of(c)] for c in name)


# Letters of a language that old paths are mostly in, and what characters add to a repaired name.
ACCENTED = "áéíóöőúüűÁÉÍÓÖŐÚÜŰ"
REPAIR_WEIGHTS = {"unreadable": -50, "control": -50, "accented": 4, "letter": 2, "digit": 1}


def repair_path(raw: bytes) -> str:
    """A path whose parts between ``/``, ``\\`` and ``!`` may each be in an old code page; UTF-8 parts stay."""

    def quality(name: str) -> int:
        kinds = ("unreadable" if c == "\ufffd" else "control" if unicodedata.category(c) == "Cc" else "accented" if c in ACCENTED else "letter" if c.isalpha() else "digit" if unicodedata.category(c) == "Nd" else "" for c in name)
        return sum(REPAIR_WEIGHTS.get(k, 0) for k in kinds)

    def repair(part: bytes) -> str:
        try:
            return part.decode("utf-8")
        except UnicodeDecodeError:
            return max((part.decode(page, "replace") for page in CODE_PAGES), key=quality)

    return "".join(repair(p) if n % 2 == 0 else p.decode() for n, p in enumerate(re.split(rb"([/\\!])", raw)))


def repaired_path(raw) -> Column:
    """The repaired paths of a column of bytes; null stays null."""

    def repair(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else repair_path(bytes(x)))

    return F.pandas_udf(repair, StringType())(col(raw))


def unpack(path: str, fmt: str, data: bytes, depth: int, most: int):
    """(path, format, content, error) of what is in an archive, archives in it too; the archive itself is depth 0, and
    one at ``most`` is not opened. Members of unknown formats are left out; what can't be read is a row with its error."""
    if depth >= most:
        yield path, fmt, None, f"archives nest deeper than {most}"
        return
    try:
        for name, read, error in _members(path, fmt, data):
            inner = f"{path}!{name}"
            kind = format_of_name(name)
            if kind is None:
                continue
            if error:
                yield inner, kind, None, error
                continue
            try:
                body = read()
            except Exception as e:  # a damaged member doesn't end the archive
                yield inner, kind, None, f"{type(e).__name__}: {e}"
                continue
            if kind in ARCHIVES.values():
                yield from unpack(inner, kind, body, depth + 1, most)
            else:
                yield inner, kind, body, None
    except Exception as e:
        yield path, fmt, None, f"{type(e).__name__}: {e}"


def _members(path: str, fmt: str, data: bytes):
    if fmt == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                name = info.filename if info.flag_bits & 0x800 else decode_member_name(info.filename.encode("cp437", "replace"))
                yield name, lambda info=info: z.read(info), "encrypted" if info.flag_bits & 1 else None
    elif fmt in ("tar", "tgz", "tbz2"):
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for member in t:
                if member.isfile():
                    yield member.name, lambda member=member: t.extractfile(member).read(), None
    elif fmt in ("gz", "bz2"):
        name = path.rsplit("/", 1)[-1].rsplit("!", 1)[-1]
        yield name[: name.rfind(".")], lambda: (gzip if fmt == "gz" else bz2).decompress(data), None
    else:
        raise ValueError(f"{fmt} archives can't be read here")


def expand(files: DataFrame, max_depth: int = 3) -> DataFrame:
    """path, format, length, content and error of documents, those within archives by ``archive!member``; files have
    path, format and content. A row goes through one archive at a time, streamed from batch to batch."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, fmt, data in zip(batch["path"], batch["format"], batch["content"]):
                found = unpack(path, fmt, bytes(data), 0, max_depth) if fmt in ARCHIVES.values() else [(path, fmt, bytes(data), None)]
                for p, f, body, error in found:
                    rows.append((p, f, None if body is None else len(body), body, error))
                    if len(rows) >= 64:
                        yield pd.DataFrame(rows, columns=["path", "format", "length", "content", "error"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["path", "format", "length", "content", "error"])

    return files.select("path", "format", "content").mapInPandas(run, "path string, format string, length long, content binary, error string")
