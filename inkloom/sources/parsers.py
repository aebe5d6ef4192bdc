"""Parsers of documents: bytes to text and what they say of themselves. A registry maps formats to parsers."""

from __future__ import annotations

import codecs
import io
import re
import unicodedata
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.sources.pdf import parse_pdf

#: Encodings that are tried where bytes are neither marked nor UTF-8, the fallback first.
LEGACY = ["cp1252", "cp1250", "cp1251", "koi8-r", "iso8859-2", "cp852"]
BOMS = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
#: RTF: code pages by \\ansicpg and by \\fcharset, and destinations whose text isn't the document's.
CHARSETS = {0: "cp1252", 2: "cp1252", 128: "cp932", 129: "cp949", 134: "gb2312", 136: "big5", 161: "cp1253", 162: "cp1254", 163: "cp1258", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 222: "cp874", 238: "cp1250"}
SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "headerl", "headerr", "headerf", "footerl", "footerr", "footerf", "footnote", "annotation", "listtable", "listoverridetable", "rsidtbl", "themedata", "datastore", "xmlnstbl", "fldinst", "generator"}

SCHEMA = "path string, format string, length long, text string, title string, authors array<string>, description string, publisher string, publication_date string, subjects array<string>, languages array<string>, identifiers array<struct<scheme:string,value:string,source:string>>, error string"
EMPTY = {"text": "", "title": "", "authors": [], "description": "", "publisher": "", "publication_date": "", "subjects": [], "languages": [], "identifiers": []}


def decode_text(data: bytes) -> tuple[str, str]:
    """Text and encoding: a byte order mark, UTF-8 (a cut at the end allowed), else the legacy encoding whose result
    looks most like text."""
    for mark, name in BOMS:
        if data.startswith(mark):
            return data.decode(name, "replace"), name
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError as e:
        if e.start >= len(data) - 3 and e.reason == "unexpected end of data":
            return data[: e.start].decode("utf-8"), "utf-8"
    if data[:2000].count(0) * 4 > len(data[:2000]):
        wide = "utf-16-le" if data[1:2000:2].count(0) > data[0:2000:2].count(0) else "utf-16-be"
        return data.decode(wide, "replace"), wide

    def quality(text: str) -> float:
        high = [c for c in text[:20000] if ord(c) > 127]
        if not high:
            return 0.0
        good = sum(unicodedata.category(c)[0] == "L" for c in high) - 4 * sum(unicodedata.category(c)[0] in "CS" for c in high)
        # an upper-case letter after a lower-case one is what a wrong code page makes
        odd = len(re.findall(r"[a-zà-öø-ÿа-я][A-ZÀ-ÖØ-ÞА-Я]", text[:20000]))
        return good / len(high) - odd / len(high)

    tried = {name: data.decode(name, "replace") for name in LEGACY}
    best = max(LEGACY, key=lambda n: (round(quality(tried[n]), 2), -LEGACY.index(n)))
    return tried[best], best


def parse_txt(data: bytes) -> dict:
    return {"text": decode_text(data)[0]}


def rtf_text(data: bytes) -> tuple[str, dict[str, str]]:
    """Body text and the fields of the info group. Groups are a stack of states; hex and Unicode escapes, code pages of
    the document and of fonts, hidden text and binary data are taken into account."""
    token = re.compile(rb"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}]+)", re.S)
    page, fonts, font_now = "cp1252", {}, None
    state = {"skip": False, "hidden": False, "uc": 1, "font": None, "into": None}
    stack, out, info, pending, left = [], [], {}, bytearray(), 0
    high = ""

    def put(s: str):
        if state["into"] is not None:
            info[state["into"]] = info.get(state["into"], "") + s
        elif not state["skip"] and not state["hidden"]:
            out.append(s)

    def flush():
        if pending:
            put(bytes(pending).decode(fonts.get(state["font"], page), "replace"))
            pending.clear()

    at = 0
    while m := token.match(data, at):
        at = m.end()
        hexed, word, number, symbol, brace, plain = m.groups()
        if hexed is None:
            flush()
        if hexed is not None:
            if left > 0:
                left -= 1
            else:
                pending += bytes([int(hexed, 16)])
        elif word is not None:
            word, number = word.decode(), int(number) if number else None
            if word == "bin" and number:
                at += number
            elif word == "ansicpg" and number:
                page = f"cp{number}" if _known(f"cp{number}") else page
            elif word == "f" and number is not None:
                state["font"], font_now = number, number
            elif word == "fcharset" and font_now is not None:
                fonts[font_now] = CHARSETS.get(number or 0, page)
            elif word == "uc":
                state["uc"] = number if number is not None else 1
            elif word == "u" and number is not None:
                code = number + 65536 if number < 0 else number
                if 0xD800 <= code < 0xDC00:
                    high = chr(code)
                elif 0xDC00 <= code < 0xE000 and high:
                    put((high + chr(code)).encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
                    high = ""
                else:
                    put(chr(code))
                left = state["uc"]
                continue
            elif word == "v":
                state["hidden"] = number != 0
            elif word in ("par", "line", "row", "sect", "page"):
                put("\n")
            elif word in ("tab", "cell"):
                put("\t")
            elif word in ("emdash", "endash", "lquote", "rquote", "ldblquote", "rdblquote", "bullet"):
                put({"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}[word])
            elif word == "info":
                state["skip"] = True
            elif word in ("title", "author", "subject", "keywords", "doccomm", "company") and state["skip"] and stack:
                state["into"] = word
            elif word in SKIPPED:
                state["skip"] = True
            left = 0
        elif symbol is not None:
            if symbol == b"*":
                state["skip"] = True
            elif symbol in (b"\n", b"\r"):
                put("\n")
            elif symbol == b"~":
                put(" ")
            elif symbol in (b"\\", b"{", b"}"):
                put(symbol.decode())
        elif brace == b"{":
            stack.append(dict(state))
            left = 0
        elif brace == b"}":
            state = stack.pop() if stack else state
            left = 0
        elif plain is not None:
            body = plain.replace(b"\r", b"").replace(b"\n", b"")
            drop, left = min(left, len(body)), max(0, left - len(body))
            put(body[drop:].decode(fonts.get(state["font"], page), "replace"))
    flush()
    return "".join(out), {k: v.strip() for k, v in info.items()}


def _known(name: str) -> bool:
    try:
        codecs.lookup(name)
        return True
    except LookupError:
        return False


def parse_rtf(data: bytes) -> dict:
    if not data.lstrip().startswith(b"{\\rtf"):
        raise ValueError("no RTF header")
    text, info = rtf_text(data)
    authors = [a.strip() for a in re.split(r"[;&]| and ", info.get("author", "")) if a.strip()]
    subjects = list(dict.fromkeys(s.strip() for f in ("subject", "keywords") for s in re.split(r"[;,]", info.get(f, "")) if s.strip()))
    return {"text": text, "title": info.get("title", ""), "authors": authors, "description": info.get("doccomm", ""), "publisher": info.get("company", ""), "subjects": subjects}


def parse_epub(data: bytes) -> dict:
    """Metadata of the package document, and the text of its spine in reading order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
        folder = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
        values: dict[str, list] = {}
        items, spine = {}, []
        for e in package.iter():
            tag = e.tag.rsplit("}", 1)[-1]
            if tag == "item":
                items[e.get("id")] = e.get("href")
            elif tag == "itemref":
                spine.append(e.get("idref"))
            elif e.text and e.text.strip() and "purl.org/dc/" in e.tag:
                values.setdefault(tag, []).append((e.text.strip(), e))
        texts = []
        for ref in spine:
            if (name := items.get(ref)) and folder + name in z.namelist():
                texts.append(html_text(z.read(folder + name).decode("utf-8", "replace")))
    first = lambda t: values[t][0][0] if t in values else ""
    every = lambda t: [v for v, _ in values.get(t, [])]
    numbers = []
    for v, e in values.get("identifier", []):
        scheme = next((x for k, x in e.attrib.items() if k.endswith("scheme")), "") or ("ISBN" if re.search(r"(?i)isbn|^97[89]\d{10}$", v) else "")
        numbers.append({"scheme": scheme.upper(), "value": re.sub(r"(?i)^urn:isbn:", "", v), "source": "METADATA"})
    return {"text": "\n".join(texts), "title": first("title"), "authors": every("creator"), "description": first("description"), "publisher": first("publisher"), "publication_date": first("date"), "subjects": every("subject"), "languages": every("language"), "identifiers": numbers}


def parse_fb2(data: bytes) -> dict:
    """Metadata of the description and the text of the bodies; a packed file is its first member of that kind."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            data = z.read(next(n for n in z.namelist() if n.lower().endswith(".fb2")))
    root = ElementTree.fromstring(data)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    inside = lambda e, name: [x for x in e.iter() if local(x) == name] if e is not None else []
    text = lambda es: next((" ".join("".join(e.itertext()).split()) for e in es), "")
    info, publish = next(iter(inside(root, "title-info")), None), next(iter(inside(root, "publish-info")), None)
    authors = [" ".join(filter(None, (text(inside(a, n)) for n in ("first-name", "middle-name", "last-name")))) or text(inside(a, "nickname")) for a in inside(info, "author")]
    lines = ["".join(x.itertext()) for b in inside(root, "body") for x in b.iter() if local(x) in ("p", "v", "subtitle")]
    isbn = text(inside(publish, "isbn"))
    date = next((d.get("value") or " ".join("".join(d.itertext()).split()) for d in inside(info, "date")), "") or text(inside(publish, "year"))
    return {
        "text": "\n".join(lines), "title": text(inside(info, "book-title")), "authors": [a for a in authors if a], "description": text(inside(info, "annotation")), "publisher": text(inside(publish, "publisher")), "publication_date": date,
        "subjects": [g for g in (text([x]) for x in inside(info, "genre")) if g], "languages": [v for v in (text([x]) for x in inside(info, "lang")) if v], "identifiers": [{"scheme": "ISBN", "value": isbn, "source": "METADATA"}] if isbn else [],
    }


def html_text(s: str) -> str:
    """Text of HTML: script, style and head dropped, blocks as lines, entities decoded."""
    from html import unescape

    s = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>", " ", s)
    s = re.sub(r"(?i)<(?:/p|br|/div|/h[1-6]|/li|/tr)[^>]*>", "\n", s)
    return "\n".join(filter(None, (re.sub(r"\s+", " ", line).strip() for line in unescape(re.sub(r"(?s)<!--.*?-->|<[^>]*>", " ", s)).split("\n"))))


def unsupported(name: str) -> Callable[[bytes], dict]:
    def parse(data: bytes) -> dict:
        raise ValueError(f"{name} files can't be read here")

    return parse


#: Parsers by format; add one to read another.
PARSERS: dict[str, Callable[[bytes], dict]] = {"txt": parse_txt, "rtf": parse_rtf, "epub": parse_epub, "kepub": parse_epub, "fb2": parse_fb2, "pdf": parse_pdf} | {
    f: unsupported(f) for f in ("mobi", "azw", "azw3", "prc", "lit", "fb3", "pdb", "chm", "lrf")
}


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], dict]] | None = None) -> DataFrame:
    """Rows (path, format, length, content, error) with content parsed; what fails is a row with its error."""
    registry = parsers or PARSERS

    def run(batches):
        for batch in batches:
            rows = []
            for path, fmt, length, data, error in zip(batch["path"], batch["format"], batch["length"], batch["content"], batch["error"]):
                got: dict = {}
                if error is None and data is not None:
                    try:
                        got = registry[fmt](bytes(data))
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                rows.append({"path": path, "format": fmt, "length": length} | EMPTY | got | {"error": error})
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.replace("array<struct<scheme:string,value:string,source:string>>", "x").split(", ")])

    return files.mapInPandas(run, SCHEMA)


def failures(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select("path", "error").orderBy("path")
