"""What PDF files say of themselves: the document information dictionary and the XMP packet, and which of them counts.

Only metadata is read, in Python and without outside tools; page text isn't. Objects are found by scanning the file, so
damaged cross-reference tables don't matter, and objects within compressed object streams are unpacked.
"""

from __future__ import annotations

import codecs
import re
import zlib
from datetime import datetime, timedelta, timezone
from xml.etree import ElementTree

NAMES = {"Title": "title", "Author": "author", "Subject": "description", "Keywords": "keywords", "ModDate": "modified"}
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: So many bytes are unpacked of one stream at most.
MOST = 64 << 20


def decode_text(raw: bytes) -> str:
    """A text string: by its byte order mark, by its zero bytes, as UTF-8, else as Windows-1252; empty where it holds
    what no encoding gives."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF16_LE, "utf-16-le")):
        if raw.startswith(mark):
            out = raw[len(mark) :].decode(name, "replace")
            break
    else:
        even, odd = raw[0::2].count(0), raw[1::2].count(0)
        half = (len(raw) // 2 + 1) // 2
        if len(raw) >= 4 and max(even, odd) >= max(1, half) and max(even, odd) > 2 * min(even, odd):
            out = raw.decode("utf-16-be" if even > odd else "utf-16-le", "replace")
        else:
            try:
                out = raw.decode("utf-8")
            except UnicodeDecodeError:
                out = raw.decode("cp1252", "replace")
    return "" if "\0" in out or "\ufffd" in out else out


def unescape(body: bytes) -> bytes:
    """Bytes of a literal string's body; unknown escapes keep the character."""

    def one(m: re.Match) -> bytes:
        c = m[1]
        if c[:1] in b"01234567":
            return bytes([int(c, 8) & 255])
        return b"" if c in (b"\n", b"\r\n", b"\r") else ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|[\s\S])", one, body)


def escaped_text(s: str) -> str:
    """A value in which a tool left octal escapes, decoded; other values, backslashes and all, as they are."""
    return decode_text(unescape(s.encode("latin-1", "replace"))) if re.search(r"\\[0-7]{3}|\0", s) else s


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The literal string that opens at a bracket, brackets within it balanced, and where it ends."""
    depth, i = 0, at
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            i += 1
        elif c == b"(":
            depth += 1
        elif c == b")":
            depth -= 1
            if not depth:
                return unescape(data[at + 1 : i]), i + 1
        i += 1
    return b"", i


def _strings(body: bytes) -> dict[str, bytes]:
    """Name and value of the string entries of a dictionary."""
    out, at = {}, 0
    entry = re.compile(rb"/([A-Za-z]+)\s*(\(|<(?!<)([0-9A-Fa-f\s]*)>)")
    while m := entry.search(body, at):
        name, at = m[1].decode(), m.end()
        if m[2] == b"(":
            value, at = _literal(body, m.end() - 1)
        else:
            digits = re.sub(rb"\s", b"", m[3])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        out.setdefault(name, value)
    return out


def _unpacked(head: bytes, body: bytes) -> bytes:
    return zlib.decompressobj().decompress(body, MOST) if b"FlateDecode" in head else body


def objects(data: bytes) -> dict[int, bytes]:
    """Objects by number, the last of each, with those in object streams."""
    found: dict[int, bytes] = {}
    for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b([\s\S]*?)\bendobj", data):
        found[int(m[1])] = m[2]
    for body in list(found.values()):
        if b"/ObjStm" not in body[:400] or b"stream" not in body:
            continue
        head, _, rest = body.partition(b"stream")
        n, first = re.search(rb"/N\s+(\d+)", head), re.search(rb"/First\s+(\d+)", head)
        try:
            text = _unpacked(head, rest.lstrip(b"\r\n"))
        except zlib.error:
            continue
        if n and first:
            places = [int(x) for x in text[: int(first[1])].split()[: 2 * int(n[1])]]
            starts = [int(first[1]) + p for p in places[1::2]]
            for number, a, b in zip(places[0::2], starts, [*starts[1:], len(text)]):
                found.setdefault(number, text[a:b])
    return found


def _date(s: str) -> datetime | None:
    """A moment from either notation, with its zone; UTC where none is given."""
    m = re.match(r"(?:D:)?(\d{4})-?(\d\d)?-?(\d\d)?[T ]?(\d\d)?:?(\d\d)?:?(\d\d)?(?:\.\d+)?\s*(?:Z|([+-])(\d\d)'?:?(\d\d)?)?", s.strip())
    if not m:
        return None
    try:
        at = datetime(*(int(x or d) for x, d in zip(m.groups()[:6], (1, 1, 1, 0, 0, 0))), tzinfo=timezone.utc)
    except ValueError:
        return None
    shift = timedelta(hours=int(m[8] or 0), minutes=int(m[9] or 0))
    return at + shift if m[7] == "-" else at - shift


def read_info(data: bytes) -> dict:
    """Fields of the information dictionary."""
    found = objects(data)
    trailers = [m[1] for m in re.finditer(rb"/Info\s+(\d+)\s+\d+\s+R", data)]
    entries = _strings(found.get(int(trailers[-1]), b"")) if trailers else {}
    return {field: escaped_text(decode_text(entries[name]).strip()) for name, field in NAMES.items() if name in entries}


def read_xmp(packet: bytes | str) -> dict:
    """Fields of an XMP packet; an error where it isn't XML."""
    root = ElementTree.fromstring(packet)
    local = lambda tag: tag.rsplit("}", 1)[-1]

    def values(name: str) -> list[str]:
        out = []
        for e in root.iter():
            if local(e.tag) == name:
                items = [i.text for i in e.iter() if local(i.tag) == "li"]
                out += [x.strip() for x in (items or [e.text]) if x and x.strip()]
            out += [v.strip() for k, v in e.attrib.items() if local(k) == name and v.strip()]
        return [escaped_text(v) for v in out]

    first = lambda name: next(iter(values(name)), "")
    return {
        "title": first("title"), "authors": values("creator"), "description": first("description"), "subjects": values("subject") or _subjects(first("Keywords")), "publisher": first("publisher"),
        "publication_date": first("date") or first("CreateDate"), "languages": values("language"), "identifiers": [v for n in ("identifier", "isbn", "doi") for v in values(n)], "dated": first("MetadataDate") or first("ModifyDate"),
    }


def _subjects(s: str) -> list[str]:
    return list(dict.fromkeys(x.strip() for x in re.split(r"[;,]", s) if x.strip()))


def merge(info: dict, xmp: dict) -> dict:
    """Field by field: XMP, unless the information dictionary was changed later; the other fills what is missing."""
    mine = {"title": info.get("title", ""), "authors": [a.strip() for a in re.split(r"[;&]| and ", info.get("author", "")) if a.strip()], "description": info.get("description", ""), "subjects": _subjects(info.get("keywords", ""))}
    changed, dated = _date(info.get("modified", "")), _date(xmp.get("dated", ""))
    newer = changed is not None and dated is not None and changed > dated
    first, second = (mine, xmp) if newer else (xmp, mine)
    fields = ("title", "authors", "description", "subjects", "publisher", "publication_date", "languages")
    out = {f: first.get(f) or second.get(f) or ([] if f in ("authors", "subjects", "languages") else "") for f in fields}
    said = [*xmp.get("identifiers", []), *info.values()]
    numbers = [re.sub(r"[\s-]", "", n) for s in said for n in re.findall(r"(?<![0-9])(?:97[89][\s-]?)?(?:[0-9][\s-]?){9}[0-9Xx](?![0-9])", s)]
    dois = [re.sub(r"[.,;)]+$", "", d) for s in said for d in re.findall(r"10\.[0-9]{4,9}/[^\s\"<>]+", s)]
    out["identifiers"] = [{"scheme": k, "value": v, "source": "METADATA"} for k, vs in (("ISBN", numbers), ("DOI", dois)) for v in dict.fromkeys(vs)]
    return out


def parse_pdf(data: bytes) -> dict:
    """Metadata of a file, with an empty text; encrypted files and what is no PDF are errors."""
    if b"%PDF-" not in data[:1024]:
        raise ValueError("no PDF header")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise ValueError("encrypted")
    packets = re.findall(rb"<x:xmpmeta[\s\S]*?</x:xmpmeta>", data)
    if not packets:
        for body in objects(data).values():
            head, _, rest = body.partition(b"stream")
            if b"/XML" in head and b"/Metadata" in head:
                try:
                    packets = re.findall(rb"<x:xmpmeta[\s\S]*?</x:xmpmeta>", _unpacked(head, rest.lstrip(b"\r\n")))
                except zlib.error:
                    packets = []
    xmp = {}
    if packets:
        try:
            xmp = read_xmp(packets[-1])
        except ElementTree.ParseError:  # the dictionary still counts
            xmp = {}
    return merge(read_info(data), xmp)
