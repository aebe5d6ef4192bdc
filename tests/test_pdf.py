"""PDF and FB2 metadata from hand-made files."""

import zlib

import pytest

from inkloom.sources import parsers, pdf


def document(info: bytes, xmp: bytes = b"", packed: bool = False) -> bytes:
    head = b"%PDF-1.5\n"
    if packed:
        body = b"7 0 " + info
        stream = zlib.compress(body)
        objects = b"9 0 obj << /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length %d >> stream\n" % len(stream) + stream + b"\nendstream endobj\n"
    else:
        objects = b"7 0 obj " + info + b" endobj\n"
    if xmp:
        objects += b"8 0 obj << /Type /Metadata /Subtype /XML >> stream\n" + xmp + b"\nendstream endobj\n"
    return head + objects + b"trailer << /Info 7 0 R >>\n%%EOF"


def packet(title="From XMP", dated="2020-05-01T10:00:00Z", rest=""):
    return f"""<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xmp="http://ns.adobe.com/xap/1.0/">
    <rdf:Description xmp:MetadataDate="{dated}"><dc:title><rdf:Alt><rdf:li xml:lang="x-default">{title}</rdf:li></rdf:Alt></dc:title>
    <dc:creator><rdf:Seq><rdf:li>Ada Brook</rdf:li><rdf:li>Kis Pál</rdf:li></rdf:Seq></dc:creator>{rest}</rdf:Description></rdf:RDF></x:xmpmeta>""".encode()


@pytest.mark.parametrize("packed", [False, True])
def test_information_dictionary(packed):
    info = b"<< /Title (A \\(quiet\\) r\\351gi\\) river) /Author (Ada Brook & Kis P\\341l) /Subject <FEFF0053006F> /Keywords (sea, river; sea) /ModDate (D:20200102030405+01'00') >>"
    got = parsers.PARSERS["pdf"](document(info.replace(b"\\) river", b" river"), packed=packed))
    assert got["title"] == "A (quiet) régi river" and got["authors"] == ["Ada Brook", "Kis Pál"]
    assert got["description"] == "So" and got["subjects"] == ["sea", "river"]


def test_the_newer_source_wins_and_the_other_fills():
    old = b"<< /Title (From Info) /Subject (about) /ModDate (D:20190101000000Z) >>"
    new = b"<< /Title (From Info) /Author () /ModDate (D:20210101000000Z) >>"
    assert pdf.parse_pdf(document(old, packet()))["title"] == "From XMP"
    assert pdf.parse_pdf(document(old, packet()))["description"] == "about"
    got = pdf.parse_pdf(document(new, packet()))
    assert got["title"] == "From Info" and got["authors"] == ["Ada Brook", "Kis Pál"]
    assert pdf.parse_pdf(document(old, b"<x:xmpmeta broken </x:xmpmeta>"))["title"] == "From Info"
    numbers = pdf.parse_pdf(document(b"<< /Subject (doi 10.1234/ab.c.) >>", packet(rest="<dc:identifier>ISBN 978-963-07-1234-6</dc:identifier>")))["identifiers"]
    assert [(n["scheme"], n["value"]) for n in numbers] == [("ISBN", "9789630712346"), ("DOI", "10.1234/ab.c")]


@pytest.mark.parametrize(
    "raw,text",
    [(b"\xfe\xff\x00J\x00e", "Je"), (b"\xff\xfeJ\x00e\x00", "Je"), (b"\x00J\x00e\x00n", "Jen"), (b"J\x00e\x00n\x00", "Jen"), ("é".encode(), "é"), (b"r\xe9gi", "régi"), (b"a\x00\x01b\xff\xfe", ""), (b"\xef\xbb\xbfok", "ok")],
)
def test_text_strings(raw, text):
    assert pdf.decode_text(raw) == text


def test_escapes_that_tools_leave():
    assert pdf.escaped_text(r"\376\377\000J\000e\000n") == "Jen" and pdf.escaped_text(r"r\351gi") == "régi"
    assert pdf.escaped_text(r"C:\books\new") == r"C:\books\new"


def test_errors():
    for data in (b"hello", b"%PDF-1.4 trailer << /Encrypt 5 0 R /Info 7 0 R >>"):
        with pytest.raises(ValueError):
            pdf.parse_pdf(data)
    assert pdf.parse_pdf(b"%PDF-1.4 nothing")["title"] == ""


def test_fb2():
    got = parsers.parse_fb2(
        """<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><genre>prose</genre><author><first-name>Ada</first-name><last-name>Brook</last-name></author>
        <book-title>A river</book-title><annotation><p>On  water.</p></annotation><date value="1999-02-03">1999</date><lang>en</lang></title-info>
        <publish-info><publisher>Pier</publisher><isbn>963-07-1234-6</isbn></publish-info></description><body><section><p>One <b>two</b></p><p>three</p></section></body></FictionBook>""".encode()
    )
    assert (got["title"], got["authors"], got["publisher"], got["publication_date"], got["text"]) == ("A river", ["Ada Brook"], "Pier", "1999-02-03", "One two\nthree")
    assert got["identifiers"][0]["value"] == "963-07-1234-6" and got["languages"] == ["en"] and got["subjects"] == ["prose"]
