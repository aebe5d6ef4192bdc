"""Titles and authors from the heads of texts: labels, front matter, start markers and title pages."""

import pytest

from inkloom.operators import headers
from inkloom.session import Scratch

CASES = [
    ("labels", "Title: A Quiet River\nAuthors: Ada Brook and Carl Stone\n\nIt began.", "A Quiet River", ["Ada Brook", "Carl Stone"]),
    ("other keys", "Szerző: Kis Pál\nCím: \"A folyó\"\n\nText", "A folyó", ["Kis Pál"]),
    ("placeholder label", "Title: Unknown\nTitle: Second Try\n\nText", "Second Try", []),
    ("labels in prose don't count", "It was late and nobody came to the door of the house that stood by the river.\nTitle: no", "", []),
    ("front matter", "---\ntitle: From Matter\nauthor: Ada Brook\n---\nTitle Page\nCarl Stone\n", "From Matter", ["Ada Brook"]),
    ("front matter without end", "---\nThe Quiet River\nAda Brook\n", "The Quiet River", ["Ada Brook"]),
    ("marker", "*** START OF THE PROJECT GUTENBERG EBOOK THE QUIET RIVER ***\nBody", "THE QUIET RIVER", []),
    ("before the marker", "Some words\nAuthor: Ada Brook\n*** START OF THIS PROJECT GUTENBERG EBOOK, A River ***", "A River", ["Ada Brook"]),
    ("title and author", "The Quiet River\nAda Brook\n\nIt began at night, when everybody slept and no one could hear the sea.", "The Quiet River", ["Ada Brook"]),
    ("author and title", "Ada Brook\nThe Quiet River\n", "The Quiet River", ["Ada Brook"]),
    ("one line", "Ada Brook: The Quiet River\n", "The Quiet River", ["Ada Brook"]),
    ("one line, dash", "The Quiet River – Ada Brook\n", "The Quiet River", ["Ada Brook"]),
    ("both ways", "Quiet River\nAda Brook\n", "", []),
    ("noise first", "NNCL5432-123.4\nCopyright 2001\n\nThe Quiet River\nAda Brook\nChapter 1\nThe Other\n", "The Quiet River", ["Ada Brook"]),
    ("subtitle and names", "Better Sails\nThe complete guide to rope\nAda Brook\nCarl Stone\nby Ian Reed\n© 2007 X\n", "Better Sails: The complete guide to rope", ["Ada Brook", "Carl Stone", "Ian Reed"]),
    ("edition and name", "The Great Novel\nSecond Edition\nJane Doe\n\n", "The Great Novel", ["Jane Doe"]),
    ("two names", "The Great Novel\nJane Doe\nJohn Smith\n", "The Great Novel", ["Jane Doe", "John Smith"]),
    ("one line alone", "The Great Novel\n", "", []),
    ("body text", "He said that it would rain the whole day, and it did, until they left the house.\nAda Brook\n", "", []),
    ("upper labels", "TI: The Quiet River\nAU: Ada Brook\n", "The Quiet River", ["Ada Brook"]),
    ("empty", "", "", []),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)] + [(999, None)], "doc_id long, text string")
    claims = Scratch(spark, "claims").save(headers.header_claims(docs), "claims")
    return {r["file_id"]: (r["title"], r["authors"]) for r in headers.header_metadata(claims).collect()}, claims.collect()


@pytest.mark.parametrize("n", range(len(CASES)), ids=[c[0] for c in CASES])
def test_header_metadata(found, n):
    assert found[0].get(n, ("", [])) == (CASES[n][2], CASES[n][3])


def test_claims_have_their_sets(found):
    rows = {(r["set"], r["source"]) for r in found[1]}
    assert {("labels:2", "header"), ("labels:0", "header"), ("labels:1", "header"), ("marker", "header"), ("title_page", "title_page")} <= rows
    assert not [r for r in found[1] if r["file_id"] == 999]
