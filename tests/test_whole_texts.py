"""Queries over whole texts, long ones and those of other scripts too, against brute force."""

import unicodedata

import pytest

from spindrift.functions import text as X
from spindrift.plans import catalog
from spindrift.plans import fixtures as fx

TEXTS = {
    1: "plain line\n\n" + "a line that is longer than two hundred characters, " * 12,
    2: "é à ï only other letters aei\n\U0001f600 aei \U0001f600",
    3: "தமிழ் aei மொழி\n   \nxyz aei zyx\na",
    4: "no change whatsoever".translate(str.maketrans("aei", "xyz")),
    5: "the quick brown fox\tjumps. " * 150 + "\nக்ாகௌ ா",
    6: " \n",
}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def romanized(t):
    t = " ".join("".join(c for c in unicodedata.normalize("NFC", t) if c not in X.JOINERS).split())
    out = ""
    for i, c in enumerate(t):
        if c in X.VOWEL_SIGNS and i and t[i - 1] in X.CONSONANTS:
            out += X.VOWEL_SIGNS[c]
        elif c in X.CONSONANTS:
            out += X.CONSONANTS[c] + ("" if i + 1 < len(t) and (t[i + 1] == X.PULLI or t[i + 1] in X.VOWEL_SIGNS) else "a")
        elif c != X.PULLI:
            out += X.VOWELS.get(c, c)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{to}/documents.parquet")
    return to


def test_ocr_eval(spark, folder):
    want = {}
    for d, text in TEXTS.items():
        lines = [t for t in text.split("\n") if t.strip(" ")]
        pairs = [(t, t.translate(str.maketrans("aei", "xyz"))) for t in lines]
        if pairs:
            edits, size, exact = sum(distance(*p) for p in pairs), sum(map(len, lines)), sum(a == b for a, b in pairs)
            want[d] = (len(pairs), edits, size, exact, pytest.approx(edits * 100 / size), pytest.approx(exact * 100 / len(pairs)))
    assert {r.doc_id: tuple(r)[1:] for r in catalog.ocr_eval(spark, folder).collect()} == want
    assert max(len(t) for text in TEXTS.values() for t in text.split("\n")) > 4000


def test_transliterate(spark, folder):
    want = {d: romanized(t.lower().translate(str.maketrans(fx.LATIN, fx.SCRIPT))) for d, t in TEXTS.items()}
    assert {r.doc_id: r.romanized for r in catalog.transliterate(spark, folder).collect()} == want
    assert max(map(len, TEXTS.values())) > 4000


def test_every_document_has_its_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert catalog.transliterate(spark, sf).count() == docs.count()
    assert catalog.ocr_eval(spark, sf).groupBy().sum("samples").first()[0] == fx.lines(spark, sf).count()
