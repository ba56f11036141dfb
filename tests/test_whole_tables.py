import hashlib
import re
import unicodedata

import pytest

from lexmill import catalog

TEXTS = [None, "", "Straße und „Größe“ – 5 €", "SMØRREBRØD Łódź œuvre æ 😀", "Cafe\u0301 Ünder Ǆ İ", "one two\nthree", "first part\n\nsecond part\n \t\n\nthird", "\n\n", " a \n\n\n b\nc "]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, "de", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def folded(text):
    out = ""
    for c in unicodedata.normalize("NFC", text):
        parts = unicodedata.normalize("NFD", c)
        base = [p for p in parts if not unicodedata.combining(p)]
        to = base[0] if len(parts) > 1 and len(base) == 1 else c
        out += to.lower() if len(to.lower()) == 1 else to
    return out


def test_keyword_fold_whole(spark, whole):
    got = {r["id"]: r["folded_md5"] for r in catalog.queries()["keyword_fold_whole"](spark, whole).collect()}
    assert got == {i: hashlib.md5(folded(t or "").encode()).hexdigest() for i, t in enumerate(TEXTS)}


def test_word_counts_whole(spark, whole):
    expected = {}
    for i, t in enumerate(TEXTS):
        t = t or ""
        parts = re.split(r"\n[ \t]*\n\s*", t) if re.search(r"\n[ \t]*\n", t) else t.split("\n")
        expected[i] = (len(t.split()), sum(p.strip(" ") != "" for p in parts))
    got = {r["id"]: (r["words"], r["paragraphs"]) for r in catalog.queries()["word_counts_whole"](spark, whole).collect()}
    assert got == expected and got[6][1] == 3
