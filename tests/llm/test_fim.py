"""Fill-in-the-middle: brute force over all texts, and the cases its docstring defines."""

import hashlib

import pytest
from pyspark.sql import functions as F

from codesieve.llm import base, fim

SMALL = "/root/testdata/sf0.001"


def plain(doc, text):
    """n, form, prefix and middle length, output by slices of the text."""
    s = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(s[8 * i:8 * i + 8], 16) for i in range(4)]
    text = text or ""
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def check(df):
    rows = fim.restored(fim.transform(df)).collect()
    got = sorted(((r.doc_id, r.restored, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=repr)
    want = sorted(((r.doc_id, r.text or "", *plain(r.doc_id, r.text)) for r in df.select("doc_id", "text").collect()), key=repr)
    assert got == want
    return rows


def test_all_texts(spark):
    rows = check(base.table(spark, SMALL, "documents"))
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_odd_texts(spark):
    long_text = "".join(chr(0x61 + i % 26) + ("é" if i % 3 else "日😀") for i in range(90_000))
    texts = [None, "", "a", "é", "😀", "<P", "a<P>b", "<S>", "x<M>", "<<P<S", "\0\n", "P><M", long_text, "same", "same"]
    rows = [(i, t) for t in texts for i in (0, 1, 2, 3, 4, 17, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"form": F.lit("clash"), "output": F.lit(1), "n": F.lit("x"), "mark": F.lit(2)})
    check(df)
    assert fim.transform(df.where("false")).count() == 0 and fim.restored(fim.transform(df.where("false"))).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks(monkeypatch, block):
    """Reversals and scans do not depend on the size of their blocks."""
    monkeypatch.setattr(fim, "BLOCK", block)
    text = "aé日😀b" * 5
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            for form, want in (("psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"), ("spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")):
                out = bytes(fim.rotate(text.encode(), a, b, form))
                assert out.decode() == want and bytes(fim.unrotate(out, form)).decode() == text
