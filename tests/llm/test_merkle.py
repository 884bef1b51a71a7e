"""Merkle manifest: a plain recursive version, all sizes of small trees, and the cases its docstring defines."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from codesieve.llm import base, merkle, queries

SMALL = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(row, more=0):
    shown = [row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + more, row.text]
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in shown))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, at):
    """(sibling or None, whether it is on the left) by level."""
    out = []
    for level in tree[:-1]:
        out.append((level[at ^ 1] if at ^ 1 < len(level) else None, at & 1))
        at //= 2
    return out


def plain(rows):
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r.lang == g), key=lambda r: (r.doc_id is not None, r.doc_id or 0, digest(r))) for g in langs}
    trees = {g: levels([digest(r) for r in groups[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for i, g in enumerate(langs):
        for at, r in enumerate(groups[g]):
            proof = path(trees[g], at) + path(top, i)
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            h = digest(r, 1 if tampered else 0)
            for sibling, left in proof:
                h = H(h) if sibling is None else H(sibling, h) if left else H(h, sibling)
            out.append((r.doc_id, digest(r), trees[g][-1][0], top[-1][0], H(*(s for s, _ in proof if s)), h, h == top[-1][0]))
    return sorted(out, key=repr)


def check(spark, df, tmp_path):
    df.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_merkle_manifest(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(df.collect())
    return got


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, `group` string, hash string, tree int"


def rows(n, lang, start=0):
    return [(start + i, f"text {i} é", lang, f"s{i % 3}", i, 1, "g", "h", 2) for i in range(n)]


def test_all_rows(spark, tmp_path):
    got = check(spark, base.table(spark, SMALL, "documents"), tmp_path)
    assert {r.verified for r in got.collect()} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [3, 1], [300, 7, 1, 64, 2]])
def test_sizes(spark, tmp_path, sizes):
    check(spark, spark.createDataFrame([r for i, n in enumerate(sizes) for r in rows(n, f"l{i}", 1000 * i)], SCHEMA), tmp_path)


def test_far_levels_and_slices(spark, tmp_path, monkeypatch):
    """Many small shuffled steps: subtrees of two levels, nothing broadcast."""
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a: whole(*a, levels=2, most=0))
    check(spark, spark.createDataFrame(rows(150, "a") + rows(33, None, 500) + rows(1, "", 900) + rows(6, "é", 2000) + rows(4, "z", 3000), SCHEMA), tmp_path)


def test_odd_rows(spark, tmp_path):
    odd = [(None, None, None, None, None), (None, "", None, "", 0), (None, "", None, "", 0), (5, "x" * 300_000, "en", "s", 7), (5, "y", "en", "s", 7), (5, "y", "en", "s", 7), (6, None, "EN", None, None), (-3, "1:a", "en", "-", 1)]
    check(spark, spark.createDataFrame([(*r, 1, "g", "h", 2) for r in odd], "doc_id long, text string, lang string, source string, n_chars long, place long, `group` string, hash string, tree int"), tmp_path)


def test_no_rows(spark, tmp_path):
    check(spark, spark.createDataFrame([], SCHEMA), tmp_path)


def test_own_digest_always_verifies(spark):
    got = merkle.manifest(base.table(spark, SMALL, "documents"), ["doc_id", "text"], "source")
    assert got.where(F.col("folded_root") != F.col("root")).count() == 0 and got.select("root").distinct().count() == 1
