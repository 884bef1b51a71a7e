"""What the similarity join writes down: index entries, and pairs of its first meeting."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from codesieve.llm import jaccard


@pytest.fixture
def made(monkeypatch):
    """Row counts of the join's steps in Python, by their columns."""
    counts, real = {}, jaccard.in_arrow

    def counted(df, f, schema):
        out = real(df, f, schema)
        if schema in ("a long, b long", "k long, c long, n long"):
            counts.setdefault(schema, []).append(out.count())
        return out
    monkeypatch.setattr(jaccard, "in_arrow", counted)
    return counts


def test_first_meeting_is_in_proportion_to_a_group(spark, made, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    for n in (160, 640):
        rows = [(i, " ".join(f"n{i}" if j == i % 80 else f"b{j}" for j in range(80))) for i in range(n)]
        assert {r.component_id for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
    for entries, pairs in zip(made["k long, c long, n long"], made["a long, b long"][::2], strict=True):
        assert 0 < pairs <= entries


def test_a_shared_passage_makes_no_entries_beside_a_documents_own(spark, made, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, passage + " " + " ".join(f"w{i}_{j}" for j in range(103))) for i in range(60)]
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 120 for r in got)
    assert made["k long, c long, n long"] == [60 * (jaccard.spare(120, 85) + 1)]


def test_similar_sets_share_an_entry_whichever_tokens_are_frequent():
    rng = np.random.default_rng(7)
    kinds = set()
    for percent, common, how in itertools.product((60, 80, 85, 95), [*range(1, 30), 75, 140], range(12)):
        other = common * (100 - percent) // percent
        all_tokens = np.sort(rng.choice(10_000, common + other, replace=False)).astype(np.uint64)
        if how % 3 == 0:
            all_tokens = np.roll(all_tokens, -other)
        elif how % 3 == 1:
            rng.shuffle(all_tokens)
        cut = common + int(rng.integers(0, other + 1))
        often = all_tokens[rng.random(len(all_tokens)) < rng.random()] if how % 2 else all_tokens[:common][:int(rng.integers(0, common + 1))]
        keys = []
        for own in (all_tokens[:cut], np.concatenate([all_tokens[:common], all_tokens[cut:]])):
            tokens = np.sort(own)[:jaccard.stored(len(own), percent)]
            keys.append(jaccard.entry_keys(tokens, np.isin(tokens, often), len(own), percent))
            kinds.add(len(keys[-1]) == jaccard.spare(len(own), percent) + 1)
        assert np.intersect1d(*keys).size, (percent, common, how)
    assert kinds == {True, False}


def test_entries_are_counted_across_batches():
    ks = [1, 2, 2, 3, 3, 3, 3, 3, 4, 5, 5, 7]
    rows = [(k, i, 10 + i) for i, k in enumerate(ks)]
    for size in (1, 2, 3, 5, 12):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i:i + size])], ["k", "c", "n"]) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in jaccard._shared(iter(batches)) for r in b.to_pylist()]
        assert got == [(*r, ks.count(r[0])) for r in rows if ks.count(r[0]) > 1]
    assert list(jaccard._shared(iter([]))) == []
