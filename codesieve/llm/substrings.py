"""Removal of repeated passages through a compacted De Bruijn graph of word runs.

The edges of the graph are windows of WINDOW words. Writing each edge of a corpus down would move many times its size, so
the graph is built on anchors: of the ANCHOR-word k-mers in a window, the one with the lowest hash, the first of equals.
Equal windows have equal anchors at equal places. Neighbouring windows with the same anchor occurrence are a path:

* an anchor that occurs once in the corpus has no repeated window, and its path is dropped;
* paths that agree in their anchor and in all their words are one compacted edge. All but the first occurrence (by
  document, then place) are repeats from end to end, whatever else the graph holds;
* an anchor with two or more different paths branches. Only there the single windows of each path's first occurrence are
  compared, again by joins.

Source coordinates (document, place) travel with each path; the final pass marks the words they cover in the text itself,
all at once, so windows are judged on the input. Keys are pairs of independent 64-bit hashes.

Repeats inside a batch of rows are found before anything is shuffled, so a passage in every document costs a row per batch.

Defined cases: null text has no words; a text of fewer than WINDOW words loses nothing; null ids come first, as one id;
rows that share an id are taken in the order of a hash of their text, and rows equal in both are ties, of which neither
repeats the other; no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.base import WordHash, forget, in_arrow, mixed, run_hashes, texts, written
from codesieve.llm.order import by_key

WINDOW, ANCHOR = 20, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Powers:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


def paths(w: np.ndarray, window: int, anchor: int, powers: _Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash, hash of all words) of each path of a text given as word hashes."""
    n = len(w) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = run_hashes(w, anchor)
    wide = window - anchor + 1
    at = np.lib.stride_tricks.sliding_window_view(h, wide).argmin(1) + np.arange(n)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(start, n))
    up, down = powers.upto(len(w) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[:-1])])
    whole = (sums[start + count + window - 1] - sums[start]) * down[start]
    place = (at[start] - start).astype(np.uint64) * np.uint64(1 << 32) + count.astype(np.uint64)
    return start, count, h[at[start]], mixed(whole + mixed(place + np.uint64(1)))


def _repeats(a: np.ndarray, b: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows have an earlier row, by (key, start), with the same hashes in this batch."""
    order = np.lexsort((start, key, b, a))
    a, b, key, start = a[order], b[order], key[order], start[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    out = np.zeros(len(a), bool)
    out[order] = (key != key[first]) | (start != start[first])
    return out


_PATHS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("again", pa.bool_())])
_PATH_COLUMNS = "a long, b long, key long, start int, count int, again boolean"


def _rows(lots: list[tuple]) -> pa.RecordBatch | None:
    """A batch of (a, b, key, start, count) arrays, with its own repeats marked."""
    a, b, key, start, count = (np.concatenate(x) for x in zip(*lots))
    if not len(a):
        return None
    again = _repeats(a, b, key, start)
    return pa.RecordBatch.from_arrays([
        pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(key), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(again)], schema=_PATHS)


def _scan(window: int, anchor: int):
    def run(batches):
        known, powers = WordHash(), _Powers()
        for batch in batches:
            lots = []
            for key, text in zip(batch.column("key").to_pylist(), texts(batch)):
                start, count, a, b = paths(known.of(text.split()), window, anchor, powers)
                lots.append((a, b, np.full(len(a), key, np.int64), start, count))
            if lots and (rows := _rows(lots)):
                yield rows
    return run


def _windows(window: int):
    """Single windows of the listed paths."""
    def run(batches):
        known = WordHash()
        for batch in batches:
            lots = []
            for key, text, listed in zip(batch.column("key").to_pylist(), texts(batch), batch.column("listed").to_pylist()):
                h = run_hashes(known.of(text.split()), window)
                start = np.array([x["start"] for x in listed], np.int64)
                count = np.array([x["count"] for x in listed], np.int64)
                a = np.repeat(np.array([x["a"] for x in listed], np.int64).view(np.uint64), count)
                at = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                lots.append((a, h[at], np.full(len(a), key, np.int64), at, np.ones(len(at), np.int64)))
            if lots and (rows := _rows(lots)):
                yield rows
    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def _cut(window: int):
    def run(batches):
        for batch in batches:
            ids, total, removed, kept = [], [], [], []

            def done():
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], schema=_OUT)

            size = 0
            starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
            for k, text, s, e in zip(batch.column("doc_id").to_pylist(), texts(batch), starts, ends):
                words = text.split()
                if s:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, np.array(s), 1)
                    np.add.at(edge, np.array(e), -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    left = [w for w, k2 in zip(words, stay.tolist()) if k2]
                else:
                    left = words
                ids.append(k)
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
                size += len(kept[-1])
                if size > 16 << 20:
                    yield done()
                    ids, total, removed, kept, size = [], [], [], [], 0
            yield done()
    return run


def removed_spans(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(key, start, end) in words: stretches of repeated windows that have an earlier source."""
    found = written(in_arrow(keyed.select("key", "text"), _scan(window, anchor), _PATH_COLUMNS))
    single = found.where("not again")
    twice = found.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    live = written(single.join(twice, "a", "left_semi").drop("again"))
    local = written(found.where("again").select("key", "start", (F.col("start") + F.col("count") + (window - 1)).alias("end")))
    forget(found)
    first = written(live.groupBy("a", "b").agg(F.min(F.struct("key", "start", "count")).alias("first"), F.count("*").alias("n")).select("a", "b", "n", "first.*"))
    several = first.where("n > 1").select("a", "b", F.col("key").alias("key0"), F.col("start").alias("start0"))
    whole = live.join(several, ["a", "b"]).where("key != key0 or start != start0").select("key", "start", (F.col("start") + F.col("count") + (window - 1)).alias("end"))
    branching = first.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    listed = first.join(branching, "a", "left_semi").groupBy("key").agg(F.collect_list(F.struct("a", "start", "count")).alias("listed"))
    single = written(in_arrow(keyed.select("key", "text").join(listed, "key"), _windows(window), _PATH_COLUMNS))
    source = single.where("not again").groupBy("a", "b").agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", F.col("first.key").alias("key0"), F.col("first.start").alias("start0"))
    later = single.where("not again").join(source, ["a", "b"]).where("key != key0 or start != start0")
    apart = later.select("key", "start", (F.col("start") + window).alias("end")).unionByName(single.where("again").select("key", "start", (F.col("start") + window).alias("end")))
    return written(local.unionByName(whole).unionByName(apart))


def deduplicate(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts_too: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each document, and `kept` itself if wanted."""
    keyed, _ = by_key(docs)
    spans = removed_spans(keyed, window, anchor).groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    cut = in_arrow(keyed.select("key", "doc_id", "text").join(spans, "key", "left"), _cut(window), "doc_id long, n_words long, n_removed long, kept binary")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), *([F.col("kept").cast("string").alias("kept")] if texts_too else []))
