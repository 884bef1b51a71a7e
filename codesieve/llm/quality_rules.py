"""Quality rules: base rules and gradient-boosted trees over document statistics.

The trees are grown in numpy on a bounded sample of labelled documents, with monotonic constraints (more repetition, more
symbols or more repeated lines never raise a score), and flattened into node arrays, so that a batch of documents is
scored by a few array look-ups per level.

Defined cases: null text is empty; an empty text has zero counts and fails the base rules; repeated rows are judged each;
a null id is passed on; no labels, or labels of one kind only, leave the base rules alone to decide; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm import labels as labelled
from codesieve.llm.base import WordHash, by_batch, in_arrow, run_hashes, slices, texts

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, RUN = 50, 50, 3
TREES, DEPTH, RATE, BINS, LEAST_ROWS, CUT = 40, 3, 0.2, 32, 20, 0.5
#: Statistic and direction: -1, the score may only fall as it grows; 0, free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_char": -1, "repeat_share": -1, "dup_line_share": -1, "distinct_share": 0,
    "upper_share": 0, "mark_share": 0, "digit_share": 0, "words_per_line": 0, "longest_word": 0,
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_UPPER, _DIGITS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?.,;:"


def counts(text: bytes, known: WordHash) -> tuple[list[int], list[float]]:
    """The five base counts and the features of one text."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeated = distinct = 0
    if n:
        h = known.of(words)
        distinct = len(np.unique(h))
        if n > RUN:
            _, where, often = np.unique(run_hashes(h, RUN), return_inverse=True, return_counts=True)
            twice = often[where] > 1
            covered = np.zeros(n, bool)
            for j in range(RUN):
                covered[j:n - RUN + 1 + j] |= twice
            repeated = int(covered.sum())
    share = lambda x, of: x / of if of else 0.0
    dropped = lambda some: len(joined) - len(joined.translate(None, some))
    features = [
        np.log1p(n), share(chars, n), share(symbols, chars), share(repeated, n), share(dup_lines, len(lines)), share(distinct, n),
        share(dropped(_UPPER), chars), share(dropped(_MARKS), chars), share(dropped(_DIGITS), chars), share(n, len(lines)), float(max(map(len, words), default=0)),
    ]
    return [n, chars, symbols, dup_lines, repeated], features


class Trees:
    """Boosted trees as node arrays; a leaf is its own child, so every row takes DEPTH steps."""

    def __init__(self, base: float = 0.0):
        self.base = base
        self.feature, self.cut, self.left, self.right, self.value, self.roots = [], [], [], [], [], []

    def node(self, feature=0, cut=np.inf, value=0.0) -> int:
        at = len(self.feature)
        for column, x in ((self.feature, feature), (self.cut, cut), (self.left, at), (self.right, at), (self.value, value)):
            column.append(x)
        return at

    def freeze(self) -> Trees:
        self.feature, self.left, self.right = (np.array(x, np.int64) for x in (self.feature, self.left, self.right))
        self.cut, self.value, self.roots = np.array(self.cut, float), np.array(self.value, float), np.array(self.roots, np.int64)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good document, for rows of features."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[at].sum(1), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int]) -> Trees:
    """Grow the trees on histograms of quantile bins, with second-order leaf values."""
    good = y.mean()
    trees = Trees(float(np.log(good / (1 - good))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    score = np.full(len(x), trees.base)

    def leaf(g, h, low, high):
        return float(np.clip(-g / (h + 1.0), low, high))

    def grow(rows, depth, low, high):
        g, h = grad[rows], hess[rows]
        at = trees.node(value=RATE * leaf(g.sum(), h.sum(), low, high))
        best = (1e-6, None)
        if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = bins[rows, f]
                gs, hs, ns = (np.bincount(b, w, len(e) + 1).cumsum()[:-1] for w in (g, h, np.ones(len(b))))
                gain = gs ** 2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = -1
                if directions[f]:
                    rise = -(g.sum() - gs) / (h.sum() - hs + 1) + gs / (hs + 1)
                    gain[rise * directions[f] < 0] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1]:
            f, k = best[1]
            goes = bins[rows, f] <= k
            a, b = (leaf(g[m].sum(), h[m].sum(), low, high) for m in (goes, ~goes))
            middle = (a + b) / 2
            bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[directions[f]]
            trees.feature[at], trees.cut[at] = f, edges[f][k]
            trees.left[at] = grow(rows[goes], depth + 1, *bounds[0])
            trees.right[at] = grow(rows[~goes], depth + 1, *bounds[1])
        else:
            score[rows] += trees.value[at]
        return at

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        trees.roots.append(grow(np.arange(len(x)), 0, -4.0, 4.0))
    return trees.freeze()


_SAMPLE = pa.schema([("label", pa.int32()), ("features", pa.list_(pa.float64()))])


def train(docs: DataFrame, labels: DataFrame, size: int = labelled.SAMPLE) -> Trees | None:
    """Trees from at most `size` labelled documents that are not held out; None without two kinds of labels."""
    def features(batch):
        known = WordHash()
        return {"label": batch.column("label").to_pylist(), "features": [counts(t, known)[1] for t in texts(batch)]}

    rows = in_arrow(labelled.sample(docs, labels, size), by_batch(features, _SAMPLE), "label int, features array<double>").collect()
    y = np.array([r.label for r in rows], float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.array([r.features for r in rows])
    order = np.lexsort(x.T)
    return fit(x[order], y[order], list(FEATURES.values()))


_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])
JUDGED = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"


def verdicts(column: list[bytes], trees: Trees | None) -> dict:
    """Counts and verdicts of texts."""
    known = WordHash()
    found = [counts(t, known) for t in column]
    base = np.array([c for c, _ in found], np.int64).reshape(len(found), 5)
    failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
    score = trees.score(np.array([f for _, f in found])) if trees and found else np.ones(len(found))
    return {**{c: base[:, i] for i, c in enumerate(COUNTS)}, "base_failed": failed, "score": score, "kept": ~failed & (score >= CUT)}


def judge(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Counts, base verdict, score and verdict of each document."""
    return in_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"),
        by_batch(lambda b: {"doc_id": b.column("doc_id"), **verdicts(texts(b), trees)}, _OUT), JUDGED)


def keep(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The documents that pass, with all their columns.

    Whole rows go through the task's Python and come back, a few MB at a time: beside a function of the text alone, Spark
    would hold the other columns of all rows under way in its heap.
    """
    plain = dict(docs.dtypes)["text"] == "string"
    judged = "text" if plain else "_judged"

    def passing(batches):
        for part in (part for batch in batches for part in slices(batch, judged)):
            kept = part.filter(pa.array(verdicts(texts(part, judged), trees)["kept"], pa.bool_()))
            yield kept if plain else kept.drop_columns([judged])

    return in_arrow(docs if plain else docs.withColumn(judged, F.col("text").cast("string")), passing, docs.schema)
