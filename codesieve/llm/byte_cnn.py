"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes slide over the whole text. Their rectified answers are max-pooled in blocks of HALF bytes;
two neighbouring blocks make a chunk, so chunks overlap by half and cover every byte. A document is described by the mean
and the largest answer of each filter over its chunks, and a logistic layer makes one probability of these. As bytes are
one of 256 values, a filter is a table per position, and a convolution is a sum of table look-ups.

Training (Adam, only where a maximum was taken does a gradient flow) uses a bounded sample of labelled documents, long ones
too: of a text above TRAIN_BYTES it takes that many bytes, in blocks of HALF bytes spread evenly from its start to its end.
Scoring reads every byte of every text, in pieces of bounded size.

Defined cases: null text is empty; an empty text is scored as one chunk without any answer; repeated rows are scored
each; a null id is passed on; without labels of both kinds every score is the share of good labels (1 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm import labels as labelled
from codesieve.llm.base import by_batch, in_arrow, texts

WIDTH, FILTERS, HALF, PIECE = 5, 24, 256, 1 << 16
EPOCHS, BATCH, RATE, SEED, TRAIN_BYTES, CUT = 10, 64, 0.01, 7, 16_384, 0.7


class Net:
    """tables: (WIDTH, 256, FILTERS) filter weights by byte; bias of filters; weights and bias of the last layer."""

    def __init__(self, tables=None, bias=None, last=None, offset=0.0):
        self.tables, self.bias, self.last, self.offset = tables, bias, last, offset

    def answers(self, data: np.ndarray) -> np.ndarray:
        """Filter answers at each byte of data but the last WIDTH - 1."""
        n = len(data) - WIDTH + 1
        out = np.take(self.tables[0], data[:n], axis=0)
        for k in range(1, WIDTH):
            out += np.take(self.tables[k], data[k:n + k], axis=0)
        return out

    def blocks(self, text: bytes) -> np.ndarray:
        """Rectified maxima by block; a zero byte stands for what lies beyond the text's end."""
        data = np.frombuffer(text + bytes(WIDTH - 1), np.uint8)
        parts = []
        for start in range(0, len(text), PIECE):
            a = self.answers(data[start:start + PIECE + WIDTH - 1])
            whole = len(a) // HALF * HALF
            if whole:
                parts.append(a[:whole].reshape(-1, HALF, FILTERS).max(1))
            if whole < len(a):
                parts.append(a[whole:].max(0)[None])
        return np.maximum(np.concatenate(parts) + self.bias, 0) if parts else np.zeros((1, FILTERS), np.float32)

    def describe(self, text: bytes) -> np.ndarray:
        b = self.blocks(text)
        chunks = np.maximum(b[:-1], b[1:]) if len(b) > 1 else b
        return np.concatenate([chunks.mean(0), chunks.max(0)])

    def score(self, column: list[bytes]) -> np.ndarray:
        if self.tables is None:
            return np.full(len(column), self.offset)
        x = np.array([self.describe(t) for t in column]).reshape(len(column), 2 * FILTERS)
        return 1 / (1 + np.exp(-np.clip(x @ self.last + self.offset, -30, 30)))


def fit(column: list[bytes], y: np.ndarray) -> Net:
    rng = np.random.default_rng(SEED)
    net = Net(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    moments = [[np.zeros_like(p, dtype=np.float64), np.zeros_like(p, dtype=np.float64)] for p in (net.tables, net.bias, net.last, np.zeros(1))]
    step = 0
    cols = np.arange(FILTERS)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for lot in np.array_split(order, max(1, len(order) // BATCH)):
            g_tables, g_bias, g_last, g_offset = np.zeros(net.tables.shape), np.zeros(FILTERS), np.zeros(2 * FILTERS), np.zeros(1)
            for i in lot:
                data = np.frombuffer(column[i] + bytes(WIDTH - 1), np.uint8)
                n = len(column[i])
                if n:
                    a = net.answers(data)
                    pad = -n % HALF
                    padded = np.concatenate([a, np.full((pad, FILTERS), -1e9, np.float32)]).reshape(-1, HALF, FILTERS)
                    where = padded.argmax(1)
                    raw = np.take_along_axis(padded, where[:, None], 1)[:, 0] + net.bias
                    where += np.arange(len(where))[:, None] * HALF
                else:
                    raw, where = np.zeros((1, FILTERS)), None
                b = np.maximum(raw, 0)
                left = b[:-1] >= b[1:] if len(b) > 1 else np.ones_like(b, bool)
                chunks = np.where(left, b[:-1], b[1:]) if len(b) > 1 else b
                top = chunks.argmax(0)
                x = np.concatenate([chunks.mean(0), chunks[top, cols]])
                z = x @ net.last + net.offset
                d = weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i])
                g_last += d * x
                g_offset += d
                if where is not None:
                    g_chunk = np.repeat((d * net.last[:FILTERS] / len(chunks))[None], len(chunks), 0)
                    g_chunk[top, cols] += d * net.last[FILTERS:]
                    g_block = np.zeros_like(b, dtype=np.float64)
                    if len(b) > 1:
                        g_block[:-1] += np.where(left, g_chunk, 0)
                        g_block[1:] += np.where(left, 0, g_chunk)
                    else:
                        g_block += g_chunk
                    g_block *= raw > 0
                    g_bias += g_block.sum(0)
                    for k in range(WIDTH):
                        np.add.at(g_tables[k], (data[where + k], cols[None]), g_block)
            step += 1
            offset = np.array([net.offset])
            for (p, g), m in zip(((net.tables, g_tables), (net.bias, g_bias), (net.last, g_last + 1e-3 * len(lot) * net.last), (offset, g_offset)), moments):
                g = g / len(lot)
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                p -= (RATE * (1 - 0.9 * epoch / EPOCHS) * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-6)).astype(p.dtype)
            net.offset = float(offset[0])
    return net


def spread(text: Column, limit: int) -> Column:
    """The bytes of a text; of one above `limit` as many, in blocks of HALF bytes at even distances, the first and the last included."""
    data, blocks = text.cast("binary"), max(2, limit // HALF)
    step = (F.octet_length(text) - HALF) / (blocks - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.hex(F.substring(data, F.floor(i * step).cast("int") + 1, F.lit(HALF))))
    return F.when(F.octet_length(text) <= limit, data).otherwise(F.unhex(F.array_join(cut, "")))


def train(docs: DataFrame, labels: DataFrame, size: int = labelled.SAMPLE, limit: int = TRAIN_BYTES) -> Net:
    """A network from at most `size` labelled documents that are not held out, at most `limit` bytes of each."""
    rows = labelled.sample(docs, labels, size).select("doc_id", spread(F.col("text"), limit).alias("data"), "label").collect()
    rows = sorted((r.doc_id, bytes(r.data), r.label) for r in rows)
    y = np.array([label for _, _, label in rows], float)
    if not 0 < y.sum() < len(y):
        return Net(offset=float(y.mean()) if len(y) else 1.0)
    return fit([data for _, data, _ in rows], y)


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score) of every document; the text alone is looked at."""
    return in_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"),
        by_batch(lambda b: {"doc_id": b.column("doc_id"), "score": net.score(texts(b))}, _OUT), "doc_id long, score double")
