"""Vector bin packing of token pieces into training sequences.

Whole documents and rests of documents are items with a vector (tokens, segments, loss-bearing tokens). A sequence takes,
again and again, the item that fits and whose vector has the largest dot product with what is still free, each dimension
as a share of its limit. If none fits whole, the item with the largest product is cut to what is free. What remains at a
task's end, or where the segments run out, leaves as sequences whose lengths are powers of two, which need no padding.
A piece's first token has nothing before it in its segment to be predicted from, so a piece of n tokens bears loss on n - 1.

Documents are tokenised where they are read and packed in the same task: no shuffle, and a pool of at most `POOL` items is
all that is held. Task numbers and the order of rows come from the scan, so a repeated task gives the same pieces.

With a training order, documents are range-sorted by it first, and sequence ids follow it: the pool is a window of WINDOW
tokens in that order, emptied before the next begins. Only its last, unfilled sequence goes on, as the start of the next
window's; full parts of long texts wait in the window like the rest. Sequences of a window are numbered by the mean place
of their tokens.

Defined cases: null text is empty, and an empty text is its end id alone; repeated rows are packed each; a null id is
passed on; no rows give no pieces; other columns are not looked at.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.base import in_arrow

#: Bytes that an encoder remembers.
MEMORY = 128 << 20
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS, END_ID, POOL = 4096, 256, 4095, 2, 2048
#: Tokens that share one stretch of the training order.
WINDOW = 32 * MAX_TOKENS
_ROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _byte_letters() -> dict[int, str]:
    """The usual stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Stretches(dict):
    """Ids of stretches of text without white space, remembered up to a number of bytes.

    When half of it is full, what was not asked for since the last time goes. Runs of letters, digits or signs within a
    stretch are stretches themselves.
    """

    #: Stretches that need no normalisation but lower case: ASCII without quote and angle bracket, and precomposed Latin-1 letters.
    EASY = re.compile("[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
    RUNS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
    #: The longest stretch that is remembered.
    LONGEST = 64

    def __init__(self, tokenizer, memory: int):
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()
        self.limit, self.held, self.before = memory // 2, 0, {}

    def ids(self, part: str) -> bytes:
        if not self.EASY.fullmatch(part):
            return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        runs = self.RUNS.findall(part.lower())
        if runs != [part]:
            return b"".join(map(self.__getitem__, runs))
        shown = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part)
        if ids is None:
            ids = self.ids(part)
        if len(part) <= self.LONGEST:
            self.held += 150 + 2 * len(part) + len(ids)
            if self.held > self.limit:
                self.before, self.held = dict(self), 0
                self.clear()
            self[part] = ids
        return ids


class Encoder:
    """Ids of a text, as little-endian unsigned 32-bit integers.

    The vocabulary's tokens never reach over white space, so the ids of a text are those of its stretches in a row.
    """

    def __init__(self, path: str | None, memory: int = MEMORY):
        from tokenizers import Tokenizer
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("word_bpe_49k.json")
        self.parts = _Stretches(Tokenizer.from_file(path), memory)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@functools.lru_cache(1)
def encoder(path: str | None, memory: int = MEMORY) -> Encoder:
    """One for each Python worker, which Spark keeps between tasks; what it remembers stays below `memory` bytes."""
    return Encoder(path, memory)


class Packer:
    """Packs the items of one task; `rows` collects finished pieces. `window`: tokens of a stretch of the training order, if it has one."""

    def __init__(self, task: int, max_tokens: int, max_segments: int, max_loss: int, window: int | None = None):
        self.next, self.tokens, self.segments, self.loss, self.window = task << 32, max_tokens, max_segments, max_loss, window
        self.largest = min(max_tokens, max_loss + 1)
        self.items: list[tuple] = []  # (doc_id, start, ids, doc_tokens, place)
        self.open: list[tuple] = []  # of the window before
        self.rows: list[tuple] = []
        self.held = self.waiting = self.place = 0

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total, _ in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, ids, total, self.next, at))
            self.held += len(ids)
            at += n
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, self.largest
        for start in range(0, total, step):
            part = ids[4 * start:4 * (start + step)]
            item = (doc, start, part, total, self.place)
            if self.window:
                self.items.append(item)
                self.waiting += len(part) // 4
                if self.waiting >= self.window:
                    self.pack(0)
            elif len(part) == 4 * self.tokens:
                self.emit([item])
            else:
                self.items.append(item)
        self.place += 1
        if not self.window and len(self.items) >= POOL:
            self.pack(POOL // 2)

    def pack(self, leave: int, last: bool = False) -> None:
        """Fill sequences until at most `leave` items are in the pool."""
        items, sizes = self.items, np.array([len(x[2]) // 4 for x in self.items], np.int64)
        free = np.ones(len(items), bool)
        left = len(items)
        limit = np.array([self.tokens, self.segments, self.loss], float)
        done, chosen, self.open, self.waiting = [], self.open, [], 0
        while left > leave or chosen:
            room = limit - [sum(len(x[2]) // 4 for x in chosen), len(chosen), sum(len(x[2]) // 4 - 1 for x in chosen)]
            while left and room[0] > 0 and room[1] > 0:
                most = min(room[0], room[2] + 1)
                if most < 1:
                    break
                share = room / limit
                product = (sizes * (share[0] / limit[0] + share[2] / limit[2]) + (share[1] / limit[1] - share[2] / limit[2])) * free
                fits = product * (sizes <= most)
                best = int(fits.argmax())
                whole = free[best] and sizes[best] <= most
                if not whole:
                    best = int(product.argmax())
                doc, start, ids, total, place = items[best]
                n = int(sizes[best] if whole else most)
                chosen.append((doc, start, ids[:4 * n], total, place))
                room -= (n, 1, n - 1)
                if whole:
                    free[best], sizes[best] = False, 0
                    left -= 1
                else:
                    items[best], sizes[best] = (doc, start + n, ids[4 * n:], total, place), sizes[best] - n
            if room[0] == 0:
                done.append(chosen)
            elif self.window and not last and not left and room[1] > 0 and room[2] >= 0:
                self.open = chosen
            else:
                done += self.powers(chosen)
            chosen = []
        if self.window:
            done.sort(key=lambda pieces: sum(len(x[2]) * x[4] for x in pieces) / sum(len(x[2]) for x in pieces))
        for pieces in done:
            self.emit(pieces)
        self.items = [x for x, f in zip(items, free) if f]

    def powers(self, pieces: list[tuple]) -> list[list[tuple]]:
        """Sequences whose lengths are the binary digits of what the pieces hold together."""
        total, found = sum(len(x[2]) // 4 for x in pieces), []
        for bit in range(total.bit_length() - 1, -1, -1):
            need, out = total & (1 << bit), []
            while need:
                doc, start, ids, whole, place = pieces[0]
                n = min(need, len(ids) // 4)
                out.append((doc, start, ids[:4 * n], whole, place))
                need -= n
                if 4 * n == len(ids):
                    pieces = pieces[1:]
                else:
                    pieces = [(doc, start + n, ids[4 * n:], whole, place), *pieces[1:]]
            if out:
                found.append(out)
        return found

    def take(self, all_of_them: bool = False):
        if self.rows and (all_of_them or self.held >= 8 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), _ROW)], schema=_ROW)
            self.rows, self.held = [], 0


def stored_order() -> list[Column]:
    """The order in which a table's rows were written: number of the part file, its name, row in it.

    Spark names the files of a range-sorted table by the number of their range, but reads them in another order.
    """
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]


def pack(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, end_id: int = END_ID,
         order: Sequence[Column] = (), window: int = WINDOW) -> DataFrame:
    """Pieces of (doc_id, text) rows with their place in sequences; `ids` holds little-endian unsigned 32-bit integers.

    `tokenizer`: path of a tokenizer file each executor has; None: the public word vocabulary. `order`: the training order
    that sequence ids are to follow, see `stored_order`; `window`: tokens of it that are packed together.
    """
    keys = {f"_order{i}": c for i, c in enumerate(order)}
    stretch = window if keys else None

    def run(batches):
        packer, encode, end = None, None, np.array([end_id], "<u4").tobytes()
        for b in batches:
            if packer is None:
                packer, encode = Packer(TaskContext.get().partitionId(), max_tokens, max_segments, max_loss, stretch), encoder(tokenizer, MEMORY // 2 if stretch else MEMORY)
            column = b.column("text")
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                packer.add(doc, encode(column[i].as_py() or "") + end)
                yield from packer.take()
        if packer is not None:
            packer.pack(0, last=True)
            yield from packer.take(True)

    df = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(c.alias(k) for k, c in keys.items()))
    if keys:
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return in_arrow(df.select("doc_id", "text"), run, PIECES)
