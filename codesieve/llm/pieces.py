"""SentencePiece encoding with source spans, and decoding.

A text is normalised by longest-prefix steps through the model's compiled character map; each normalised byte records the
source byte its step began at. Pieces are merged by score over the normalised text (byte-pair model), their ends are
projected through that record, so every id comes with the span of source bytes it stands for. Bytes that stand in for an
unknown character have an empty span, but the last, which has the character's. `decode` turns ids back into text.

Where no piece of the vocabulary goes on after a word's end, stretches of blanks and word are encoded one by one and
remembered up to CACHE bytes in each Python worker, which Spark keeps between tasks. Nothing is shuffled; batches are given on once they hold FLUSH bytes.

Defined cases: null text is empty; an empty text has the begin and end ids only; repeated rows are encoded each; a null id is
passed on; very long texts go through in stretches cut before a blank; no rows give no rows; other columns are not looked
at. Other than byte-pair models with bytes for unknown characters, and models with user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.base import in_arrow

SPACE = "▁"
CACHE, FLUSH, STRETCH, LONGEST = 128 << 20, 8 << 20, 1 << 20, 64
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    def number(i):
        n = shift = 0
        while True:
            n |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return n, i

    i = 0
    while i < len(data):
        tag, i = number(i)
        if tag & 7 == 0:
            value, i = number(i)
        else:
            size, i = number(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = data[i:i + size], i + size
        yield tag >> 3, value


class CharMap:
    """A compiled character map: the size of a double-array trie, its units, and replacements that end with a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.replacements = blob[4 + size:]
        self.root = self._child_base(0, self.units[0])
        plain = bytes(b for b in range(128) if self._is_plain(b))
        #: Runs of ASCII that no step changes; the last byte before another character is left to the steps.
        self.runs = re.compile(b"[" + re.escape(plain) + rb"]+(?![^\x00-\x7f])") if plain else None

    @staticmethod
    def _child_base(at: int, unit: int) -> int:
        return at ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _step(self, base: int, byte: int) -> tuple[int, int] | None:
        """The unit's value if a key ends here, else -1, and the base of its children."""
        at = base ^ byte
        if at >= len(self.units) or self.units[at] & 0x800000FF != byte:
            return None
        unit = self.units[at]
        below = self._child_base(at, unit)
        return (self.units[below] & 0x7FFFFFFF if unit & 0x100 else -1), below

    def _is_plain(self, byte: int) -> bool:
        found = self._step(self.root, byte)
        return found is None or found[0] < 0 and all(self._step(found[1], b) is None for b in range(1, 128))

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that `data` has at a place."""
        base, best = self.root, None
        for i in range(at, len(data)):
            found = self._step(base, data[i])
            if found is None:
                break
            value, base = found
            if value >= 0:
                best = value, i + 1 - at
        if best is None:
            return None
        return self.replacements[best[0]:self.replacements.index(b"\0", best[0])], best[1]

    def apply(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and the source byte at which the step of each began."""
        out, sources, at = [], [], 0
        while at < len(data):
            run = self.runs.match(data, at) if self.runs else None
            if run:
                out.append(run[0])
                sources.append(np.arange(at, run.end()))
                at = run.end()
                continue
            made = self.longest(data, at)
            if made is None:
                lead = data[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                made = data[at:at + size], size
            out.append(made[0])
            sources.append(np.full(len(made[0]), at))
            at += made[1]
        return b"".join(out), np.concatenate(sources) if sources else np.zeros(0, np.int64)


class Known(dict):
    """Ids of stretches, remembered up to a number of bytes: when half of it is full, what was not asked for again goes."""

    def __init__(self, model: Model):
        self.model, self.held, self.before = model, 0, {}

    def __missing__(self, stretch: str) -> bytes:
        if len(stretch) > LONGEST:
            return b"".join([self[p] if len(p) <= LONGEST else self.model.merge(p) for p in self.model.parted(stretch)])
        found = self.before.get(stretch)
        if found is None:
            found = self.model.merge(stretch)
        self.held += 240 + 2 * len(stretch) + len(found)
        if 2 * self.held > CACHE:
            self.before, self.held = dict(self), 0
            self.clear()
        self[stretch] = found
        return found


class Model:
    """A byte-pair model read from its file."""

    def __init__(self, data: bytes):
        pieces, trainer, norm = [], {}, {}
        for n, v in fields(data):
            if n == 1:
                f = dict(fields(v))
                pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif n in (2, 3):
                (trainer if n == 2 else norm).update(fields(v))
        kinds = np.array([k for _, _, k in pieces])
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or not trainer.get(35, 0) or np.isin(kinds, (USER, UNUSED)).any():
            raise ValueError("only byte-pair models with bytes for unknown characters, blanks before words, no user-defined or unused pieces")
        self.ids = {p: i for i, (p, _, _) in enumerate(pieces)}
        self.sizes = np.array([0 if k == BYTE else len(p.encode()) for p, _, k in pieces])
        self.leads = np.zeros(len(pieces), np.int64)
        self.scores = {p: s for p, s, k in pieces if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        for b, i in self.bytes.items():
            self.leads[i] = 1 if b < 0x80 else 0 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        self.begin, self.end = (self.ids[trainer.get(n, d).decode()] for n, d in ((46, b"<s>"), (47, b"</s>")))
        self.map = CharMap(norm[2]) if norm.get(2) else None
        self.dummy, self.squeeze, self.escape = (bool(norm.get(n, 1)) for n in (3, 4, 5))
        order = {x: i for i, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        splits = [(self.ids[a] << 32 | self.ids[b], p) for p in self.scores for i in range(1, len(p)) if (a := p[:i]) in self.scores and (b := p[i:]) in self.scores]
        #: By the ids of two neighbours: the place of their union's score among all, and its id.
        self.ranks, self.unions = {k: order[self.scores[p]] for k, p in splits}, {k: self.ids[p] for k, p in splits}
        self.pairs = {p[i:i + 2] for p in self.scores for i in range(len(p) - 1)}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.scores)
        self.stretches = re.compile("(?s:.+)" if inner or not self.escape else self._pattern())
        self.whole = inner or self.map is not None or self.squeeze or not self.escape
        surface = trainer.get(44, " ⁇ ".encode())
        self.raw = [surface if k == UNKNOWN else b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, _, k in pieces]
        self.kinds, self.opens = kinds, np.array([k == NORMAL and p.startswith(SPACE) for p, _, k in pieces])

    def _pattern(self) -> str:
        """Stretches that no piece reaches across: blanks and letters, blanks and signs, blanks, and characters that no piece joins to another."""
        joined = set("".join(self.pairs)) - {SPACE}
        letters = {c for c in joined if c.isalpha()}
        if any((a in letters) != (b in letters) for a, b in self.pairs if SPACE not in (a, b)):
            letters = joined
        kinds = [f"{SPACE}*[{re.escape(''.join(sorted(x)))}]+" for x in (letters, joined - letters) if x]
        other = "[^" + re.escape("".join(sorted(joined | {SPACE}))) + "]"
        return "|".join([*kinds, f"{SPACE}+", other])

    def parted(self, stretch: str) -> Iterator[str]:
        """A long stretch, cut between characters that no piece has side by side."""
        at = 0
        for i, pair in enumerate(map(str.__add__, stretch, stretch[1:]), 1):
            if pair not in self.pairs:
                yield stretch[at:i]
                at = i
        yield stretch[at:]

    def merge(self, stretch: str) -> bytes:
        """Ids of a normalised stretch, as little-endian unsigned 32-bit integers.

        Again and again the neighbours whose union has the highest score become one, the leftmost among equals. In a short
        stretch of known characters all ranks are looked at each time.
        """
        ids = [self.ids.get(c) for c in stretch]
        if len(ids) > LONGEST or None in ids:
            return self._long(stretch)
        get, none = self.ranks.get, len(self.kinds)
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i] = self.unions[ids[i] << 32 | ids[i + 1]]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
        return array("I", ids).tobytes()

    def _long(self, stretch: str) -> bytes:
        ids = array("I")
        for part in self._merged(list(stretch)):
            n = self.ids.get(part)
            if n is None:
                ids.extend([self.bytes[b] for b in part.encode()])
            else:
                ids.append(n)
        return ids.tobytes()

    def _merged(self, parts: list[str]) -> Iterator[str]:
        """Merges in a long stretch: offers wait in a heap, those that an earlier merge made void are passed over."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap, scores = [], self.scores

        def offer(a, b):
            if (score := scores.get(both := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-score, a, b, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not parts[a] or not parts[b] or after[a] != b or len(parts[a]) + len(parts[b]) != len(both):
                continue
            parts[a], parts[b], after[a] = both, "", after[b]
            if after[b] < len(parts):
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        return filter(None, parts)

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes that each id covers; of a character in byte pieces the last one covers all."""
        size = self.sizes[ids]
        if len(lead := np.flatnonzero(self.leads[ids])):
            size[lead + self.leads[ids[lead]] - 1] = self.leads[ids[lead]]
        return size

    def normalise(self, data: bytes, first: bool = True) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and for their end the source byte it comes from."""
        if not data:
            return b"", np.zeros(1, np.int64)
        raw, source = self.map.apply(data) if self.map else (data, np.arange(len(data)))
        value, stop, lead = np.frombuffer(raw, np.uint8), len(data), 0
        if self.squeeze:
            blank = value == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            if not keep.any():
                return b"", np.array([len(data)])
            lead = int(source[np.flatnonzero(keep)[0]])
            value, source = value[keep], source[keep]
        if self.escape:
            blank = value == 32
            times = np.where(blank, 3, 1)
            place, source = np.cumsum(times) - times, np.repeat(source, times)
            wide = np.repeat(value, times)
            for i, b in enumerate(SPACE.encode()):
                wide[place[blank] + i] = b
            value = wide
        space = SPACE.encode() if self.escape else b" "
        norm = value.tobytes()
        if first and self.dummy:
            norm, source = space + norm, np.concatenate([np.full(len(space), lead), source])
        if self.squeeze:
            while norm.endswith(space):
                norm = norm[:-len(space)]
                stop = int(source[len(norm)])
                source = source[:len(norm)]
        return norm, np.append(source, stop)

    def cuts(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, part) of a text, cut before a blank after another character where that changes nothing."""
        at = 0
        while at < len(data):
            stop = len(data)
            if not self.whole and stop - at > STRETCH:
                found = re.compile(rb"(?<=[^ \x81]) ").search(data, at + STRETCH)
                stop = found.start() if found else stop
            yield at, data[at:stop]
            at = stop

    def encode(self, data: bytes, known: Known) -> tuple[np.ndarray, np.ndarray]:
        """Ids between begin and end id, and for each the first source byte and the one after the last."""
        ids, spans = [np.array([self.begin], "<u4")], [np.zeros((1, 2), "<u4")]
        for start, part in self.cuts(data):
            norm, source = self.normalise(part, start == 0)
            found = np.frombuffer(b"".join(map(known.__getitem__, self.stretches.findall(norm.decode()))), "<u4")
            ids.append(found)
            ends = np.cumsum(self.lengths(found))
            spans.append((start + np.stack([source[np.concatenate([[0], ends[:-1]])[:len(ends)]], source[ends]], 1)).astype("<u4"))
        ids.append(np.array([self.end], "<u4"))
        spans.append(np.full((1, 2), len(data), "<u4"))
        return np.concatenate(ids), np.concatenate(spans)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids are silent, the blank before the first word goes, broken bytes become U+FFFD."""
        parts = list(map(self.raw.__getitem__, ids.tolist()))
        shown = np.flatnonzero(self.kinds[ids] != CONTROL)
        for i in shown.tolist() if self.dummy or self.squeeze else []:
            if not self.opens[ids[i]]:
                break
            parts[i] = parts[i][1:]
            if parts[i] or not self.squeeze:
                break
        if (self.kinds[ids[1:-1]] != CONTROL).all():
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        return self._mended(ids, parts)

    def _mended(self, ids: np.ndarray, parts: list[bytes]) -> str:
        """Each byte that is no part of a character in its run of byte pieces becomes U+FFFD."""
        single = self.kinds[ids] == BYTE
        bounds = [0, *(np.flatnonzero(np.diff(single)) + 1).tolist(), len(ids)]
        out = []
        for a, b in zip(bounds, bounds[1:]):
            run = b"".join(parts[a:b])
            while run:
                try:
                    out.append(run.decode())
                    run = b""
                except UnicodeDecodeError as e:
                    out.append(run[:e.start].decode() + "�")
                    run = run[e.start + 1:]
        return "".join(out)


@functools.lru_cache(1)
def model(path: str | None) -> Model:
    """One for each Python worker; it holds the vocabulary only."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return Model(f.read())


@functools.lru_cache(1)
def remembered(path: str | None) -> Known:
    """What the tasks of a Python worker share; it stays below CACHE bytes."""
    return Known(model(path))


def _batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of (bytes held, row) pairs."""
    out, held = [], 0
    for size, row in rows:
        out.append(row)
        held += size
        if held >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("spans", pa.binary())])
_DECODED = pa.schema([*_ENCODED, ("decoded", pa.string())])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, spans) of (doc_id, text) rows.

    `ids`: little-endian unsigned 32-bit integers; `spans`: for each id the first source byte and the one after the last,
    likewise. `path`: a model file each executor has; None: the public 32,000 pieces.
    """
    def rows(batches):
        m, known = model(path), remembered(path)
        for b in batches:
            text = b.column("text")
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                ids, spans = m.encode(text[i].as_buffer().to_pybytes(), known)
                yield 12 * len(ids), (doc, len(ids), ids.tobytes(), spans.tobytes())

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")),
                    lambda batches: _batches(rows(batches), _ENCODED), "doc_id long, n_tokens long, ids binary, spans binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of `encode` and the text of their ids as `decoded`."""
    def rows(batches):
        m = model(path)
        for b in batches:
            ids = b.column("ids")
            for i, row in enumerate(b.select(["doc_id", "n_tokens"]).to_pylist()):
                raw, spans = ids[i].as_py(), b.column("spans")[i].as_py()
                text = m.decode(np.frombuffer(raw, "<u4"))
                yield len(raw) + len(spans) + len(text), (row["doc_id"], row["n_tokens"], raw, spans, text)

    return in_arrow(encoded.select("doc_id", "n_tokens", "ids", "spans"), lambda batches: _batches(rows(batches), _DECODED),
                    "doc_id long, n_tokens long, ids binary, spans binary, decoded string")
