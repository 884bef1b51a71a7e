"""Chat formatting with a grammar round trip.

A turn is written as `<|im_start|>role\\ntext<|im_end|>\\n`. Each turn is first rendered as it is and read again by the
strict parser below; if the parser fails or finds another role or text, the conflicting control strings are escaped and
the turn is read again. Escaping puts one more backslash between `<` and `|`; the parser always takes one away, so any
text comes back unchanged, also one that holds backslashes of this kind already. Line feeds in a role become `<|nl|>`.

Defined cases: null role or text is empty; turns are ordered by (turn, rendered text) with null turns first, so ties and
repeated rows have a fixed order; a null conversation id is a conversation of its own; no rows give no conversations;
columns other than the four named are not looked at. A conversation is streamed in turn order, never held as a whole: it
leaves as parts of about `part_chars` characters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.base import in_arrow

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
LOSS_ROLE = "assistant"
PART_CHARS = 1 << 20


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


class Broken(ValueError):
    """The text does not follow the grammar."""


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end enclose the turn's text as it stands in the rendering."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise Broken(at)
        line = text.find("\n", at)
        end = text.find(END, at)
        if line < 0 or end < line:
            raise Broken(at)
        head, body = text[at + len(START):line], text[line + 1:end]
        if START in head or START in body or BREAK in body or not text.startswith("\n", end + len(END)):
            raise Broken(at)
        yield unescape(head.replace(BREAK, "\n")), unescape(body), line + 1, end
        at = end + len(END) + 1


def render(role: str, text: str) -> str:
    """The turn as it is where that reads back, else escaped."""
    plain = f"{START}{role}\n{text}{END}\n"
    for rendered in (plain, f"{START}{escape(role)}\n{escape(text)}{END}\n", f"{START}{escape(role).replace(chr(10), BREAK)}\n{escape(text)}{END}\n"):
        try:
            if [t[:2] for t in parse(rendered)] == [(role, text)]:
                return rendered
        except Broken:
            continue
    raise AssertionError("an escaped turn always reads back")


_TURN = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("rendered", pa.string())])
_PART = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
PART_SCHEMA = "conv_id long, part long, text string, loss_start array<long>, loss_end array<long>"
READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _render_batches(batches):
    for b in batches:
        role, text = b.column("role").to_pylist(), b.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array([render(r or "", t or "") for r, t in zip(role, text)], pa.string())], schema=_TURN)


class _Rows:
    """Collects rows and hands them on in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.size += size

    def take(self, all_of_them: bool = False):
        if self.rows and (all_of_them or len(self.rows) >= 2000 or self.size >= 8 * PART_CHARS):
            yield pa.RecordBatch.from_pylist([dict(zip(self.schema.names, r)) for r in self.rows], schema=self.schema)
            self.rows, self.size = [], 0


def _join_turns(part_chars: int):
    def run(batches):
        out, none = _Rows(_PART), object()
        conv, part, chars, held, size, starts, ends = none, 0, 0, [], 0, [], []

        def close():
            nonlocal part, held, size, starts, ends
            if held:
                out.add((conv, part, "".join(held), starts, ends), size)
                part, held, size, starts, ends = part + 1, [], 0, [], []

        for b in batches:
            for c, r in zip(b.column("conv_id").to_pylist(), b.column("rendered").to_pylist()):
                if c != conv:
                    close()
                    conv, part, chars = c, 0, 0
                (role, _, start, end), = parse(r)
                if role == LOSS_ROLE:
                    starts.append(chars + start)
                    ends.append(chars + end)
                held.append(r)
                chars, size = chars + len(r), size + len(r)
                if size >= part_chars:
                    close()
            yield from out.take()
        close()
        yield from out.take(True)
    return run


def format_chat(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Conversations as text in the template: (conv_id, part, text, loss_start, loss_end).

    Parts of a conversation follow each other without anything between; loss spans are offsets in the whole conversation
    and enclose the (escaped) texts of the assistant.
    """
    narrow = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rendered = in_arrow(narrow, _render_batches, "conv_id long, turn long, rendered string")
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return in_arrow(ordered, _join_turns(part_chars), PART_SCHEMA)


def _read_batches(batches):
    out, none, conv = _Rows(_READ), object(), None
    conv = none

    def close():
        if conv is not none:
            out.add((conv, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for b in batches:
        for c, text, starts, ends in zip(*(b.column(x).to_pylist() for x in ("conv_id", "text", "loss_start", "loss_end"))):
            if c != conv:
                close()
                conv, n, chars, loss_chars, all_turns, loss = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, said, _, _ in parse(text):
                n += 1
                all_turns.update(f"{role}\n{said}\n".encode())
            for s, e in zip(starts, ends):
                said = unescape(text[s - chars:e - chars])
                loss_chars += len(said)
                loss.update(said.encode())
            chars += len(text)
        yield from out.take()
    close()
    yield from out.take(True)


def read_back(formatted: DataFrame, ordered: bool = False) -> DataFrame:
    """Parse formatted conversations: turns, and the text under the loss mask, as counts and digests.

    `ordered`: the parts of each conversation already follow each other in one partition, as `format_chat` leaves them.
    """
    if not ordered:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return in_arrow(formatted, _read_batches, READ_SCHEMA)
