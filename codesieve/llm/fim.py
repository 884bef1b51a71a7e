"""Fill-in-the-middle transformation by rotating blocks of a text in place.

A text is cut in prefix, middle and suffix. Spark's functions draw the cuts and the form from a hash of the id; the task
then scans the bytes for the places of the cuts, inserts the three marks in a bytearray (`<P>` prefix `<M>` middle `<S>`
suffix) and exchanges neighbouring blocks by three reversals: middle and suffix for psm, everything before the suffix with
it for spm. Reversals and scans go block by block, so a text needs its own size and no more. `restored` finds the marks,
which the text itself cannot hold, turns the same rotation back and takes the marks out.

Nothing is shuffled. Batches are given on once they hold FLUSH bytes.

Defined cases: null text is empty; an empty text and one that holds a mark stay plain; a null id is hashed as no digits; rows
that share an id share its draws, each on its own text; no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.base import in_arrow

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = len(PREFIX)
#: Percentage of texts that are transformed, and of those the percentage in the order suffix, prefix, middle.
CHANGED, SUFFIX_FIRST = 90, 20
BLOCK, FLUSH = 1 << 16, 8 << 20


def places(text: bytes, cuts: list[int]) -> list[int]:
    """Byte places of ascending cuts given in code points."""
    found, seen = [], 0
    for at in range(0, len(text) + 1, BLOCK):
        starts = np.flatnonzero((np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at) & 0xC0) != 0x80)
        while len(found) < len(cuts) and cuts[len(found)] < seen + len(starts):
            found.append(at + int(starts[cuts[len(found)] - seen]))
        seen += len(starts)
    return found + [len(text)] * (len(cuts) - len(found))


def flip(view: np.ndarray, a: int, b: int) -> None:
    """Reverse view[a:b], a block from each end at a time."""
    while b - a > 1:
        n = min(BLOCK, (b - a) // 2)
        left = view[a:a + n].copy()
        view[a:a + n] = view[b - n:b][::-1]
        view[b - n:b] = left[::-1]
        a, b = a + n, b - n


def exchange(buffer: bytearray, a: int, middle: int, b: int) -> None:
    """Swap buffer[a:middle] and buffer[middle:b] by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    flip(view, a, middle)
    flip(view, middle, b)
    flip(view, a, b)


def rotate(text: bytes, first: int, second: int, form: str) -> bytes | bytearray:
    """The text in a form, cut after `first` and `second` code points."""
    if form == "plain":
        return text
    one, two = places(text, [first, second])
    buffer = bytearray(text)
    for at, mark in ((two, SUFFIX), (one, MIDDLE), (0, PREFIX)):
        buffer[at:at] = mark
    exchange(buffer, one + MARK if form == "psm" else 0, two + 2 * MARK, len(buffer))
    return buffer


def unrotate(output: bytes, form: str) -> bytes | bytearray:
    """The text that `rotate` was given."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "psm":
        exchange(buffer, buffer.index(SUFFIX), buffer.index(MIDDLE), len(buffer))
    else:
        exchange(buffer, 0, buffer.index(PREFIX), len(buffer))
    for at in (buffer.index(SUFFIX), buffer.index(MIDDLE), 0):
        del buffer[at:at + MARK]
    return buffer


def _mapped(df: DataFrame, name: str, columns: list[str], f) -> DataFrame:
    """`df` with a text column made row by row by f(bytes of the first of `columns`, values of the others)."""
    schema = f"{', '.join(f'`{x.name}` {x.dataType.simpleString()}' for x in df.schema)}, {name} string"

    def run(batches):
        for batch in batches:
            inputs, out, held, start = [batch.column(c) for c in columns], [], 0, 0
            for i in range(batch.num_rows):
                made = f(inputs[0][i].as_buffer().to_pybytes(), *(x[i].as_py() for x in inputs[1:]))
                out.append(bytes(made))
                held += len(made)
                if held >= FLUSH or i == batch.num_rows - 1:
                    rows = batch.slice(start, len(out))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary()).cast(pa.string())], [*batch.schema.names, name])
                    out, held, start = [], 0, i + 1

    return in_arrow(df, run, schema)


def _draw(mark: Column, i: int) -> Column:
    return F.conv(F.substring(mark, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 1, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of (doc_id, text) rows; lengths in code points, null if plain."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns({"mark": mark, "n": F.char_length("text").cast("long")})
    one, two = (_draw(F.col("mark"), i) % (F.col("n") + 1) for i in (0, 1))
    plain = (F.col("n") == 0) | (_draw(F.col("mark"), 2) % 100 >= changed)
    for m in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.col("text").contains(m.decode())
    form = F.when(plain, "plain").when(_draw(F.col("mark"), 3) % 100 < suffix_first, "spm").otherwise("psm")
    df = df.select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))
    cut = F.col("form") != "plain"
    return _mapped(df, "output", ["text", "first", "second", "form"], rotate).select(
        "doc_id", "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"), F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"), "output")


def restored(transformed: DataFrame) -> DataFrame:
    """Rows with `output` and `form`, and the text they were made from as `restored`."""
    return _mapped(transformed, "restored", ["output", "form"], unrotate)
