"""Token counts from flat token files: a separator scan.

A token file is one run of 32-bit ids without an index; each document ends with an end id that no text can give. Files are
kept as blocks of equal size that do not know documents. Each block is searched for end ids in one vectorised comparison;
the numbers of ids and ends and the last end of the blocks before it, by a prefix scan over a file's blocks, place its ends
in the file and give each document its number and its length, also across blocks.

Defined cases: null text is empty and counts 0 ids; repeated rows are counted each; a null id is passed on; no rows give no
rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.base import in_arrow, slices, written
from codesieve.llm.packing import MEMORY, encoder

#: The first id after the vocabulary's last. A block is a quarter of a MB: blocks of a MB are objects that Spark's heap places one by one.
END_ID, BLOCK_IDS = 49_408, 1 << 16
_FLAT = pa.schema([("file", pa.int64()), ("at", pa.int64()), ("data", pa.binary()), ("doc_id", pa.int64()), ("listed", pa.bool_())])
_ENDS = pa.schema([("file", pa.int64()), ("at", pa.int64()), ("n_ids", pa.int64()), ("ends", pa.list_(pa.int64()))])


def flat_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token files, one for each task: rows with `data` are a file's blocks, the others (`listed`) list its documents in order."""
    def run(batches):
        file, held, size, block, number, end = TaskContext.get().partitionId(), [], 0, 0, 0, np.array([end_id], "<u4").tobytes()
        for b in (part for batch in batches for part in slices(batch)):
            encode, rows = encoder(tokenizer, MEMORY // 2), []
            column = b.column("text")
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                rows.append((file, number, None, doc, True))
                number += 1
                held.append(encode(column[i].as_py() or "") + end)
                size += len(held[-1])
                if size >= 4 * block_ids:
                    flat = b"".join(held)
                    for at in range(0, size - size % (4 * block_ids), 4 * block_ids):
                        rows.append((file, block, flat[at:at + 4 * block_ids], None, False))
                        block += 1
                    held, size = [flat[size - size % (4 * block_ids):]], size % (4 * block_ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FLAT)], schema=_FLAT)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((file, block, b"".join(held), None, False), _FLAT)], schema=_FLAT)

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "file long, at long, data binary, doc_id long, listed boolean")


def boundaries(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(file, number, start, n_tokens) of each document from a file's blocks (file, at, data)."""
    def run(batches):
        for b in batches:
            ids = [np.frombuffer(x, "<u4") for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("at"), pa.array([len(x) for x in ids], pa.int64()), pa.array([np.flatnonzero(x == end_id) for x in ids], pa.list_(pa.int64()))], schema=_ENDS)

    ends = in_arrow(blocks.select("file", "at", "data"), run, "file long, at long, n_ids long, ends array<long>")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"ids": F.coalesce(F.sum("n_ids").over(before), F.lit(0)), "number": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))})
    ends = ends.withColumn("start", F.coalesce(F.max(F.col("ids") + F.try_element_at("ends", F.lit(-1)) + 1).over(before), F.lit(0)))
    placed = F.transform("ends", lambda e: F.col("ids") + e)
    starts = F.slice(F.concat(F.array("start"), F.transform(placed, lambda e: e + 1)), F.lit(1), F.size("ends"))
    spans = F.posexplode(F.zip_with(starts, placed, lambda s, e: F.struct(s.alias("start"), (e - s).alias("n_tokens"))))
    return ends.select("file", "number", spans.alias("i", "span")).select("file", (F.col("number") + F.col("i")).alias("number"), "span.start", "span.n_tokens")


def counts(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, file, start, n_tokens): the number of ids of each document, found in flat token files."""
    flat = written(flat_files(docs, tokenizer, end_id, block_ids))
    listed = flat.where("listed").select("file", F.col("at").alias("number"), "doc_id")
    return listed.join(boundaries(flat.where("not listed"), end_id), ["file", "number"]).select("doc_id", "file", "start", "n_tokens")
