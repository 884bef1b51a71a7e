"""Merkle manifest of a table: one tree per group, a tree over the groups' roots, and a proof for each row.

Leaves are hashed where the rows are read, so no text is shuffled. They are placed in their group by range partitions and
offsets, and BLOCK neighbours at a time become subtrees, until one node of each group is left. Every node then holds its
sibling as a segment towards its parent. Pointer jumping makes the proofs: a node joins the ancestor its segment ends at and
takes that node's segment over behind its own, so the distance doubles with each self-join. Nodes that no later join asks
for are dropped: after k joins those at levels that are no multiple of 2^k. The same is done with the groups' roots, and their
segments up to the root are put behind those of their leaves.

A position names the side at every level, so a segment is a chain of 33-byte entries: whether there is a sibling, on which
side, and its digest. Ancestors at a far level are few; they are broadcast below FEW bytes by their counted number, otherwise
joined, with even keys since trees are complete. Rows of a group meet its root's segment by broadcast or, with many groups, by
(group, slice).

Defined cases: nulls of any column are leaves like others (`-`); null ids come first, null groups too; rows equal in id are
ordered by their digest, and equal rows in any order, which gives the same digests; a lone leaf is its group's root, a lone
group's root is the root; empty and very long texts are hashed whole; no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.base import forget, in_arrow, written
from codesieve.llm.order import ranked

#: Levels that one shuffle builds, the entry's size in a segment, and the most bytes of ancestors that are broadcast.
LEVELS, ENTRY, FEW = 8, 33, 8 << 20
SLICES = 256
NO_SIBLING, SIBLING_LEFT, SIBLING_RIGHT = b"\0", b"\1", b"\2"


def digest(*hexes: bytes) -> bytes:
    """The hash of digests, given and taken as hex text."""
    return hashlib.sha256(b"".join(hexes)).digest()


def leaf(columns: Sequence[Column]) -> Column:
    """The digest of a row: each column as `-` if null, else its length in UTF-8 bytes, `:`, value."""
    shown = []
    for c in columns:
        c = c.cast("string")
        shown.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*shown), 256))


def attach(rows: DataFrame, few: DataFrame, key: str, slice_by: Column, most: int) -> DataFrame:
    """Join with a table of one row per key; where it has more than `most` bytes, hot keys are cut in slices."""
    if (few.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0) <= most:
        return rows.join(F.broadcast(few), key)
    few = few.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return rows.withColumn("_slice", F.pmod(slice_by, F.lit(SLICES)).cast("int")).join(few, [key, "_slice"]).drop("_slice")


_NODES = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("hash", pa.binary()), ("segment", pa.binary()), ("doc_id", pa.int64()), ("other", pa.binary())])
NODES = "tree long, level int, at long, size long, hash binary, segment binary, doc_id long, other binary"


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _nodes(block: list[tuple], level: int, levels: int) -> Iterator[tuple]:
    """The nodes of the subtree over neighbours (tree, at, size, hash, doc_id, other) at `level`; the one `levels` above has no segment yet."""
    tree, first, size = block[0][:3]
    hashes, width = [x[3] for x in block], -(-size >> level)
    for up in range(levels):
        for i, h in enumerate(hashes):
            if width == 1:
                segment = b""
            elif i ^ 1 < len(hashes):
                segment = (SIBLING_LEFT if i & 1 else SIBLING_RIGHT) + hashes[i ^ 1]
            else:
                segment = NO_SIBLING + bytes(ENTRY - 1)
            yield tree, level + up, (first >> up) + i, size, h, segment, *(block[i][4:] if up == 0 else (None, None))
        if width == 1:
            return
        hashes = [digest(*(x.hex().encode() for x in hashes[i:i + 2])) for i in range(0, len(hashes), 2)]
        width = (width + 1) // 2
    yield tree, level + levels, first >> levels, size, hashes[0], None, None, None


def _subtrees(level: int, levels: int):
    """A function for mapInArrow over nodes of one level in the order of tree and place."""
    def run(batches):
        block, rows = [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "at", "size", "hash", "doc_id", "other"))):
                if block and (block[0][0] != row[0] or block[0][1] >> levels != row[1] >> levels):
                    rows += _nodes(block, level, levels)
                    block = []
                block.append(row)
                if len(rows) >= 1 << 14:
                    yield _record(rows, _NODES)
                    rows = []
        if block:
            yield _record([*rows, *_nodes(block, level, levels)], _NODES)
    return run


def height(size: int) -> int:
    """The level of the root over so many leaves."""
    return max(size - 1, 0).bit_length()


def build(leaves: DataFrame, largest: int, levels: int = LEVELS) -> list[DataFrame]:
    """Tables of the nodes of all trees, from (tree, at, size, hash, doc_id, other); `largest`: leaves of the largest tree."""
    tables, level, current = [], 0, leaves
    while True:
        blocks = current.repartition("tree", F.shiftright("at", levels)).sortWithinPartitions("tree", "at")
        made = written(in_arrow(blocks.select("tree", "at", "size", "hash", "doc_id", "other"), _subtrees(level, levels), NODES))
        tables.append(made.where("segment is not null"))
        level += levels
        if height(largest) < level:
            return tables
        current = made.where("segment is null")


def climb(tables: list[DataFrame], largest: int, most: int = FEW) -> DataFrame:
    """The leaves, each with its segment up to its tree's root."""
    leaves, uppers = tables[0].where("level = 0").drop("level"), together(tables).where("level > 0").select("tree", "level", "at", "segment")
    step = 1
    while step < height(largest):
        far = uppers.where(F.col("level") % (2 * step) == step).select("tree", (F.col("level") - step).alias("level"), F.col("at").alias("up"), F.col("segment").alias("more"))
        here = far.where("level = 0").drop("level")
        small = here.count() * (ENTRY * step + 100) <= most
        leaves = _joined(leaves.withColumn("up", F.shiftright("at", step)), F.broadcast(here) if small else here, ["tree", "up"])
        near = uppers.where(F.col("level") % (2 * step) == 0).withColumn("up", F.shiftright("at", step))
        step *= 2
        if step < height(largest):
            uppers = written(_joined(near, far, ["tree", "level", "up"]))
    return leaves


def together(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def _joined(near: DataFrame, far: DataFrame, on: list[str]) -> DataFrame:
    return near.join(far, on, "left").withColumn("segment", F.concat("segment", F.coalesce("more", F.lit(b"")))).drop("more", "up")


_PROOFS = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("siblings", pa.list_(pa.string())), ("folded_root", pa.string())])
PROOFS = "doc_id long, leaf string, subroot string, root string, siblings array<string>, folded_root string"


def _folded(batches):
    """Proofs as digests in hex, and the root that each row's digest as received and its proof give."""
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        proofs, roots = [], []
        for received, segment in zip(columns["other"], columns["segment"]):
            siblings, h = [], received.hex().encode()
            for i in range(0, len(segment), ENTRY):
                side, sibling = segment[i:i + 1], segment[i + 1:i + ENTRY].hex().encode()
                if side == NO_SIBLING:
                    h = digest(h).hex().encode()
                else:
                    siblings.append(sibling.decode())
                    h = digest(*((sibling, h) if side == SIBLING_LEFT else (h, sibling))).hex().encode()
            proofs.append(siblings)
            roots.append(h.decode())
        shown = [[x.hex() for x in columns[c]] for c in ("hash", "subroot", "root")]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([columns["doc_id"], *shown, proofs, roots], _PROOFS)], schema=_PROOFS)


def manifest(docs: DataFrame, columns: Sequence[str], group: str, received: Column | None = None, levels: int = LEVELS, most: int = FEW) -> DataFrame:
    """(doc_id, leaf, subroot, root, siblings, folded_root): `siblings` from the leaf's level to the root, in hex.

    Rows are ordered by doc_id within `group`. `received`: the digest of the row as it came in, to be folded with the proof;
    None: the row's own. `levels` that one shuffle builds; `most`: bytes that are broadcast.
    """
    mine = leaf([F.col(f"`{c}`") for c in columns])
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # null: before all others
    hashed = written(docs.select(name.alias("group"), F.col("doc_id").cast("long").alias("doc_id"), mine.alias("hash"), (mine if received is None else received).alias("other")))
    placed = ranked(hashed.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")), "group", "doc_id", "hash", "_file", "_row", name="place")
    forget(hashed)
    groups = ranked(placed.groupBy("group").agg(F.count("*").alias("size"), F.min("place").alias("start")), "group", name="tree")
    largest, trees = groups.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
    leaves = attach(placed, groups, "group", F.col("place"), most)
    tables = build(leaves.select("tree", (F.col("place") - F.col("start")).alias("at"), "size", "hash", "doc_id", "other"), largest, levels)
    forget(placed)
    roots = together(tables).where("size <= shiftleft(1L, level) and (level = 0 or size > shiftleft(1L, level - 1))")
    nothing = {"doc_id": F.lit(None).cast("long"), "other": F.lit(None).cast("binary")}
    tops = build(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(trees).cast("long").alias("size"), "hash", *(c.alias(n) for n, c in nothing.items())), trees, levels)
    root = tops[-1].where(F.col("level") == height(trees)).select("hash").first()
    above = written(climb(tops, trees, most).select(F.col("at").alias("tree"), F.col("hash").alias("subroot"), F.col("segment").alias("above"), F.lit(root.hash if root else None).cast("binary").alias("root")))
    proofs = attach(climb(tables, largest, most), above, "tree", F.col("at"), most)
    return in_arrow(proofs.select("doc_id", "hash", "other", "subroot", "root", F.concat("segment", "above").alias("segment")), _folded, PROOFS)
