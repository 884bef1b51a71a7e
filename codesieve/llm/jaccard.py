"""Exact similarity join of documents on their sets of word runs, by token-combination prefixes.

Tokens are hashes of word runs, ordered by hash. Documents with equal sets are one class from the start. Similar sets differ
so little that the first tokens of both must overlap (prefix filter). A set of n tokens may lack s = spare(n) of them in a
similar one; x lacks dx <= s in y, and 's >= dx + floor(dy * percent / 100)' holds on either side.

* A set with s + 1 rare tokens among its first ones (`reach`) indexes these alone, the lowest first. The lowest rare token
  that two such sets share is at most the (s + 1)-th rare one of each. So a passage in many documents brings none together
  that have enough of their own.
* Any other set indexes all rare tokens among its first `stored`, and each frequent one of the first 2s + 4 with the token
  after it. Two such sets share an entry: the first 2s + 4 tokens hold at least s + 4 common ones, more than the tokens that
  could stand between them, so two common ones are neighbours in both. It shares one with a set of the first kind too: what
  is at place q there is at place q + dy here at most, and `reach` leaves room for that.

Which tokens are frequent changes the work, never the result. They are counted where one piece of a task's tokens holds them
twice, so that only those are shuffled; `FREQUENT` is doubled until the class fits a broadcast of MAX_FREQUENT tokens. Index
entries found in one class only are dropped. Small entries give pairs by a join. Large ones are cut in blocks; parity bitmaps
(each set bit says that an odd number of tokens fell there, so two bitmaps differ in no more bits than the sets in tokens)
leave out what cannot be similar. First each document is paired with its nearest candidate in its own block and in the
entry's first block, a number of pairs in proportion to the documents. All pairs are then verified on whole sets; when the
links found so far have been followed, all blocks of the entries that still hold several components meet pairwise, and every
candidate pair that is not yet connected is verified too. So no group's pairs are all written down, and no link that could
join two components is missed.

Defined cases: null text is empty; a text of fewer words than a run is one token; texts without words are linked with
nothing and are components of their own; null ids come first; rows that share an id are taken in the order of a hash of
their text; no rows give no rows; `keep_first` passes all columns on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.base import WordHash, forget, in_arrow, mixed, run_hashes, slices, texts, written
from codesieve.llm.graph import components
from codesieve.llm.order import LOWEST, by_key

RUN, PERCENT = 4, 85
FREQUENT, MAX_FREQUENT, PIECE, SMALL, BLOCK, BITS, LOW = 32, 1 << 20, 1 << 21, 8, 512, 512, 8


def token_set(text: bytes, run: int, known: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the word runs of a text, A-Z as a-z."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(known.of(words), min(run, len(words)), seed=min(run, len(words))))


def spare(n, percent: int):
    """How many tokens of a set of n a similar set may lack."""
    return n - -(-percent * n // 100)


def stored(n, percent: int):
    """How many of the first tokens of a set of n are kept for the index."""
    return 3 * spare(n, percent) + 8


def reach(n, percent: int):
    """Among how many first tokens a set of n looks for rare ones: with those that any similar set may have in between, they are in what that set has stored."""
    return 2 * spare(n - spare(n, percent), percent) + 8


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity bits of a set, at least BITS and two for each token, so that long sets tell apart as well as short ones.

    The size is a power of two; a larger bitmap becomes a smaller one when its halves are added.
    """
    size = max(BITS, 1 << int(2 * len(tokens)).bit_length())
    odd = (np.bincount((tokens % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, words), 0)


_DOC = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("prefix", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("brief", pa.list_(pa.int64()))])
_DOC_COLUMNS = "key long, n long, hi long, lo long, prefix array<long>, bits array<long>, brief array<long>"


def _describe(run: int, percent: int):
    def f(batches):
        known = WordHash()
        for batch in (part for whole in batches for part in slices(whole)):
            n, ids, prefixes, bits = [], [], [], []
            for text in texts(batch):
                s = token_set(text, run, known)
                n.append(len(s))
                ids.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                prefixes.append(s[:stored(len(s), percent)].view(np.int64).copy())
                bits.append(bitmap(s))
            ids = np.array(ids, np.int64).reshape(len(n), 2)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            widths = np.concatenate([[0], np.cumsum([len(b) for b in bits])]).astype(np.int32)
            briefs = [folded(b, max(BITS, 1 << (m - 1).bit_length()) // 64) if m > 1 else folded(b, BITS // 64) for b, m in zip(bits, n)]
            narrow = np.concatenate([[0], np.cumsum([len(b) for b in briefs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.array(n, pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)]).astype(np.int64))),
                pa.ListArray.from_arrays(pa.array(widths), pa.array(np.concatenate([*bits, np.zeros(0, np.int64)]).astype(np.int64))),
                pa.ListArray.from_arrays(pa.array(narrow), pa.array(np.concatenate([*briefs, np.zeros(0, np.int64)]).astype(np.int64)))], schema=_DOC)
    return f


_TOKEN = pa.schema([("t", pa.int64()), ("n", pa.int64())])


def _repeated(batches):
    """Tokens that a piece of at most about PIECE tokens holds twice or more, and how often."""
    held, size = [], 0

    def counted():
        t, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(t[n > 1]), pa.array(n[n > 1].astype(np.int64))], schema=_TOKEN)

    for batch in batches:
        held.append(batch.column("prefix").flatten().to_numpy(zero_copy_only=False).copy())
        size += len(held[-1])
        if size >= PIECE:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


_ENTRY = pa.schema([("k", pa.int64()), ("c", pa.int64()), ("n", pa.int64())])


def entry_keys(tokens: np.ndarray, hot: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Index entries of a set of n tokens, from its stored ones and which of these are frequent."""
    short = spare(n, percent) + 1
    rare = np.flatnonzero(~hot[:reach(n, percent)])[:short]
    if len(rare) == short:
        return mixed(tokens[rare] + np.uint64(1))
    upto = min(n, 2 * spare(n, percent) + 4)
    after = np.zeros(upto, np.uint64)
    after[:min(upto, len(tokens) - 1)] = tokens[1:upto + 1]
    pairs = mixed(mixed(tokens[:upto]) + after)[hot[:upto]]
    return np.concatenate([mixed(tokens[~hot] + np.uint64(1)), pairs])


def _entries(frequent, percent: int):
    """Index entries of each class."""
    def f(batches):
        often = frequent.value
        for batch in batches:
            ks, cs, ns = [], [], []
            column = batch.column("prefix")
            flat, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
            is_often = np.zeros(len(flat), bool)
            if len(often):
                at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
                is_often = often[at] == flat
            for i, (c, n) in enumerate(zip(batch.column("key").to_pylist(), batch.column("n").to_pylist())):
                a, b = int(offsets[i]), int(offsets[i + 1])
                k = entry_keys(flat[a:b], is_often[a:b], n, percent)
                ks.append(k)
                cs.append(np.full(len(k), c, np.int64))
                ns.append(np.full(len(k), n, np.int64))
            if ks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks).view(np.int64)), pa.array(np.concatenate(cs)), pa.array(np.concatenate(ns))], schema=_ENTRY)
    return f


_INDEX = pa.schema([*_ENTRY, ("cnt", pa.int64())])


def _shared(batches):
    """Of rows sorted by entry, those of entries that several classes have, with their number."""
    def counted(rows: pa.RecordBatch, last: np.ndarray):
        """Rows of whole entries; `last` says which row is an entry's last."""
        ends = np.flatnonzero(last)
        sizes = np.diff(ends, prepend=-1)
        cnt = np.repeat(sizes, sizes)
        rows = pa.RecordBatch.from_arrays([*rows.columns, pa.array(cnt.astype(np.int64))], schema=_INDEX)
        return rows.filter(pa.array(cnt > 1))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, schema=_ENTRY)
        k = batch.column("k").to_numpy()
        same = held and held[-1].column("k")[held[-1].num_rows - 1].as_py() == k[0]
        if same and k[0] == k[-1]:
            held.append(batch)
            continue
        begin = int(np.searchsorted(k, k[-1]))
        rows = pa.Table.from_batches([*held, batch.slice(0, begin)], schema=_ENTRY).combine_chunks().to_batches()
        held = [batch.slice(begin)]
        for whole in rows:
            k = whole.column("k").to_numpy()
            yield counted(whole, np.append(k[1:] != k[:-1], True))
    for whole in pa.Table.from_batches(held, schema=_ENTRY).combine_chunks().to_batches():
        yield counted(whole, np.arange(whole.num_rows) == whole.num_rows - 1)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _groups(batches) -> Iterator[pa.Table]:
    """The rows of each (k, i, j) in turn, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = np.stack([batch.column(x).to_numpy() for x in ("k", "i", "j")])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        if held and batch.num_rows:
            last = held[-1]
            if any(last.column(x)[last.num_rows - 1].as_py() != batch.column(x)[0].as_py() for x in ("k", "i", "j")):
                yield pa.Table.from_batches(held)
                held = []
        for s, e in zip(cuts, cuts[1:]):
            if s:
                yield pa.Table.from_batches(held)
                held = []
            if e > s:
                held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _flat(g: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists in a row, and where each list starts and the last ends."""
    lists = g.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    starts = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False), starts


def _matrix(flat: tuple[np.ndarray, np.ndarray], rows: np.ndarray, size: int) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    return flat[0][flat[1][rows][:, None] + np.arange(size)]


def _bits(flat: tuple[np.ndarray, np.ndarray], rows: np.ndarray, size: int, words: int) -> np.ndarray:
    """Short bitmaps of `size` words; where that is twice what is asked for they are folded."""
    bits = _matrix(flat, rows, size).view(np.uint64)
    return bits if size == words else bits[:, :words] ^ bits[:, words:]


def _meet(percent: int, nearest: bool):
    """Candidate pairs of two blocks: each member's nearest, or all that are in different components.

    Two documents usually meet in many entries. Each carries its lowest entries; where both carry a lower one than this,
    the pair is left to that entry.
    """
    def f(batches):
        out, size = [], 0

        def flush():
            pairs = np.unique(np.concatenate(out), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_PAIR)

        for g in _groups(batches):
            c, n, side, label = (g.column(x).to_numpy() for x in ("c", "n", "side", "label"))
            k = g.column("k")[0].as_py()
            briefs = _flat(g, "brief")
            words = np.diff(briefs[1])
            same_block = g.column("i")[0].as_py() == g.column("j")[0].as_py()
            rows = np.arange(len(c)) if same_block else np.flatnonzero(side == 0)
            cols = rows if same_block else np.flatnonzero(side == 1)
            nearer, partner, found = np.full(len(c), 1 << 30), np.full(len(c), -1), [np.zeros((2, 0), np.int64)]
            # Similar sets have bitmaps of the same size or of neighbouring sizes.
            sizes = set(words.tolist())
            for w in sorted(sizes):
                for x, y in ((w, w), (w, 2 * w), (2 * w, w)) if 2 * w in sizes else ((w, w),):
                    r, q = (rows, cols) if len(sizes) == 1 else (rows[words[rows] == x], cols[words[cols] == y])
                    if not len(r) or not len(q) or same_block and x > y:
                        continue
                    p, o = _bits(briefs, r, x, w), _bits(briefs, q, y, w)
                    differ = np.zeros((len(r), len(q)), np.int32)
                    step = max(1, (1 << 18) // differ.size)
                    for i in range(0, w, step):
                        differ += np.bitwise_count(p[:, None, i:i + step] ^ o[None, :, i:i + step]).sum(2, dtype=np.int32)
                    total = n[r][:, None] + n[q][None, :]
                    good = (differ <= total - 2 * -(-percent * total // (100 + percent))) & (100 * np.minimum(n[r][:, None], n[q][None, :]) >= percent * np.maximum(n[r][:, None], n[q][None, :]))
                    good &= c[r][:, None] != c[q][None, :]
                    if not nearest:
                        good &= label[r][:, None] != label[q][None, :]
                        a, b = np.nonzero(good)
                        found.append(np.stack([r[a], q[b]]))
                        continue
                    differ = np.where(good, differ, 1 << 30)
                    for mine, theirs, d in ((r, q, differ),) if same_block and x == y else ((r, q, differ), (q, r, differ.T)):
                        at = d.argmin(1)
                        d = d[np.arange(len(mine)), at]
                        # Among equally near ones the lowest key, whatever block or size it is in.
                        closer = (d < nearer[mine]) | (d == nearer[mine]) & (d < 1 << 30) & (c[theirs[at]] < c[partner[mine]])
                        nearer[mine[closer]], partner[mine[closer]] = d[closer], theirs[at[closer]]
            a, b = (np.flatnonzero(partner >= 0), partner[partner >= 0]) if nearest else np.concatenate(found, 1)
            if len(a) and not nearest:
                low = _flat(g, "low")
                low_a, low_b = _matrix(low, a, LOW), _matrix(low, b, LOW)
                sooner = np.zeros(len(a), bool)
                for x in range(low_a.shape[1]):
                    sooner |= ((low_a[:, x][:, None] == low_b) & (low_b < k)).any(1)
                a, b = a[~sooner], b[~sooner]
            if len(a):
                pairs = np.unique(np.sort(np.stack([c[a], c[b]], 1), 1), axis=0)
                out.append(pairs)
                size += len(pairs)
            if size >= 50_000:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()
    return f


_SET = pa.schema([("c", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def _sets(run: int):
    def f(batches):
        known = WordHash()
        for part in (part for batch in batches for part in slices(batch)):
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([token_set(t, run, known).view(np.int64) for t in texts(part)], pa.list_(pa.int64()))], schema=_SET)
    return f


def _similar(n1, n2, both, percent: int):
    return 100 * both >= percent * (n1 + n2 - both)


def linked(docs: DataFrame, run: int = RUN, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, bool]:
    """Documents as (key, doc_id, n, c, c_doc, label, label_doc), their (key, row) for later use, and whether ids repeat.

    `c` is the lowest key among documents with the same set, `label` the lowest key of the component.
    """
    keyed, repeated = by_key(docs)
    narrow = keyed.select("key", "doc_id", "text")
    described = written(in_arrow(narrow.select("key", "text"), _describe(run, percent), _DOC_COLUMNS))
    classes = described.where("n > 0").groupBy("hi", "lo").agg(F.min("key").alias("c"))
    members = written(described.select("key", "n", "hi", "lo").join(classes, ["hi", "lo"], "left").select("key", "n", F.coalesce("c", "key").alias("c")).distinct())
    wide = written(described.where("n > 0").dropDuplicates(["key"]).join(members.where("key = c and n > 0").select("key"), "key", "left_semi") if repeated else
                   described.where("n > 0").join(members.where("key = c and n > 0").select("key"), "key", "left_semi"))
    forget(described)

    often = written(in_arrow(wide.select("prefix"), _repeated, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT))
    bound = FREQUENT
    while often.where(F.col("n") > bound).count() > MAX_FREQUENT:
        bound *= 2
    frequent = np.sort(np.array([r.t for r in often.where(F.col("n") > bound).select("t").collect()], np.int64).view(np.uint64))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent)
    forget(often)

    entries = in_arrow(wide.select("key", "n", "prefix"), _entries(frequent, percent), "k long, c long, n long")
    index = written(in_arrow(entries.repartition("k").sortWithinPartitions("k", "c"), _shared, "k long, c long, n long, cnt long"))

    few = index.where(F.col("cnt") <= SMALL)
    close = (F.col("x.c") < F.col("y.c")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    pairs = few.alias("x").join(few.alias("y"), "k").where(close).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))
    half = F.least(F.size("p"), F.size("q"))
    fold = lambda x: F.when(F.size(x) > half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(F.col(x))
    differ = F.aggregate(F.zip_with(fold("p"), fold("q"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("n_a") + F.col("n_b")

    def possible(some: DataFrame) -> DataFrame:
        """Pairs whose whole bitmaps do not rule them out."""
        some = some.join(wide.select(F.col("key").alias("a"), F.col("bits").alias("p"), F.col("n").alias("n_a")), "a").join(wide.select(F.col("key").alias("b"), F.col("bits").alias("q"), F.col("n").alias("n_b")), "b")
        return some.where(differ <= total - 2 * F.ceil(total * percent / (100 + percent))).select("a", "b")

    blocks = F.ceil(F.col("cnt") / BLOCK).cast("int")
    many = index.where(F.col("cnt") > SMALL).join(wide.select(F.col("key").alias("c"), "brief"), "c").withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("c"), blocks).cast("int")})
    many = written(many.select("k", "c", "n", "brief", "own", "blocks"))

    def meet(rows: DataFrame, nearest: bool) -> DataFrame:
        kept = ["k", "c", "n", "brief", "label"] + ([] if nearest else ["low"])
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        met = rows.select(*kept, "own", F.explode(F.when(F.col("own") > 0, F.array(F.lit(0), "own")).otherwise(every) if nearest else every).alias("other"))
        met = met.select(*kept, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
        return in_arrow(met.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "c"), _meet(percent, nearest), "a long, b long")

    def verified(some: DataFrame) -> DataFrame:
        """Pairs that are similar by their whole sets; these are made from the texts of the pairs' documents alone."""
        needed = some.select(F.col("a").alias("key")).unionByName(some.select(F.col("b").alias("key"))).distinct()
        source = narrow.select("key", "text").join(needed, "key", "left_semi")
        sets = written(in_arrow(source.dropDuplicates(["key"]) if repeated else source, _sets(run), "c long, tokens array<long>"))
        both = some.join(sets.select(F.col("c").alias("a"), F.col("tokens").alias("s")), "a").join(sets.select(F.col("c").alias("b"), F.col("tokens").alias("t")), "b")
        found = written(both.where(_similar(F.size("s"), F.size("t"), F.size(F.array_intersect("s", "t")), percent)).select("a", "b"))
        forget(sets)
        return found

    pairs = written(possible(pairs.select("a", "b").unionByName(meet(many.withColumn("label", F.col("c")), True)).distinct()))
    forget(index)
    links = verified(pairs)
    labels = written(components(links))
    forget(links)
    known = many.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("component", "c")).drop("component")
    # An entry whose members are all in one component has nothing more to say.
    open_entries = known.groupBy("k").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("k")
    known = written(known.join(open_entries, "k", "left_semi"))
    forget(many)
    lowest = known.groupBy("c").agg(F.sort_array(F.collect_set("k")).alias("ks")).select("c", F.transform(F.sequence(F.lit(1), F.lit(LOW)), lambda i: F.coalesce(F.try_element_at("ks", i), F.element_at("ks", 1))).alias("low"))
    later = written(possible(meet(known.join(lowest, "c"), False).distinct().join(pairs, ["a", "b"], "left_anti")))
    for done in (known, pairs, wide):
        forget(done)
    # The components so far are stars, so only what the later links join moves.
    stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    joined = written(components(stars.unionByName(verified(later))))
    for done in (labels, later):
        forget(done)
    labels = joined
    out = members.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("component", "c")).select("key", "n", "c", "label")
    return out, keyed, repeated


def groups(docs: DataFrame, run: int = RUN, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    out, keyed, repeated = linked(docs, run, percent)
    if not repeated:
        null = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
        return out.select(null("key").alias("doc_id"), F.col("n").alias("n_shingles"), null("label").alias("component_id"))
    ids = keyed.select("key", "doc_id").distinct()
    out = out.join(ids.select(F.col("key").alias("label"), F.col("doc_id").alias("component_id")), "label")
    return keyed.select("key", "doc_id").join(out, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, run: int = RUN, percent: int = PERCENT) -> DataFrame:
    """The first document of each component, with all its columns."""
    out, keyed, repeated = linked(docs, run, percent)
    stay = keyed.select("key", "row").join(out.where("key = label").select("key"), "key", "left_semi")
    return (stay.dropDuplicates(["key"]) if repeated else stay).select("row.*")
