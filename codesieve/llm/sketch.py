"""Document fingerprints: a threshold-scaled sketch of five-word shingles. Built-in functions only.

Every shingle hash in the lowest 1/SCALE of the hash range is kept, so sketches of any two texts, or of a union of texts,
can be compared and merged whatever their lengths. Where that leaves fewer than LEAST hashes, the LEAST lowest are kept
(all, if there are no more). A sketch knows up to which bound it is complete; two sketches are compared below the lower
of their bounds, where both hold every hash.

Defined cases: null text is empty; a text of one to four words is one shingle; a text without words has an empty sketch;
two empty sketches are alike (1), an empty and another are not (0). Documents follow each other by (doc_id, hash of the
text), null ids first; rows equal in both count as one document, and each gets that document's row. A single document is
followed by itself. No rows give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.base import words
from codesieve.llm.order import ranked

SHINGLE, SCALE, LEAST = 5, 16, 48
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1
_CUT = _LOWEST + (1 << 64) // SCALE


def _with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with a struct column `name`: kept hashes in ascending order, and the bound below which they are complete."""
    rest = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(*rest, words(F.col(text)).alias("_words"))
    n = F.size("_words")
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.col("_words")[i + j] for j in range(SHINGLE))))
    hashes = F.when(n >= SHINGLE, F.array_distinct(runs)).when(n > 0, F.array(F.xxhash64("_words", F.lit(0)))).otherwise(F.array().cast("array<long>"))
    df = df.select(*rest, hashes.alias("_hashes"))
    df = df.select(*rest, "_hashes", F.filter("_hashes", lambda h: h < F.lit(_CUT)).alias("_low"))
    enough = F.size("_low") >= LEAST
    df = df.select(*rest, F.size("_hashes").alias("_n"), enough.alias("_enough"), F.when(enough, F.sort_array("_low")).otherwise(F.slice(F.sort_array("_hashes"), 1, LEAST)).alias("_kept"))
    bound = F.when(F.col("_n") == F.size("_kept"), F.lit(_HIGHEST)).when(F.col("_enough"), F.lit(_CUT)).otherwise(F.element_at("_kept", -1) + 1)
    return df.select(*rest, F.struct(F.col("_kept").alias("kept"), bound.alias("bound")).alias(name))


def printed(sketch: str) -> Column:
    """A sketch as text: its bound and its hashes, in hexadecimal."""
    return F.concat(F.lower(F.hex(F.col(f"{sketch}.bound"))), F.lit(":"), F.array_join(F.transform(f"{sketch}.kept", lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard likeness of two sketches."""
    bound = F.least(F.col(f"{a}.bound"), F.col(f"{b}.bound"))
    x, y = (F.filter(f"{s}.kept", lambda h: (h < bound) | (bound == _HIGHEST)) for s in (a, b))
    both, all_of = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(all_of > 0, both / all_of).otherwise(F.when(F.size(f"{a}.kept") + F.size(f"{b}.kept") == 0, 1.0).otherwise(0.0))


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has, also for texts of very unequal lengths."""
    bound = F.least(F.col(f"{a}.bound"), F.col(f"{b}.bound"))
    x = F.filter(f"{a}.kept", lambda h: (h < bound) | (bound == _HIGHEST))
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, F.col(f"{b}.kept"))) / F.size(x))


def merge(groups: DataFrame, by: list[str], sketch: str) -> DataFrame:
    """Sketches of unions: one row for each group, complete below the lowest bound of its members."""
    bounds = groups.groupBy(*by).agg(F.min(f"{sketch}.bound").alias("bound"))
    hashes = groups.select(*by, F.explode(f"{sketch}.kept").alias("h")).distinct()
    kept = hashes.join(bounds, by).where((F.col("h") < F.col("bound")) | (F.col("bound") == _HIGHEST)).groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias("kept"))
    return bounds.join(kept, by, "left").select(*by, F.struct(F.coalesce("kept", F.array().cast("array<long>")).alias("kept"), "bound").alias(sketch))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, sketch) of each document."""
    return _with_sketch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "text", "sketch").select("doc_id", "sketch")


def edited(docs: DataFrame, part: int = 4) -> DataFrame:
    """Fingerprints of each text, of the same text with its last 1/part replaced by the start of the next, and of the next.

    The order of documents is found on ids alone. A text is moved once, to meet the start of the next text and its sketch.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("key")
    base = docs.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    full = _with_sketch(base, "text", "own")
    ids = ranked(base.select("key", "mark", F.length("text").alias("n")).distinct(), "key", "mark")
    total = max(1, ids.count())
    before = ids.select(((F.col("rank") + 1) % total).alias("rank"), F.col("key").alias("to_key"), F.col("mark").alias("to_mark"), F.floor(F.col("n") / part).cast("int").alias("many"))
    links = ids.select("rank", "key", "mark").join(before, "rank").select("key", "mark", "to_key", "to_mark", "many")
    heads = full.join(links, ["key", "mark"]).select(F.col("to_key").alias("key"), F.col("to_mark").alias("mark"), F.substring("text", F.lit(1), F.col("many")).alias("head"), F.col("own").alias("next"))
    heads = heads.dropDuplicates(["key", "mark"])
    n, many = F.length("text"), F.floor(F.length("text") / part).cast("int")
    df = full.join(heads, ["key", "mark"]).select(
        F.when(F.col("key") != _LOWEST, F.col("key")).alias("doc_id"), n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - many), F.col("head")).alias("changed"), "own", "next")
    df = _with_sketch(df, "changed", "edit")
    return df.select("doc_id", "n_chars", F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"), "own", "edit", "next")
