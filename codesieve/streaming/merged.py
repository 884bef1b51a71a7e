"""Unique findings of a stream, the most severe of each fingerprint, kept in a table of parts.

A stream that keeps the best finding of every fingerprint in its state grows without end. Here the stream has no state: each batch
is added to the table as a part, as it comes and without a shuffle. When FAN - 1 parts of one level have gathered, the next batch
is merged with them into one part of the level above, which holds each finding once; so a finding is written once for each level,
whose number is the logarithm of the number of batches, and not once for each batch. Readers merge the few valid parts, and only
the columns they ask for are shuffled.

A commit, written last, lists the valid parts. A batch that is repeated after a crash overwrites its own part, and a part is
deleted when neither the last commit nor the one before lists it. A stored finding keeps its own place beside the first one seen,
so that merging parts gives what `deduplicate` gives over all batches, in any order.

`keep`: fingerprints that were not seen for so many batches leave the table when a batch has a finding of their bucket; each
batch is then merged with the whole table.

Defined cases: a batch without findings commits nothing; equal findings in one or many batches count once; null files, lines,
categories and snippets print as nothing, as in `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve import schemas
from codesieve.functions.severity import severity_rank
from codesieve.operators.aggregate import with_fingerprint

#: Buckets of fingerprints, which `keep` looks at; parts of a level.
BUCKETS, FAN = 64, 8
_COMMIT = "part long, level int"
_OWN, _KEY = ("ord", "id"), ("repo_id", "_key")


def _added(findings: DataFrame, number: int) -> DataFrame:
    """A batch as a part: its findings, their own place as the first, and the batch they were last seen in."""
    return findings.select(*schemas.FINDING_COLUMNS, F.col("ord").alias("first"), F.lit(number).cast("long").alias("seen"))


def _unique(part: DataFrame, columns: Sequence[str] = schemas.FINDING_COLUMNS) -> DataFrame:
    """The best finding of each fingerprint, the first position and the last batch it was seen in; an aggregate with a partial step.

    The order and the columns are one struct, and the key is the digest's 16 bytes, as this is what a task sorts and shuffles.
    """
    others = [c for c in columns if c not in ("repo_id", *_OWN)]
    best = F.struct(severity_rank(F.col("severity")).alias("_rank"), *_OWN, *others)
    found = with_fingerprint(part).withColumn("_key", F.unhex("fingerprint")).groupBy(*_KEY).agg(F.min(best).alias("_row"), F.min("first").alias("first"), F.max("seen").alias("seen"))
    return found.select(*(F.col(c) if c == "repo_id" else F.col(f"_row.{c}") for c in columns), "first", "seen")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("repo_id", "fingerprint"), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that have a folder."""
    path, fs = _path(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(x.removeprefix("version=")) for x in names if x.startswith("version="))


def _valid(spark: SparkSession, table: str, upto: int | None = None) -> dict[int, int]:
    """The valid parts and their levels, by the last commit (before `upto`); FAN for each level, so few."""
    place = f"{table}/commits"
    for version in reversed(_versions(spark, place)):
        if upto is None or version < upto:
            # A commit that broke off has no rows yet, and the one before it holds.
            rows = spark.read.schema(_COMMIT).parquet(f"{place}/version={version}").collect()
            if any(r.part is None for r in rows):
                raise ValueError(f"{table} has the layout of an earlier release")
            if rows:
                return {r.part: r.level for r in sorted(rows)}
    return {}


def _stored(spark: SparkSession, table: str, parts: Sequence[int], like: DataFrame) -> DataFrame:
    """The rows of some parts, read from their folders alone."""
    if not parts:
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(*[f"{table}/rows/version={v}" for v in sorted(parts)])


def _gathered(valid: dict[int, int]) -> tuple[list[int], int]:
    """The parts that the next batch is merged with, and the level of what comes out."""
    level, taken = 0, []
    while len(full := [v for v, x in valid.items() if x == level]) >= FAN - 1:
        taken += full
        level += 1
    return taken, level


def merge_batch(batch: DataFrame, number: int, table: str, buckets: int = BUCKETS, keep: int | None = None) -> None:
    """Merge one batch of findings into the table."""
    spark = batch.sparkSession
    added = _added(batch, number)
    if added.isEmpty():
        return
    valid = _valid(spark, table, number)
    taken, level = (list(valid), 0) if keep else _gathered(valid)
    merged = added
    if taken or keep:
        merged = _unique(added.unionByName(_stored(spark, table, taken, added)))
    if keep:
        touched = [r.bucket for r in with_fingerprint(added).select(_bucket(buckets).alias("bucket")).distinct().collect()]
        merged = with_fingerprint(merged).where((F.col("seen") > number - keep) | ~_bucket(buckets).isin(touched)).drop("fingerprint")
    merged.write.mode("overwrite").parquet(f"{table}/rows/version={number}")
    parts = {**{v: x for v, x in valid.items() if v not in taken}, number: level}
    spark.createDataFrame(list(parts.items()), _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{table}/commits/version={number}")
    _clean(spark, table, number, {*parts, *valid})


def _clean(spark: SparkSession, table: str, number: int, listed: set[int]) -> None:
    """Delete the parts that neither this commit nor the one before lists, and the commits before them."""
    commits = [v for v in _versions(spark, f"{table}/commits") if v < number]
    gone = [f"{table}/commits/version={v}" for v in commits[:-1]] + [f"{table}/rows/version={v}" for v in _versions(spark, f"{table}/rows") if v < number and v not in listed]
    for place in gone:
        path, fs = _path(spark, place)
        fs.delete(path, True)


def merge_stream(findings: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS, keep: int | None = None) -> None:
    """Merge what a stream of findings has and stop; a second call goes on where the first ended."""
    # Batches are numbered from 1, so that no version is before the first.
    write = lambda batch, number: merge_batch(batch, number + 1, table, buckets, keep)
    findings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged_findings(spark: SparkSession, table: str, columns: Sequence[str] = schemas.FINDING_COLUMNS) -> DataFrame:
    """The unique findings so far, each at its first-seen position; `columns`: those of a finding that are wanted."""
    rows = _stored(spark, table, _valid(spark, table), _added(spark.createDataFrame([], schemas.FINDINGS), 0))
    return _unique(rows, columns).select(*(F.col("first").alias("ord") if c == "ord" else F.col(c) for c in columns))
