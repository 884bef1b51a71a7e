"""Scan each file once, resume after a crash, and deduplicate a stream of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve import schemas
from codesieve.functions.identity import fingerprint_dedup
from codesieve.functions.paths import is_scanned
from codesieve.functions.severity import severity_rank
from codesieve.operators.aggregate import deduplicate
from codesieve.operators.findings import scan_specialized
from codesieve.sources.files import relative_path

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream_source_files(spark: SparkSession, in_dir: str, repo_id: str = "", max_files: int | None = None) -> DataFrame:
    """New files of a folder as they arrive; `content` is null where a file is not UTF-8.

    Spark's file stream leaves out names that begin with a dot or an underscore; `ledger.scan_pending` reads them too.
    """
    reader = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(in_dir).select(F.lit(repo_id).alias("repo_id"), relative_path(F.col("path"), in_dir).alias("path"),
                                      F.try_validate_utf8(F.col("content").cast("string")).alias("content")).filter(is_scanned(F.col("path")))


def scan_incremental(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, repo_id: str = "", max_files: int | None = None, rules=None):
    """Scan what is new and stop; a second call goes on where the first ended.

    Findings go to `out_dir`/findings; `out_dir`/files lists every file seen,
    with the error of those that cannot be read, which are not tried again.
    A batch that is repeated after a crash overwrites its own folder, so
    nothing is written twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read once for both writes
        try:
            readable = batch.filter(F.col("content").isNotNull())
            scan_specialized(readable, rules).write.mode("overwrite").parquet(f"{out_dir}/findings/batch={number}")
            error = F.when(F.col("content").isNull(), "not UTF-8")
            batch.select("repo_id", "path", error.alias("error")).write.mode("overwrite").parquet(f"{out_dir}/files/batch={number}")
        finally:
            batch.unpersist()

    files = stream_source_files(spark, in_dir, repo_id, max_files)
    query = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_findings(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.FINDINGS)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def dedup_stream(findings: DataFrame) -> DataFrame:
    """First finding of each fingerprint; the state grows with the distinct fingerprints, as findings carry no event time."""
    keyed = findings.withColumn("fingerprint", fingerprint_dedup(*[F.col(c) for c in ("file", "line", "category", "code_snippet")]))
    return keyed.dropDuplicates(["repo_id", "fingerprint"])


def best_stream(findings: DataFrame) -> DataFrame:
    """Most severe finding of each fingerprint so far, for update or complete mode."""
    columns = findings.columns
    keyed = findings.withColumn("fingerprint", fingerprint_dedup(*[F.col(c) for c in ("file", "line", "category", "code_snippet")]))
    best = F.struct(severity_rank(F.col("severity")).alias("rank"), F.col("ord"), F.col("id"))
    return keyed.groupBy("repo_id", "fingerprint").agg(F.min_by(F.struct(*columns), best).alias("row")).select("fingerprint", "row.*")


def merge_batches(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """A stored table of unique findings and a new batch, deduplicated together."""
    return deduplicate(known.unionByName(fresh))
