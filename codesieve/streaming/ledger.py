"""Scan a folder again and again: a ledger says which file was read when, and with what result.

The ledger is a table of (repo_id, path, modified, state, error, run) that only grows; a file's latest row holds. A run
lists the folder without opening files, leaves out by an anti join what the ledger has at the same modification time, scans
the rest, writes the findings under its number and then, last of all, the marks. So a changed file is read again, a mark that
was taken away brings its file alone back, and a run that broke off between the two writes is repeated under the same number.
`findings` returns those of each file's latest finished run.

Only the files a run lacks are opened, in parts by bytes (`sources.tree`); a store that only Spark reads goes through Spark's
own file reader. `repo_id` None takes the repository of a file from the first folder of its path.

Defined cases: a file that cannot be read or is not UTF-8 is marked as failed, with a row, and left alone until its mark is
taken away or it changes; a folder that cannot be read is tried again by each run; a file that was deleted keeps its findings;
a folder without new files writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.paths import has_scan_suffix, is_scanned
from codesieve.operators.findings import scan_specialized
from codesieve.session import cut_lineage
from codesieve.sources import tree
from codesieve.sources.files import relative_path

DONE, FAILED, OPEN = "done", "failed", "open"
LEDGER = "repo_id string, path string, modified timestamp, state string, error string, run long"
#: In a store that only Spark reads, up to so many files are named to its reader, which then opens no others; more are found by a join.
NAMED = 10_000


def latest(ledger: DataFrame) -> DataFrame:
    """The row that holds for each file: that of its last run."""
    row = F.max_by(F.struct("modified", "state", "error"), F.col("run"))
    return ledger.groupBy("repo_id", "path").agg(row.alias("row"), F.max("run").alias("run")).select("repo_id", "path", "row.*", "run")


def pending(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """The listed files (repo_id, path, modified, ...) that have no finished or failed run at this modification time."""
    settled = latest(ledger).where(F.col("state") != OPEN).select("repo_id", "path", "modified")
    return listing.join(settled, ["repo_id", "path", "modified"], "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_ledger(spark: SparkSession, out_dir: str) -> DataFrame:
    if not _exists(spark, f"{out_dir}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("basePath", f"{out_dir}/ledger").parquet(f"{out_dir}/ledger")


def _next_run(ledger: DataFrame) -> int:
    return (ledger.agg(F.max("run")).first()[0] or 0) + 1


def _mark(marks: DataFrame, out_dir: str, run: int) -> None:
    marks.select("repo_id", "path", "modified", "state", "error").write.mode("overwrite").parquet(f"{out_dir}/ledger/run={run}")


def listing(spark: SparkSession, root: str, repo_id: str | None = "") -> DataFrame:
    """(repo_id, path, modified, ...) of the files a scan reads, unopened; where Spark lists, `place` is the whole path."""
    if tree.reaches(root):
        return tree.list_tree(spark, root, repo_id).where(is_scanned(F.col("path")) & F.col("modified").isNotNull())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(has_scan_suffix(F.col("_metadata.file_path")))
    files = files.select(F.lit(repo_id).alias("repo_id"), relative_path(F.col("path"), root).alias("path"), F.col("modificationTime").alias("modified"), F.col("path").alias("place"))
    return files.where(is_scanned(F.col("path")))


def _opened(todo: DataFrame, n: int, root: str, repo_id: str | None) -> DataFrame:
    """(repo_id, path, modified, content, problem) of the listed files."""
    if tree.reaches(root):
        return tree.read_listed(todo, root, repo_id).select("repo_id", "path", "modified", "content", "problem")
    files = todo.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if n <= NAMED:
        files = files.where(F.col("_metadata.file_path").isin([r.place for r in todo.select("place").collect()]))
    texts = files.select(F.col("path").alias("place"), F.try_validate_utf8(F.col("content").cast("string")).alias("content")).join(todo, "place")
    return texts.select("repo_id", "path", "modified", "content", F.when(F.col("content").isNull(), "not UTF-8").alias("problem"))


def scan_pending(spark: SparkSession, root: str, out_dir: str, repo_id: str | None = "", rules=None) -> int:
    """Scan what the ledger of `out_dir` lacks; returns the number of files."""
    ledger = read_ledger(spark, out_dir)
    run, todo = _next_run(ledger), cut_lineage(pending(listing(spark, root, repo_id), ledger))
    n = todo.count()
    if not n:
        return 0
    texts = _opened(todo, n, root, repo_id).persist()
    try:
        found = scan_specialized(texts.where("content is not null").select("repo_id", "path", "content"), rules)
        found.write.mode("overwrite").parquet(f"{out_dir}/findings/run={run}")
        state = F.when(F.col("content").isNull(), FAILED).otherwise(DONE)
        _mark(texts.withColumns({"state": state, "error": F.col("problem")}), out_dir, run)
    finally:
        texts.unpersist()
    return n


def take_marks_away(spark: SparkSession, out_dir: str, files: DataFrame) -> None:
    """The given (repo_id, path) are read again by the next scan, whatever their state."""
    ledger = read_ledger(spark, out_dir)
    rows = latest(ledger).join(files.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    _mark(rows.withColumns({"state": F.lit(OPEN), "error": F.lit(None).cast("string")}), out_dir, _next_run(ledger))


def findings(spark: SparkSession, out_dir: str) -> DataFrame:
    """The findings of each file's latest finished run."""
    runs = read_ledger(spark, out_dir).where(F.col("state") == DONE).groupBy("repo_id", F.col("path").alias("file")).agg(F.max("run").alias("run"))
    found = spark.read.option("basePath", f"{out_dir}/findings").parquet(f"{out_dir}/findings").withColumn("run", F.col("run").cast("long"))
    return found.join(runs, ["repo_id", "file", "run"], "left_semi").drop("run")
