"""Source files: one row per file with its whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.cwe import parse_cwe
from codesieve.functions.paths import has_scan_suffix, is_context_file, is_scanned
from codesieve.functions.text import strip
from codesieve.sources import tree


def read_tree(spark: SparkSession, root: str, repo_id: str, max_file_bytes: int | None = None) -> DataFrame:
    """Every file below `root`; undecodable bytes and oversized files are dropped, as unreadable (`tree.scan_tree` shows them)."""
    if tree.reaches(root):
        return _readable(tree.read_listed(tree.list_tree(spark, root, repo_id, skip=[]), root, repo_id, max_file_bytes))
    return _tree(spark, root, repo_id, max_file_bytes)


def _readable(files: DataFrame) -> DataFrame:
    return files.where(F.col("problem").isNull()).select("repo_id", "path", "content")


def relative_path(path: Column, root: str) -> Column:
    """A file's path below `root`."""
    below = F.regexp_replace(path, r"^[a-z]+:/*", "/")
    prefix = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    return F.when(below.startswith(prefix), F.substr(below, F.lit(len(prefix) + 1))).otherwise(below)


def _tree(spark: SparkSession, root: str, repo_id: str, max_file_bytes: int | None, keep=None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_file_bytes:
        files = files.filter(F.col("length") <= max_file_bytes)
    if keep is not None:
        # A test of the file's name alone is answered from the listing: other files are never opened.
        files = files.filter(keep(F.col("_metadata.file_path")))
    return files.select(
        F.lit(repo_id).alias("repo_id"), relative_path(F.col("path"), root).alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content")
    ).filter(F.col("content").isNotNull())


def scan_source_files(spark: SparkSession, root: str, repo_id: str, max_file_bytes: int | None = None) -> DataFrame:
    """The files a scan reads; of stores that only Spark reads, those whose names Spark's reader shows."""
    if tree.reaches(root):
        return _readable(tree.scan_tree(spark, root, repo_id, is_scanned, max_file_bytes))
    return _tree(spark, root, repo_id, max_file_bytes, has_scan_suffix).filter(is_scanned(F.col("path")))


def scan_changed_files(src_files: DataFrame, changed: DataFrame | list[str] | None) -> DataFrame:
    """Only the changed paths that a scan reads; nothing given means all files."""
    if changed is None or (isinstance(changed, list) and not changed):
        return src_files
    if isinstance(changed, list):
        keep = src_files.sparkSession.createDataFrame([(p,) for p in changed], "path string")
    else:
        keep = changed
    keys = [k for k in ("repo_id", "path") if k in keep.columns]
    keep = keep.filter(has_scan_suffix(F.col("path"))).select(*keys).distinct()
    return src_files.join(keep, keys, "left_semi")


def scan_context_files(src_files: DataFrame) -> DataFrame:
    """The files a repository profile reads."""
    return src_files.filter(is_context_file(F.col("path")))


def spread(src_files: DataFrame, parts: int | None = None) -> DataFrame:
    """Give a small input, read as fewer pieces than there are cores, to all cores; larger inputs stay as they are."""
    parts = parts or src_files.sparkSession.sparkContext.defaultParallelism
    return src_files.repartition(parts) if src_files.rdd.getNumPartitions() < parts else src_files


def drop_blank_files(src_files: DataFrame) -> DataFrame:
    return src_files.filter(F.col("content").rlike(r"(?U)\S"))


def explode_lines(src_files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1; trailing empty lines stay."""
    return src_files.select("repo_id", "path", F.posexplode(F.split("content", "\n")).alias("pos", "line")).select(
        "repo_id", "path", (F.col("pos") + 1).alias("line_no"), "line"
    )


def _header(name: str):
    value = strip(F.regexp_extract("content", rf"(?m)^# {name}:[ \t]*(.*)$", 1))
    return F.nullif(value, F.lit(""))


def read_fixture_labels(src_files: DataFrame) -> DataFrame:
    """Labels out of the header comments of sample files; files without such a header give no row."""
    labels = src_files.select(
        "repo_id", F.col("path").alias("file"), _header("VULNERABILITY").alias("vulnerability"), _header("SEVERITY").alias("severity"),
        parse_cwe(_header("CWE")).alias("cwe"), _header("OWASP").alias("owasp"), _header("DESCRIPTION").alias("description"),
        _header("SECURE CODE").alias("secure_code"), _header("PATTERN").alias("pattern"),
    )
    return labels.filter(F.col("vulnerability").isNotNull() | F.col("secure_code").isNotNull()).select(
        "*", F.col("vulnerability").isNotNull().alias("is_vulnerable")
    )
