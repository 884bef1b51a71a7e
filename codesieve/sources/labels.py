"""Readers of labelled corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve import schemas
from codesieve.fixed import models as fixed


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GROUND_TRUTH).json(path, multiLine=True)


def audit_categories(rows: DataFrame) -> DataFrame:
    """Rows (test_name, category, real_vulnerability, cwe) as ground truth; a category that is unknown or does not have its CWE fails."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in fixed.CATEGORY_CWE for x in pair]), F.col("category"))
    problem = F.when(known.isNull(), F.concat(F.lit("unknown category "), F.col("category"))).when(
        ~known.eqNullSafe(F.col("cwe")), F.concat(F.lit("CWE mismatch for "), F.col("test_name")))
    cwe = F.when(problem.isNotNull(), F.raise_error(problem).cast("int")).otherwise(F.col("cwe"))
    return rows.select(
        F.col("test_name").alias("id"), F.concat(F.lit(fixed.JAVA_CASE_DIR + "/"), F.col("test_name"), F.lit(".java")).alias("file"), cwe.alias("cwe"),
        (F.lower("real_vulnerability") == "true").alias("is_vulnerable"), F.lit(None).cast("int").alias("line"), "category")


def read_expected_csv(spark: SparkSession, path: str, src_files: DataFrame | None = None) -> DataFrame:
    """Expected results of the labelled Java corpus. With `src_files`, a case without its source fails."""
    rows = spark.read.schema("test_name string, category string, real_vulnerability string, cwe int").csv(
        path, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    truth = audit_categories(rows)
    if src_files is None:
        return truth
    have = src_files.select(F.col("path").alias("_path")).distinct()
    joined = truth.join(have, F.col("file") == F.col("_path"), "left")
    file = F.when(F.col("_path").isNull(), F.raise_error(F.concat(F.lit("missing source of "), F.col("id")))).otherwise(F.col("file"))
    return joined.withColumn("file", file).drop("_path")


def read_labelled_jsonl(spark: SparkSession, path: str, src_files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ground truth, ids whose source is missing) of the labelled Python corpus; an id of another form fails."""
    return split_labelled(spark.read.schema("ID string").json(path), src_files)


def split_labelled(records: DataFrame, src_files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    part = lambda i: F.regexp_extract("ID", fixed.PYTHON_CASE_ID, i)
    directory = F.when(part(1) == "", F.raise_error(F.concat(F.lit("unparseable id "), F.col("ID"))).cast("string")).otherwise(part(1))
    truth = records.select(
        F.col("ID").alias("id"), F.concat_ws("/", F.lit(fixed.PYTHON_CASE_DIR), directory, part(3)).alias("file"), part(2).try_cast("int").alias("cwe"),
        F.lit(True).alias("is_vulnerable"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("category"))
    if src_files is None:
        return truth, truth.limit(0).select("id")
    have = src_files.select(F.col("path").alias("file")).distinct()
    return truth.join(have, "file", "left_semi"), truth.join(have, "file", "left_anti").select("id")
