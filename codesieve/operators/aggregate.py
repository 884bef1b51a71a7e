"""Deduplication, statistics, order and priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.fixed import severity as fixed
from codesieve.functions.identity import fingerprint_dedup
from codesieve.functions.severity import cvss_or_default, priority_score, severity_rank
from codesieve.operators.ranking import rank_within


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d for d in dfs if d is not None])


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint_dedup(*[F.col(c) for c in ("file", "line", "category", "code_snippet")]))


def deduplicate(findings: DataFrame) -> DataFrame:
    """One finding per repository and fingerprint: the most severe, the first seen among equals, at the first-seen position.

    An aggregate with a partial step, so a finding that is copied a billion
    times leaves each task once.
    """
    best = [severity_rank(F.col("severity")).alias("_rank"), F.col("ord").alias("_ord"), F.col("id")]
    columns = [c for c in findings.columns if c not in ("repo_id", "ord", "id")]
    # The order and the columns are one struct, and the key is the digest's 16 bytes, as this is what a task sorts and shuffles.
    kept = with_fingerprint(findings).groupBy("repo_id", F.unhex("fingerprint").alias("_key")).agg(
        F.min(F.struct(*best, *columns)).alias("_row"), F.min("ord").alias("ord"))
    return kept.select("repo_id", "_row.*", "ord").select(*findings.columns)


def assign_cvss(findings: DataFrame) -> DataFrame:
    return findings.withColumn("cvss_score", cvss_or_default(F.col("cvss_score"), F.col("severity")))


def severity_order() -> list[Column]:
    return [severity_rank(F.col("severity")), F.coalesce("cvss_score", F.lit(0.0)).desc(), F.col("ord"), F.col("id")]


def sort_by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*severity_order())


def with_priority(findings: DataFrame, context: dict | None = None) -> DataFrame:
    columns = [F.col(c) for c in ("severity", "category", "confidence", "cvss_score")]
    return findings.withColumn("priority", priority_score(*columns, context))


def prioritize(findings: DataFrame, context: dict | None = None) -> DataFrame:
    return with_priority(findings, context).orderBy("priority", "ord", "id").drop("priority")


def finding_statistics(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by severity, category and confidence and the total with the mean score, in one aggregate."""
    by = by or []
    dims = ["severity", "category", "confidence"]
    scored = findings.withColumn("_score", F.when(F.col("cvss_score") != 0, F.col("cvss_score")))
    sets = [by + [d] for d in dims] + [by]
    counted = scored.groupingSets(sets, *by, *dims).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_score").alias("mean_score"), *[F.grouping(d).alias(f"_{d}") for d in dims])
    section = reduce(lambda out, d: F.when(F.col(f"_{d}") == 0, f"by_{d}") if out is None else out.when(F.col(f"_{d}") == 0, f"by_{d}"),
                     dims, None).otherwise("total")
    key = reduce(lambda out, d: F.when(F.col(f"_{d}") == 0, F.col(d)) if out is None else out.when(F.col(f"_{d}") == 0, F.col(d)),
                 dims, None)
    return counted.select(
        *by, section.alias("section"), key.alias("key"), "n",
        F.when(section == "total", F.coalesce("mean_score", F.lit(0.0))).alias("avg_cvss_score"))


def severity_breakdown(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").count().withColumnRenamed("count", "n").orderBy(severity_rank(F.col("severity")), "severity")


def severity_gate(findings: DataFrame, level: str = "CRITICAL") -> DataFrame:
    """Per repository, whether any finding reaches the level."""
    limit = fixed.SEVERITIES.index(level)
    return findings.groupBy("repo_id").agg(F.bool_or(severity_rank(F.col("severity")) <= limit).alias("blocked"))


def _grouped(findings: DataFrame, key: list[str]) -> DataFrame:
    """Findings with the size of their group and their position in it; lists are never built in memory. A null key is in no group."""
    return rank_within(findings.dropna(subset=key), key, "ord", ("id",), "group_position", "group_size")


def group_by_file(findings: DataFrame) -> DataFrame:
    return _grouped(findings, ["repo_id", "file"])


def group_by_category(findings: DataFrame) -> DataFrame:
    return _grouped(findings, ["category"])
