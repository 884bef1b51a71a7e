"""Rule findings and model findings become one list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.fixed.noise import SIMILAR_CATEGORIES
from codesieve.functions.text import has_any


def categories_similar(a: Column, b: Column) -> Column:
    """True if both categories name the same kind of issue."""
    return reduce(lambda x, y: x | y, [has_any(F.lower(a), t) & has_any(F.lower(b), t) for t in SIMILAR_CATEGORIES])


def first_per_key(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key. An aggregate, so copies are dropped before the shuffle."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*df.columns)
    return df.groupBy(*named).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def merge_findings(rule_findings: DataFrame, model_findings: DataFrame) -> DataFrame:
    """All rule findings, and each model finding that says something new about its line."""
    category = F.lower("category")
    fresh = first_per_key(model_findings, [F.col("repo_id"), F.col("file"), F.col("line"), category], ["ord", "id"])
    known = rule_findings.select("repo_id", "file", "line", category.alias("category")).distinct().alias("r")
    m = fresh.alias("m")
    same_place = (
        (F.col("m.repo_id") == F.col("r.repo_id")) & (F.col("m.file") == F.col("r.file")) & F.col("m.line").eqNullSafe(F.col("r.line"))
    )
    same_issue = (F.lower(F.col("m.category")) == F.col("r.category")) | categories_similar(F.col("m.category"), F.col("r.category"))
    return rule_findings.unionByName(m.join(known, same_place & same_issue, "left_anti"))
