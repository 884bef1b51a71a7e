"""Attack-vector catalogues run over source lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.identity import finding_id, input_order
from codesieve.functions.text import strip
from codesieve.operators.scan import prepare, rule_column, rule_hits
from codesieve.sources.rules import rule_rows

PHASE = 3
FIELDS = ["rule_id", "vector_id", "vector_name", "category_name", "cwe", "owasp", "severity"]


class _VectorRule:
    """A catalogue row, numbered for this scan."""

    def __init__(self, number: int, row):
        self.rule_no, self.row = number, row
        self.language = row["language"] or "*"
        self.pattern = row["pattern"]

    def __getattr__(self, name):
        return self.row[name]


def numbered_vectors(vector_rules: DataFrame) -> list[_VectorRule]:
    rows = sorted(rule_rows(vector_rules), key=lambda r: (r["rule_no"] or 0, r["rule_id"]))
    return [_VectorRule(n, r) for n, r in enumerate(rows, 1)]


def find_vectors(src_files: DataFrame, vector_rules: DataFrame) -> DataFrame:
    """One row per (line, detection pattern) hit."""
    rules = numbered_vectors(vector_rules)
    files = prepare(src_files, rules).select("repo_id", "path", F.explode_outer(rule_hits(rules)).alias("h"))
    rows = files.filter(F.col("h.line_no").isNotNull())
    rows = rows.select("repo_id", "path", "h.line_no", "h.line", F.explode("h.rule_nos").alias("rule_no"))
    return rows.select("*", *[rule_column(rules, F.col("rule_no"), f).alias(f) for f in FIELDS])


def finding_columns() -> dict[str, Column]:
    """The columns of a finding: category is the vector's name, the rest comes from the catalogue."""
    path, name = F.col("path"), F.col("vector_name")
    return {
        "repo_id": F.col("repo_id"),
        "id": finding_id("VECTOR", path, F.col("line_no")),
        "severity": F.col("severity"),
        "category": name,
        "cwe": F.col("cwe"),
        "owasp": F.col("owasp"),
        "file": path,
        "line": F.col("line_no").cast("int"),
        "code_snippet": strip(F.col("line")),
        "description": F.concat(F.lit("Line matches attack vector "), F.col("vector_id"), F.lit(" ("), name, F.lit(").")),
        "impact": F.coalesce("category_name", F.lit("")),
        "remediation": F.lit(""),
        "references": F.array().cast("array<string>"),
        "cvss_score": F.lit(None).cast("double"),
        "confidence": F.lit("MEDIUM"),
        "origin": F.lit("vector"),
        "ord": input_order(F.col("repo_id"), path, F.lit(PHASE), F.col("line_no"), F.col("rule_no")),
    }


def vector_findings(hits: DataFrame) -> DataFrame:
    """Hits as findings."""
    return hits.select(*[c.alias(name) for name, c in finding_columns().items()])


def scan_vectors(src_files: DataFrame, vector_rules: DataFrame) -> DataFrame:
    return vector_findings(find_vectors(src_files, vector_rules))
