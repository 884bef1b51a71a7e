"""Weak hash functions and how they are used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.fixed import texts
from codesieve.fixed import weak_hash as fixed
from codesieve.functions.identity import finding_id, input_order
from codesieve.functions.severity import crypto_confidence, crypto_severity
from codesieve.functions.text import any_of, matches, one_of, strip
from codesieve.operators.scan import context_window, prepare, rule_column, rule_hits
from codesieve.sources.rules import CONFIG, WEAK_HASH, own_rules

PHASE = 0


def find_weak_hash(src_files: DataFrame, rules=None) -> DataFrame:
    """One row per (line, rule) hit, with the lines around it."""
    rules = WEAK_HASH + CONFIG if rules is None else own_rules(rules)
    found = prepare(src_files, rules).withColumn("hits", rule_hits(rules))
    with_context = found.select(
        "repo_id", "path", "language",
        F.explode_outer(F.transform("hits", lambda h: F.struct(
            h.line_no.alias("line_no"), h.line.alias("line"), h.rule_nos.alias("rule_nos"),
            context_window(F.col("lines"), h.line_no).alias("context")))).alias("h"),
    )
    rows = with_context.filter(F.col("h.line_no").isNotNull()).select(
        "repo_id", "path", "language", "h.line_no", "h.line", "h.context", F.explode("h.rule_nos").alias("rule_no"))
    return rows.select(
        "*",
        rule_column(rules, F.col("rule_no"), "rule_id").alias("rule_id"),
        rule_column(rules, F.col("rule_no"), "function_name").alias("function_name"),
        rule_column(rules, F.col("rule_no"), "algorithm_or_library").alias("algorithm"),
    )


def classify_usage(hits: DataFrame, aggressive: bool = True) -> DataFrame:
    """Adds whether a hit is a security use, and which."""
    text = F.lower(F.concat_ws(" ", "line", "context", "path"))
    hits = hits.withColumn("around", text)
    around = F.col("around")
    kinds = reduce(
        lambda out, row: F.when(matches(around, row[1], False), row[0]) if out is None else out.when(matches(around, row[1], False), row[0]),
        fixed.SECURITY_USAGES, None,
    ).otherwise("security_general")
    usage = (
        F.when(matches(around, any_of(fixed.SECURITY_CONTEXT)), kinds)
        .when(matches(around, any_of(fixed.NON_SECURITY_CONTEXT)), "non_security")
        .otherwise("unknown")
    )
    hits = hits.withColumn("usage", usage).drop("around")
    secure = F.when(F.col("usage") == "unknown", F.lit(aggressive)).otherwise(F.col("usage") != "non_security")
    return hits.withColumn("is_security", secure)


def scan_mode(hits: DataFrame, aggressive: bool = True) -> DataFrame:
    """The strict mode keeps security uses only."""
    return hits if aggressive else hits.filter("is_security")


def scan_weak_hash(src_files: DataFrame, rules=None, aggressive: bool = True) -> DataFrame:
    """Classified hits with severity and confidence."""
    hits = scan_mode(classify_usage(find_weak_hash(src_files, rules), aggressive), aggressive)
    secure, usage = F.col("is_security"), F.col("usage")
    return hits.select(
        "*",
        F.lit("weak_hash").alias("pattern_type"),
        strip(F.col("line")).alias("code_snippet"),
        crypto_severity(secure, usage).alias("severity"),
        crypto_confidence(F.col("algorithm"), secure).alias("confidence"),
    )


def finding_columns() -> dict[str, Column]:
    """The columns of a finding, from the columns of a classified hit."""
    usage, path = F.col("usage"), F.col("path")
    return {
        "repo_id": F.col("repo_id"),
        "id": finding_id("CRYPTO", path, F.col("line_no")),
        "severity": F.col("severity"),
        "category": F.lit(texts.HASH_CATEGORY),
        "cwe": F.lit(texts.HASH_CWE),
        "owasp": F.lit(texts.HASH_OWASP),
        "file": path,
        "line": F.col("line_no").cast("int"),
        "code_snippet": F.col("code_snippet"),
        "description": hash_description(F.col("algorithm"), F.col("function_name"), usage),
        "impact": one_of(usage, texts.HASH_IMPACTS, texts.HASH_IMPACTS[""]),
        "remediation": one_of(usage, texts.HASH_REMEDIES, texts.HASH_REMEDIES[""]),
        "references": F.array(*[F.lit(x) for x in texts.HASH_LINKS]),
        "cvss_score": F.lit(None).cast("double"),
        "confidence": F.col("confidence"),
        "origin": F.lit("crypto"),
        "ord": input_order(F.col("repo_id"), path, F.lit(PHASE), F.col("line_no"), F.col("rule_no")),
    }


def hash_findings(hits: DataFrame) -> DataFrame:
    """Hits as findings."""
    return hits.select(*[c.alias(name) for name, c in finding_columns().items()])


def hash_description(algorithm: Column, function_name: Column, usage: Column) -> Column:
    use = one_of(usage, texts.HASH_USES, "operations")
    return F.format_string(texts.HASH_DESCRIPTION, algorithm, function_name, use, algorithm)
