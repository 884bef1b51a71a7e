"""Writers and readers together: what was written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codesieve.session import shared_folder
from codesieve.sources import findings, labels, sinks
from suite import views
from suite.oracle_views import FINDINGS, GROUND_TRUTH, NORM_FINDINGS
from suite.registry import register, with_


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _line():
    return F.coalesce(F.col("line").cast("int"), F.lit(-1)).alias("line")


def _shown(df):
    score = F.coalesce(F.col("cvss_score").cast("double"), F.lit(-1.0)).alias("cvss_score")
    return df.select("id", "severity", "category", "cwe", "file", _line(), "code_snippet", "description", score, "confidence")


_SQL = """SELECT id, severity, category, cwe, file, coalesce(line, -1) AS line, code_snippet, description, coalesce(cvss_score, -1.0) AS cvss_score, confidence FROM findings"""


def _document(spark, sf_dir):
    path = _place(spark, "findings")
    sinks.write_findings_document(views.findings(spark, sf_dir), path)
    return findings.read_findings_lines(spark, path)


def _csv(spark, sf_dir):
    path = _place(spark, "findings")
    sinks.write_findings_csv(views.findings(spark, sf_dir), path)
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def _envelope(spark, sf_dir):
    path = _place(spark, "envelope")
    sinks.write_envelope_document(views.norm_findings(spark, sf_dir), {"tool": "t", "timestamp": "now", "dry_run": True}, path)
    return findings.read_envelopes(spark, path)


def _ground_truth(spark, sf_dir):
    path, truth = _place(spark, "truth"), views.ground_truth(spark, sf_dir)
    sinks.write_document(truth.select("id", F.to_json(F.struct(*truth.columns)).alias("value")), ["id", "value"], path)
    return labels.read_ground_truth(spark, path)


register("write_findings_document", lambda s, d: _shown(_document(s, d)), with_([FINDINGS], _SQL))
register("write_findings_csv", lambda s, d: _shown(_csv(s, d)), with_([FINDINGS], _SQL))
register("write_envelope_document", lambda s, d: _envelope(s, d).select("file", _line(), F.coalesce("cwe", F.lit(-1)).alias("cwe"), "rule_id", "tool", "tool_version", "dry_run"),
         with_([NORM_FINDINGS], "SELECT file, coalesce(line, -1) AS line, coalesce(cwe, -1) AS cwe, rule_id, 't' AS tool, 'unknown' AS tool_version, true AS dry_run FROM norm_findings"))
register("read_ground_truth", lambda s, d: _ground_truth(s, d).select("id", "file", F.coalesce("cwe", F.lit(-1)).alias("cwe"), "is_vulnerable", _line(), "category"),
         with_([GROUND_TRUTH], "SELECT id, file, coalesce(cwe, -1) AS cwe, is_vulnerable, coalesce(line, -1) AS line, category FROM ground_truth"))
