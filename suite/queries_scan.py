"""Scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesieve.functions import paths
from codesieve.operators.vectors import scan_vectors, find_vectors
from codesieve.operators.weak_hash import find_weak_hash, hash_findings, scan_weak_hash
from codesieve.operators.xpath import scan_xpath, scan_xpath_calls, scan_xpath_strings, xpath_findings
from codesieve.operators.findings import scan_specialized
from codesieve.sources import files
from codesieve.sources.rules import default_vector_rules
from suite import idioms, views
from suite import oracle_scan as o
from suite.oracle_views import GROUND_TRUTH, KEY, LANGUAGE, LINES, SRC_FILES
from suite.registry import register, with_

_SUFFIX = r"\.(py|js|jsx|ts|tsx|java|go|rb|php|yml|yaml|json|xml|tf|dockerfile|sql|sh|bash|sol)$"

register(
    "scan_source_files",
    lambda s, d: views.src_files(s, d).filter(paths.is_scanned(F.col("path"))).select("repo_id", "path", F.md5("content").alias("digest")),
    with_([SRC_FILES], rf"""SELECT repo_id, path, md5(content) AS digest FROM src_files
      WHERE (regexp_matches(lower(path), '{_SUFFIX}') OR contains(path, 'Dockerfile') OR contains(path, 'docker-compose'))
        AND NOT regexp_matches(path, '(^|/)(\.git|node_modules|venv|__pycache__|build|dist|\.next|vendor)/')"""),
)
register(
    "scan_changed_files",
    lambda s, d: files.scan_changed_files(
        views.src_files(s, d), views.ground_truth(s, d).select(F.col("file").alias("path"))).select("repo_id", "path"),
    with_([SRC_FILES, GROUND_TRUTH], rf"""SELECT repo_id, path FROM src_files
      WHERE path IN (SELECT file FROM ground_truth) AND (regexp_matches(lower(path), '{_SUFFIX}') OR contains(path, 'Dockerfile'))"""),
)
register(
    "scan_context_files",
    lambda s, d: files.scan_context_files(views.src_files(s, d)).select("repo_id", "path"),
    with_([SRC_FILES], r"SELECT repo_id, path FROM src_files WHERE regexp_matches(path, '\.(py|js|jsx|ts|tsx|java|go|rb|php|yml|yaml|json)$')"),
)
register(
    "detect_language",
    lambda s, d: views.src_files(s, d).select(
        "repo_id", "path", paths.detect_language(F.col("path")).alias("lang"),
        paths.normalize_language(paths.detect_language(F.col("path"))).alias("rule_key"), paths.is_test_file(F.col("path")).cast("int").alias("is_test")),
    with_([SRC_FILES], f"""SELECT repo_id, path, lang, {KEY} AS rule_key,
      CAST(regexp_matches(lower(path), 'test_|_test\\.|/tests/|/test/|spec\\.') AS INTEGER) AS is_test FROM (SELECT *, {LANGUAGE} AS lang FROM src_files)"""),
)
register(
    "explode_lines",
    lambda s, d: files.explode_lines(files.drop_blank_files(views.src_files(s, d))).select("repo_id", "path", "line_no", F.md5("line").alias("digest")),
    with_([SRC_FILES, LINES], "SELECT repo_id, path, line_no, md5(line) AS digest FROM lines"),
)
_HASH_COLUMNS = ["repo_id", "path", "line_no", "function_name", "algorithm", "usage", "severity", "confidence", "code_snippet"]


def _hash(aggressive):
    def run(s, d):
        hits = scan_weak_hash(views.src_files(s, d), aggressive=aggressive)
        return hits.select(*_HASH_COLUMNS, F.col("is_security").cast("int").alias("secure"))
    return run


for _name, _mode in (("scan_weak_hash", True), ("scan_weak_hash_strict", False)):
    register(_name, _hash(_mode), with_(o.hash_ctes(_mode), f"SELECT {', '.join(_HASH_COLUMNS)}, CAST(is_security AS INTEGER) AS secure FROM hash_scan"))

register(
    "context_window",
    lambda s, d: find_weak_hash(views.src_files(s, d)).select("repo_id", "path", "line_no", "rule_no", F.md5("context").alias("digest")),
    with_(o.hash_ctes(), "SELECT repo_id, path, line_no, rule_no, md5(context) AS digest FROM hash_hits"),
)
_FINDING = ["repo_id", "id", "severity", "category", "cwe", "owasp", "file", "line", "code_snippet", "description", "impact", "remediation", "confidence",
            "origin", "ord"]
register("hash_findings", lambda s, d: hash_findings(scan_weak_hash(views.src_files(s, d))).select(*_FINDING),
         with_(o.hash_findings_ctes(), f"SELECT {', '.join(_FINDING)} FROM hash_findings"))

_XPATH = ["repo_id", "path", "line_no", "rule_no", "function_name", "code_snippet", "user_source", "pattern_type", "severity", "confidence"]
for _name, _fn, _phase in (("scan_xpath_calls", scan_xpath_calls, 1), ("scan_xpath_strings", scan_xpath_strings, 2)):
    register(_name, (lambda fn: lambda s, d: fn(views.src_files(s, d)).select(*_XPATH))(_fn),
             with_(o.xpath_ctes(), f"SELECT {', '.join(_XPATH)} FROM xpath_scan WHERE phase = {_phase}"))
register(
    "safe_reassignment",
    lambda s, d: scan_xpath(views.src_files(s, d), suppress=False).select(
        "repo_id", "path", "phase", "line_no", "rule_no", F.coalesce("variable", F.lit("")).alias("variable"),
        F.coalesce("last_assignment", F.lit("")).alias("last_assignment")),
    with_(o.xpath_ctes(False), "SELECT repo_id, path, phase, line_no, rule_no, coalesce(var, '') AS variable, coalesce(last_assignment, '') AS last_assignment FROM xpath_scan"),
)
register("xpath_findings", lambda s, d: xpath_findings(scan_xpath(views.src_files(s, d))).select(*_FINDING),
         with_(o.xpath_findings_ctes(), f"SELECT {', '.join(_FINDING)} FROM xpath_findings"))
register("scan_specialized", lambda s, d: scan_specialized(views.src_files(s, d)).select("repo_id", "id", "severity", "file", "line", "origin", "ord"),
         with_(o.hash_findings_ctes() + o.xpath_findings_ctes(), """SELECT repo_id, id, severity, file, line, origin, ord FROM hash_findings
           UNION ALL SELECT repo_id, id, severity, file, line, origin, ord FROM xpath_findings"""))
_VECTOR = "repo_id, path, line_no, rule_no, vector_id, category_name, cwe, coalesce(owasp, '') AS owasp, severity"


def _vector_hits(hits):
    return hits.select("repo_id", "path", "line_no", "rule_no", "vector_id", "category_name", "cwe", F.coalesce("owasp", F.lit("")).alias("owasp"), "severity")


register("scan_vectors", lambda s, d: _vector_hits(find_vectors(views.src_files(s, d), default_vector_rules(s))),
         with_(o.vector_ctes(o.default_vectors(), [SRC_FILES, LINES]), f"SELECT {_VECTOR} FROM vector_scan"))
register("scan_vectors_html", lambda s, d: _vector_hits(find_vectors(views.html_files(s, d), views.html_rules(s))),
         with_(o.vector_ctes([(r[0], r[1], "Html", r[2], None, r[3], r[4]) for r in idioms.HTML_RULES], o.HTML_BASE), f"SELECT {_VECTOR} FROM vector_scan"))
register("vector_findings", lambda s, d: scan_vectors(views.src_files(s, d), default_vector_rules(s)).select(
            "repo_id", "id", "category", "severity", "file", "line", "code_snippet", "description", "ord"),
         with_(o.vector_ctes(o.default_vectors(), [SRC_FILES, LINES]), f"""SELECT repo_id, {o.finding_id('VECTOR', 'path', 'line_no')} AS id, vector_name AS category,
           severity, path AS file, line_no AS line, code_snippet, 'Line matches attack vector ' || vector_id || ' (' || vector_name || ').' AS description,
           {o.input_order('path', '3', 'line_no', 'rule_no')} AS ord FROM vector_scan"""))
