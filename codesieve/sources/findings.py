"""Readers of findings, scanner outputs and run envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve import schemas
from codesieve.functions.cwe import parse_cwe, parse_cwe_list
from codesieve.functions.paths import rel_path
from codesieve.operators.evaluate import make_norm_finding

TEXT_DEFAULTS = {"id": "UNKNOWN", "severity": "MEDIUM", "category": "Unknown", "code_snippet": "", "description": "", "impact": "",
                 "remediation": "", "file": "", "confidence": "MEDIUM"}


def read_findings_json(spark: SparkSession, path: str, repo_id: str = "") -> DataFrame:
    """Findings of JSON arrays, with the defaults of missing fields; items that are not objects are skipped."""
    return findings_of_documents(read_documents(spark, path)).withColumn("repo_id", F.lit(repo_id))


def read_envelopes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Normalised findings of run envelopes or bare arrays, each with its file as run id and its provenance.

    Every provenance column stays on each row; a run without findings gives no row (see `envelope_runs`).
    """
    return envelope_findings(read_documents(spark, paths))


def envelope_findings(documents: DataFrame) -> DataFrame:
    """The same of envelopes held as text."""
    docs = _parsed(documents)
    rows = docs.select(*_PROVENANCE, F.explode("findings").alias("f")).select(
        "f.file", F.col("f.line").cast("string").alias("line"), F.col("f.cwe").cast("string").alias("cwe"), "f.severity", "f.rule_id", *_PROVENANCE)
    return make_norm_finding(rows)


def envelope_runs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per envelope, with or without findings."""
    return _parsed(read_documents(spark, paths)).select(*_PROVENANCE, F.size("findings").alias("finding_count"))


_PROVENANCE = ["run_id", "tool", "tool_version", "config", "edition", "target_root", "invocation", "timestamp", "dry_run"]
_LOOSE = "array<struct<file: string, line: string, cwe: string, severity: string, rule_id: string>>"


def _parsed(documents: DataFrame) -> DataFrame:
    text = documents.select("value", F.col("document").alias("run_id"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.ENVELOPE if f.name not in ("findings", "finding_count"))
    envelope = F.from_json("value", f"{fields}, findings {_LOOSE}")
    bare = F.col("value").rlike(r"^\s*\[")
    docs = text.select("run_id", F.when(~bare, envelope).alias("e"), F.when(bare, F.from_json("value", _LOOSE)).alias("items"))
    return docs.select(
        "run_id", *[F.col(f"e.{c}").alias(c) for c in _PROVENANCE[1:]],
        F.coalesce("e.findings", "items", F.array().cast(_LOOSE)).alias("findings"))


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole files as (document, value) rows."""
    return spark.read.format("text").option("wholetext", "true").load(paths).select(F.col("_metadata.file_path").alias("document"), "value")


def findings_of_documents(documents: DataFrame) -> DataFrame:
    """Findings of JSON arrays held as text (columns document and value), with the defaults of missing fields."""
    # Items are first taken as their JSON text, so that one of another kind does not spoil the array.
    items = documents.select("document", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "item")).filter(F.col("item").startswith("{"))
    rows = items.select("document", "pos", F.from_json("item", schemas.FINDING_JSON).alias("f"))
    return _with_defaults(rows, F.col("document"), F.col("pos").cast("bigint"))


def _with_defaults(rows: DataFrame, repo_id: Column, ord_: Column) -> DataFrame:
    values = {c: F.coalesce(F.col(f"f.{c}"), F.lit(d)) for c, d in TEXT_DEFAULTS.items()}
    values["references"] = F.coalesce("f.references", F.array().cast("array<string>"))
    values.update(repo_id=repo_id, origin=F.lit("file"), ord=ord_)
    return rows.select(*[values.get(c, F.col(f"f.{c}")).alias(c) for c in schemas.FINDING_COLUMNS])


def read_findings_lines(spark: SparkSession, path: str, repo_id: str = "") -> DataFrame:
    """Findings of a document with an item a line, as `sinks.write_findings_document` writes it.

    The document is cut at lines and read by many tasks, where `read_findings_json` holds it whole. `ord` is null, as a
    task does not know how many items lie before its own.
    """
    lines = spark.read.text(path).select(F.ltrim(F.col("value"), F.lit(",")).alias("item")).filter(F.col("item").startswith("{") & ~F.col("item").endswith("["))
    return _with_defaults(lines.select(F.from_json("item", schemas.FINDING_JSON).alias("f")), F.lit(repo_id), F.lit(None).cast("bigint"))


def semgrep_findings(documents: DataFrame, root: str | None = None) -> DataFrame:
    """Normalised findings of Semgrep results held as text; their CWE is a text or a list of texts."""
    results = documents.select("document", F.explode(F.from_json("value", schemas.SEMGREP)["results"]).alias("r"))
    cwe = F.col("r.extra.metadata.cwe")
    # A list arrives as its JSON text.
    first = F.when(cwe.startswith("["), parse_cwe_list(F.from_json(cwe, "array<string>"))).otherwise(parse_cwe(cwe))
    return make_norm_finding(results.select(
        rel_path(F.coalesce("r.path", F.lit("")), root).alias("file"), F.col("r.start.line").alias("line"), first.alias("cwe"),
        F.col("r.extra.severity").alias("severity"), F.col("r.check_id").alias("rule_id"), "document"))


def read_semgrep_json(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    return semgrep_findings(read_documents(spark, path), root)


def sarif_findings(documents: DataFrame, root: str | None = None) -> DataFrame:
    """Normalised findings of SARIF logs held as text, one per location; the rule's tags give the CWE.

    A run's rules are looked up inside the run, so nothing is shuffled.
    """
    runs = documents.select("document", F.explode(F.from_json("value", schemas.SARIF)["runs"]).alias("run"))

    # A rule that is listed twice counts as its last listing: sorted by id and falling position, the first of each id stays.
    cwe_of = F.transform("run.tool.driver.rules", lambda r: parse_cwe_list(F.filter(r.properties.tags, lambda t: F.lower(t).contains("cwe"))))
    rules = runs.withColumn("cwes", cwe_of).withColumn("ordered", F.expr(
        "array_sort(filter(transform(run.tool.driver.rules, (r, i) -> named_struct('id', r.id, 'place', -i, 'cwe', cwes[i])), r -> r.id is not null))"))
    known = F.expr("map_from_entries(transform(filter(ordered, (r, i) -> i = 0 or ordered[i - 1].id <> r.id), r -> struct(r.id, r.cwe)))")
    results = rules.select("document", known.alias("known"), F.explode("run.results").alias("res"))
    severity = F.coalesce(F.nullif(F.col("res.properties.severity"), F.lit("")), F.col("res.level"), F.lit("warning"))
    rule_id = F.col("res.ruleId")
    cwe = F.when(rule_id.isNotNull(), F.try_element_at("known", rule_id))
    rows = results.select("document", cwe.alias("cwe"), rule_id.alias("rule_id"), severity.alias("severity"), F.explode("res.locations").alias("loc"))
    return make_norm_finding(rows.select(
        rel_path(F.coalesce("loc.physicalLocation.artifactLocation.uri", F.lit("")), root).alias("file"),
        F.col("loc.physicalLocation.region.startLine").alias("line"), "cwe", "severity", "rule_id", "document"))


def read_sarif(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    return sarif_findings(read_documents(spark, path), root)
