"""Writers. Every table is written by all tasks at once, and so is a document that must be one JSON value in one file.

Defined cases of documents: no rows give an empty list; null fields are written out; a document that is there already is
replaced whole, at the end; a run that breaks off leaves the old one.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve import schemas
from codesieve.fixed import texts
from codesieve.operators import chains, report
from codesieve.operators.aggregate import finding_statistics
from codesieve.operators.filters import filter_by_severity_strict
from codesieve.session import ship, shuffles_dropped
from codesieve.sources import tree


def write_findings_json(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, null fields written out."""
    findings.select(*schemas.FINDING_FIELDS).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_findings_csv(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; the list of references is written as JSON text."""
    flat = findings.select(*[F.to_json(c).alias(c) if c == "references" else F.col(c) for c in schemas.FINDING_FIELDS])
    flat.write.mode(mode).option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)


COPIED = 8 << 20


def _place_parts(folder: str, target: str):
    """A function for mapInArrow that unpacks written parts at their places in one file, COPIED bytes at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = tree.store_of(folder)
        for b in batches:
            for r in b.to_pylist():
                file = os.open(target, os.O_WRONLY)
                try:
                    with store.open_input_stream(f"{top}/{r['path']}", compression="gzip") as part:
                        part.read(r["skip"])
                        at = r["at"]
                        while data := part.read(COPIED):
                            while data:
                                n = os.pwrite(file, data, at)
                                at, data = at + n, data[n:]
                    os.fsync(file)
                finally:
                    os.close(file)
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]}, schema=pa.schema([("n", pa.int64())]))
    return run


def write_document(items: DataFrame, order: list, path: str, head="[\n", tail: str = "]\n") -> int:
    """One file: `head`, the JSON texts in the column `value` by `order`, one a line with commas between, `tail`; returns their number.

    Tasks write sorted parts as packed text; the unpacked lengths of the parts, one number each, say where every part begins, and
    tasks then unpack the parts there side by side, so that the whole text is written out once. What was shuffled is deleted
    before, so the disk holds the shuffle or the text, not both. A part that is written twice writes the same bytes to the same place, so lost
    executors do no harm, and no task or driver holds more than COPIED bytes. `head` may be a function of the number of items.
    The file must lie in a folder that all executors see and that can be written at any place; for other stores there are
    `write_findings_json` and `write_envelope`.
    """
    spark = items.sparkSession
    store, top = tree.store_of(path)
    if not tree.is_local(store):
        raise ValueError(f"a document cannot be written in parts to {path}: write a table")
    folder, beside = f"{top}.parts-{uuid.uuid4().hex}", f"{top}.{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        items.sort(*order).select(F.concat(F.lit(","), "value").alias("value")).write.option("compression", "gzip").text(f"file://{folder}", lineSep="\n")
    try:
        lines = spark.read.text(f"file://{folder}", lineSep="\n").groupBy(F.col("_metadata.file_name").alias("path"))
        listed = lines.agg(F.sum(F.octet_length("value") + 1).alias("length"), F.count(F.lit(1)).alias("n")).collect()
        n = sum(r.n for r in listed)
        start = (head(n) if callable(head) else head).encode()
        places, at = [], len(start)
        for i, (name, length, _) in enumerate(sorted(map(tuple, listed))):
            skip = int(i == 0)  # the comma before the first item
            places.append((name, skip, at))
            at += length - skip
        with open(beside, "wb") as f:
            f.write(start)
            f.seek(at)
            f.write(tail.encode())
        if places:
            ship(spark)
            spark.createDataFrame(places, "path string, skip long, at long").mapInArrow(_place_parts(folder, beside), "n long").agg(F.sum("n")).collect()
        os.replace(beside, top)
    finally:
        store.delete_dir(folder)
        if os.path.exists(beside):
            os.remove(beside)
    return n


def write_findings_document(findings: DataFrame, path: str) -> int:
    """All findings as one JSON array, in their order."""
    item = F.to_json(F.struct(*schemas.FINDING_FIELDS), {"ignoreNullFields": "false"})
    return write_document(findings.select(item.alias("value"), "repo_id", "ord", "id"), ["ord", "repo_id", "id", "value"], path)


_ENVELOPE_FIELDS = (("tool", "unknown"), ("tool_version", "unknown"), ("config", ""), ("edition", ""), ("target_root", ""), ("invocation", ""))


def write_envelope_document(norm_findings: DataFrame, meta: dict, path: str) -> int:
    """One run as one JSON object, whatever its size; its findings by file, line, CWE, severity and rule."""
    fields = ["file", "line", "cwe", "severity", "rule_id"]
    stamp = meta.get("timestamp") or datetime.now(timezone.utc).isoformat()
    shown = {k: str(meta.get(k, d)) for k, d in _ENVELOPE_FIELDS} | {"timestamp": stamp, "dry_run": bool(meta.get("dry_run"))}
    head = lambda n: json.dumps(shown | {"finding_count": n})[:-1] + ', "findings": [\n'
    item = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return write_document(norm_findings.select(*fields, item.alias("value")), fields, path, head, "]}\n")


def write_envelope(norm_findings: DataFrame, meta: dict, path: str, mode: str = "overwrite") -> None:
    """One run as a table: its findings by file, each with the run's provenance.

    `write_envelope_document` writes the single JSON object, in stores that can be written at any place.
    """
    columns = [F.lit(meta.get(k)).alias(k) for k in ("tool", "tool_version", "config", "edition", "target_root", "invocation")]
    stamp = meta.get("timestamp") or datetime.now(timezone.utc).isoformat()
    norm_findings.select(*columns, F.lit(stamp).alias("timestamp"), F.lit(bool(meta.get("dry_run"))).alias("dry_run"), "file", "line", "cwe",
                         "severity", "rule_id").write.mode(mode).parquet(path)


ENVELOPE_LIMIT = 100_000


def envelope_document(norm_findings: DataFrame, meta: dict) -> DataFrame:
    """One row holding the envelope as JSON; fails above ENVELOPE_LIMIT findings, where `write_envelope_document` is the form to use."""
    item = F.struct("file", "line", "cwe", "severity", "rule_id")
    size = norm_findings.select(F.count(F.lit(1))).scalar()
    bounded = norm_findings.limit(ENVELOPE_LIMIT + 1).agg(F.array_sort(F.collect_list(item)).alias("findings"))
    stamp = meta.get("timestamp") or datetime.now(timezone.utc).isoformat()
    fields = [F.lit(str(meta.get(k, d))).alias(k) for k, d in _ENVELOPE_FIELDS]
    body = F.to_json(F.struct(*fields, F.lit(stamp).alias("timestamp"), F.lit(bool(meta.get("dry_run"))).alias("dry_run"),
                              size.alias("finding_count"), F.col("findings")), {"ignoreNullFields": "false"})
    checked = F.when(size > ENVELOPE_LIMIT, F.raise_error(F.lit("too many findings for one document")).cast("string")).otherwise(body)
    return bounded.select(checked.alias("value"))


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    scores.write.mode(mode).partitionBy("dataset").parquet(path)


def report_metadata(findings: DataFrame, org: dict | None = None) -> DataFrame:
    org = org or {}
    now = F.current_timestamp()
    return findings.sparkSession.range(1).select(
        F.concat(F.lit("PENTEST-"), F.date_format(now, "yyyyMMdd-HHmmss")).alias("report_id"),
        F.date_format(now, "yyyy-MM-dd HH:mm:ss").alias("date"), F.lit(org.get("name", "Organization")).alias("organization"),
        F.lit(org.get("application", "Application")).alias("application"), F.lit(org.get("environment", "Production")).alias("environment"),
        F.lit("codesieve").alias("tester"), F.lit(texts.METHODOLOGY).alias("methodology"))


def report_tables(findings: DataFrame, org: dict | None = None, min_severity: str | None = None) -> dict[str, DataFrame]:
    """Every section of the report as a table."""
    kept = filter_by_severity_strict(findings, min_severity) if min_severity else findings
    return {
        "metadata": report_metadata(kept, org),
        "executive_summary": report.executive_summary(kept, org),
        "findings": kept,
        "statistics": finding_statistics(kept),
        "attack_chain_counts": chains.chain_counts(kept),
        "attack_chains": chains.attack_chains(kept),
        "risk_matrix": report.risk_matrix(kept),
        "category_counts": report.category_counts(kept),
        "remediation_roadmap": report.remediation_roadmap(kept),
        "roadmap_items": report.roadmap_items(kept),
        "remediation_guidance": report.remediation_guidance(kept),
        "cvss_details": report.cvss_appendix(kept),
        "compliance_mapping": report.compliance_counts(kept),
    }


def write_report_tables(findings: DataFrame, out_dir: str, org: dict | None = None, min_severity: str | None = None) -> None:
    for name, table in report_tables(findings, org, min_severity).items():
        table.write.mode("overwrite").parquet(f"{out_dir}/{name}")
