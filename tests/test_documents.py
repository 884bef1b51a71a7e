"""Documents written in parts by many tasks."""

import json
import os

import pytest

from codesieve.sources import findings, sinks

NORM = "file string, line int, cwe int, severity string, rule_id string"


def test_envelope_document(spark, tmp_path):
    rows = [(f"f{i % 50}.py", i if i % 3 else None, 89, "HIGH", f'r"{i}\n') for i in range(3000)]
    path = str(tmp_path / "run.json")
    df = spark.createDataFrame(rows, NORM).repartition(7)
    assert sinks.write_envelope_document(df, {"tool": "t", "dry_run": True, "timestamp": "now"}, path) == 3000
    doc = json.load(open(path))
    key = lambda r: (r[0], -1 if r[1] is None else r[1], *r[2:])
    assert [tuple(x.values()) for x in doc["findings"]] == sorted(rows, key=key)
    assert (doc["tool"], doc["tool_version"], doc["dry_run"], doc["finding_count"], doc["timestamp"]) == ("t", "unknown", True, 3000, "now")
    assert findings.read_envelopes(spark, path).count() == 3000
    # Written again with less: replaced whole. No rows: an empty list. Nothing is left beside it.
    assert sinks.write_envelope_document(df.limit(1), {}, path) == 1 and len(json.load(open(path))["findings"]) == 1
    assert sinks.write_envelope_document(df.where("false"), {}, f"file://{path}") == 0 and json.load(open(path))["findings"] == []
    assert os.listdir(tmp_path) == ["run.json"]


def test_small_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "COPIED", 7)
    rows = [(f"ä{i}.py", i, None, "LOW", "r") for i in range(40)]
    sinks.write_envelope_document(spark.createDataFrame(rows, NORM).repartition(3), {}, str(tmp_path / "x"))
    assert [f["line"] for f in sorted(json.load(open(tmp_path / "x"))["findings"], key=lambda f: f["line"])] == list(range(40))


def test_findings_document(spark, finding, tmp_path):
    df = finding(*[dict(line=None if i % 2 else i, description='say "x",\nthen [', references=["a", "b"], cvss_score=None if i % 3 else 7.5) for i in range(200)])
    path = str(tmp_path / "findings.json")
    assert sinks.write_findings_document(df, path) == 200
    assert [x["id"] for x in json.load(open(path))] == [f"F{i}" for i in range(200)]
    fields = ["id", "line", "description", "references", "cvss_score", "confidence"]
    want = sorted(map(str, df.select(*fields).collect()))
    assert sorted(map(str, findings.read_findings_lines(spark, path).select(*fields).collect())) == want
    assert sorted(map(str, findings.read_findings_json(spark, path).select(*fields).collect())) == want


def test_other_stores_are_refused(spark, finding):
    with pytest.raises(Exception):
        sinks.write_findings_document(finding(dict()), "viewfs://x/y.json")


def test_parts_are_packed(spark, tmp_path, monkeypatch):
    """The text is written out once: parts beside it are packed, and any line break but its own is text."""
    seen, place = {}, sinks._place_parts

    def watched(folder, target):
        seen.update({f: os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("part-")})
        return place(folder, target)

    monkeypatch.setattr(sinks, "_place_parts", watched)
    rows = [(i, f'"{i:05}\r' + "ä" * 500 + '"') for i in range(3000)]
    path = str(tmp_path / "x")
    assert sinks.write_document(spark.createDataFrame(rows, "i int, value string").repartition(5), ["i"], path) == 3000
    assert open(path, newline="").read() == "[\n" + "\n,".join(v for _, v in rows) + "\n]\n"
    assert all(".gz" in f for f in seen) and sum(seen.values()) < os.path.getsize(path) / 5


def test_shuffles_go_before_the_document_is_written(spark, tmp_path, monkeypatch):
    """When parts are placed, nothing of the sort is left on the disk, and the session's setting is what it was."""
    place, seen = sinks._place_parts, []
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffled():
        return {f"{d}/{f}" for top in dirs for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    def watched(folder, target):
        seen.append(shuffled() - before)
        return place(folder, target)

    monkeypatch.setattr(sinks, "_place_parts", watched)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(3000).selectExpr("id", "concat('\"', sha2(string(id), 256), '\"') as value").repartition(7)
    for kept in (None, "false"):
        spark.conf.unset(name) if kept is None else spark.conf.set(name, kept)
        default, before = spark.conf.get(name), shuffled()
        try:
            assert sinks.write_document(rows, ["id"], str(tmp_path / "x")) == 3000 and len(json.load(open(tmp_path / "x"))) == 3000
            assert sum(map(os.path.getsize, seen.pop())) < 3000 * 32 / 2 and spark.conf.get(name) == default
        finally:
            spark.conf.unset(name)
