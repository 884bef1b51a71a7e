"""Readers, writers and model responses."""

import json

import pytest

from codesieve.operators import model_io
from codesieve.plans.score import score_engine
from codesieve.sources import files, findings, labels, rules, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def test_source_tree(spark, tmp_path):
    for name in ("a.py", "sub dir/b.js", "node_modules/c.js", "build/d.py", "x.md", "Dockerfile", "deep/e.bin"):
        put(tmp_path / name, "one\ntwo\n")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\x00x")
    got = files.scan_source_files(spark, str(tmp_path), "r")
    assert sorted((r.path, r.content) for r in got.collect()) == [(p, "one\ntwo\n") for p in ("Dockerfile", "a.py", "sub dir/b.js")]
    put(tmp_path / "big.py", "x" * 100)
    assert "big.py" not in {r.path for r in files.scan_source_files(spark, str(tmp_path), "r", max_file_bytes=50).collect()}


def test_fixture_labels(src):
    text = "# VULNERABILITY: Weak Hash\n# SEVERITY: HIGH\n# CWE: CWE-327\n# OWASP: A02:2021 - X\n# DESCRIPTION: Using MD5\ncode"
    rows = {r.file: r for r in files.read_fixture_labels(src(("v.py", text), ("s.py", "# SECURE CODE: Good\n# PATTERN: bcrypt\n"), ("n.py", "x"))).collect()}
    assert rows["v.py"].cwe == 327 and rows["v.py"].is_vulnerable and rows["v.py"].description == "Using MD5"
    assert not rows["s.py"].is_vulnerable and rows["s.py"].pattern == "bcrypt" and "n.py" not in rows


CATALOGUE = {"version": "1", "categories": {"inj": {"name": "Injection", "owasp": "A03", "vectors": [
    {"id": "I-1", "name": "Eval", "cwe": "CWE-95", "severity": "HIGH", "detection_patterns": [r"eval\(", "f\"{.*}\""], "test_payloads": ["x"]}, {"id": "I-2", "name": "None", "cwe": "CWE-1", "severity": "LOW"}]}},
    "custom_vectors": [{"id": "C-1", "name": "Own", "cwe": "CWE-2", "severity": "LOW", "detection_patterns": ["own"]}]}


def test_vector_catalogue(spark, src, tmp_path):
    from codesieve.operators.vectors import find_vectors
    more = spark.createDataFrame([("C-2", "More", "CWE-3", ["more"])], "id string, name string, cwe string, detection_patterns array<string>")
    loaded = rules.load_vector_rules(spark, put(tmp_path / "v.json", CATALOGUE), more)
    assert {r.rule_id for r in loaded.collect()} == {"I-1/1", "I-1/2", "C-1/1", "C-2/1"}
    hits = find_vectors(src(("a.py", 'eval(x)\nf"{y}"\nown more')), loaded)
    assert sorted((r.line_no, r.vector_id, r.severity) for r in hits.collect()) == [(1, "I-1", "HIGH"), (2, "I-1", "HIGH"), (3, "C-1", "LOW"), (3, "C-2", "MEDIUM")]
    assert rules.default_vector_rules(spark).count() == 51
    assert all(r.compiles for r in rules.check_rules(spark, rules.default_vector_rules(spark)).collect())


def test_rule_tables(spark):
    assert [f(spark).count() for f in (rules.load_weak_hash_rules, rules.load_config_rules, rules.load_xpath_rules)] == [53, 6, 42]
    assert {r.list_name: r["count"] for r in rules.load_xpath_word_lists(spark).groupBy("list_name").count().collect()} == {
        "query_literal": 4, "user_input": 20, "concatenation": 17, "safe": 12, "safe_assignment": 7}


def test_noise_files(spark, tmp_path):
    path = put(tmp_path / "fp.txt", "# a comment\n\n  test_  \n: str\n# nosec\n #x\n")
    assert {r.pattern for r in rules.load_fp_filters(spark, path).collect()} == {"test_", ": str", "#x"}
    assert {r.pattern for r in rules.load_fp_filters(spark, path, keep_hash_patterns=True).collect()} == {"test_", ": str", "#x", "# nosec"}
    assert rules.load_fp_filters(spark, str(tmp_path / "absent.txt")).count() == 4 and rules.load_fp_filters(spark).count() == 42


def test_severity_matrix(spark, tmp_path):
    doc = {"severity_levels": {"HIGH": {"cvss_range": [7.0, 8.9], "description": "d", "response_time": "r", "examples": ["e"], "business_impact": "b"}},
           "cvss_metrics": {"scope": {"changed": 1.08}}, "vulnerability_type_severity_mapping": {"rce": {"default": "CRITICAL"}}, "context_modifiers": {"pii": {"multiplier": 1.3, "description": "d"}}}
    dims = rules.load_severity_matrix(spark, put(tmp_path / "m.json", doc))
    assert dims["severity_levels"].first().cvss_max == 8.9 and dims["cvss_metrics"].first().weight == 1.08
    assert dims["type_severity"].first().severity == "CRITICAL" and dims["context_modifiers"].first().multiplier == 1.3


def test_findings_json(spark, tmp_path):
    path = put(tmp_path / "f.json", [{"id": "a", "severity": "LOW", "line": 3, "references": ["u"], "cvss_score": 7.5}, {"file": "x.py"}, "text", 5])
    rows = findings.read_findings_json(spark, path).orderBy("ord").collect()
    assert [(r.id, r.severity, r.category, r.line, r.references, r.confidence) for r in rows] == [("a", "LOW", "Unknown", 3, ["u"], "MEDIUM"), ("UNKNOWN", "MEDIUM", "Unknown", None, [], "MEDIUM")]


def test_envelopes(spark, tmp_path):
    a = put(tmp_path / "a.json", {"tool": "t", "dry_run": True, "findings": [{"file": "x.py", "line": 3, "cwe": "CWE-79", "severity": "high"}, {"file": "y.py", "line": None, "cwe": 89, "severity": ""}]})
    b = put(tmp_path / "b.json", [{"file": "z.py", "line": 1, "cwe": 5, "severity": "LOW", "rule_id": "q"}])
    c = put(tmp_path / "c.json", {"tool": "t", "findings": []})
    rows = {r.file: r for r in findings.read_envelopes(spark, [a, b, c]).collect()}
    assert (rows["x.py"].cwe, rows["x.py"].severity, rows["x.py"].dry_run) == (79, "HIGH", True)
    assert (rows["y.py"].line, rows["y.py"].severity) == (None, "UNKNOWN") and rows["z.py"].rule_id == "q" and rows["z.py"].tool is None
    assert sorted(r.finding_count for r in findings.envelope_runs(spark, [a, b, c]).collect()) == [0, 1, 2]


def test_scanner_outputs(spark, tmp_path):
    semgrep = put(tmp_path / "s.json", {"results": [
        {"path": "/r/a.py", "check_id": "c", "start": {"line": 4}, "extra": {"severity": "error", "metadata": {"cwe": ["CWE-none", "CWE-89: SQL"]}}},
        {"path": "b.py", "extra": {"metadata": {"cwe": "CWE-22"}}}, {"path": "c.py"}]})
    assert sorted((r.file, r.line, r.cwe, r.severity) for r in findings.read_semgrep_json(spark, semgrep, "/r").collect()) == [
        ("a.py", 4, 89, "ERROR"), ("b.py", None, 22, "UNKNOWN"), ("c.py", None, None, "UNKNOWN")]
    loc = lambda uri, line=None: {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line} if line else {}}}
    sarif = put(tmp_path / "s.sarif", {"runs": [{"tool": {"driver": {"rules": [
        {"id": "q", "properties": {"tags": ["security", "external/cwe/cwe-079", "external/cwe/cwe-116"]}}, {"id": "z"}, {"id": "q2", "properties": {"tags": ["cwe-1"]}},
        {"id": "q2", "properties": {"tags": ["cwe-2"]}}]}}, "results": [
            {"ruleId": "q", "locations": [loc("a.js", 3), loc("b.js")]}, {"ruleId": "z", "level": "error", "locations": [loc("c.js", 1)]},
            {"ruleId": "q2", "level": "note", "properties": {"severity": "low"}, "locations": [loc("d.js", 2)]}, {"ruleId": "absent", "locations": [loc("e.js", 2)]}, {"ruleId": "q"}]}]})
    assert sorted((r.file, r.line, r.cwe, r.severity) for r in findings.read_sarif(spark, sarif).collect()) == [
        ("a.js", 3, 79, "WARNING"), ("b.js", None, 79, "WARNING"), ("c.js", 1, None, "ERROR"), ("d.js", 2, 2, "LOW"), ("e.js", 2, None, "WARNING")]


def test_expected_csv(spark, tmp_path):
    ok = put(tmp_path / "e.csv", "# name, category, real, cwe\nT1, sqli, true, 89\nT2,hash,false,328\n\n")
    assert [(r.id, r.cwe, r.is_vulnerable, r.file.split("/")[-1]) for r in labels.read_expected_csv(spark, ok).collect()] == [("T1", 89, True, "T1.java"), ("T2", 328, False, "T2.java")]
    for bad, message in (("T1,sqli,true,88\n", "CWE mismatch"), ("T1,nope,true,89\n", "unknown category")):
        with pytest.raises(Exception, match=message):
            labels.read_expected_csv(spark, put(tmp_path / "bad.csv", bad)).collect()


def test_labelled_jsonl(spark, src, tmp_path):
    path = put(tmp_path / "d.jsonl", '{"ID": "CWE-020_author_1.py"}\n{"ID": "CWE-079_codeql_2.py"}\n')
    have = src(("Testcases_Insecure_Code/CWE-020/author_1.py", "x"))
    truth, missing = labels.read_labelled_jsonl(spark, path, have)
    assert [(r.cwe, r.file) for r in truth.collect()] == [(20, "Testcases_Insecure_Code/CWE-020/author_1.py")] and [r.id for r in missing.collect()] == ["CWE-079_codeql_2.py"]
    with pytest.raises(Exception, match="unparseable id"):
        labels.read_labelled_jsonl(spark, put(tmp_path / "b.jsonl", '{"ID": "nope"}'))[0].collect()


def test_round_trips(spark, src, finding, tmp_path):
    df = finding(dict(references=["a", "b"], description='say "x",\nthen y'), dict(line=None))
    sinks.write_findings_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_findings_csv(df, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, escape='"').orderBy("id").collect()
    assert back[0].references == '["a","b"]' and back[0].description == 'say "x",\nthen y' and len(back[0]) == 14
    norm = spark.createDataFrame([("a.py", 1, 89, "HIGH", "r")], "file string, line int, cwe int, severity string, rule_id string")
    sinks.write_envelope(norm, {"tool": "t", "dry_run": True}, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).first().dry_run is True
    doc = json.loads(sinks.envelope_document(norm, {"tool": "t"}).first().value)
    assert doc["finding_count"] == 1 and doc["findings"][0]["cwe"] == 89
    sinks.write_report_tables(df, str(tmp_path / "r"), {"application": "Shop"}, "LOW")
    assert spark.read.parquet(str(tmp_path / "r/risk_matrix")).count() == 5 and spark.read.parquet(str(tmp_path / "r/findings")).count() == 2
    truth = spark.createDataFrame([("e", "a.py", 328, True, 2)], "id string, file string, cwe int, is_vulnerable boolean, line int")
    scores = score_engine(src(("a.py", "x\nhashlib.md5(p)")), truth)
    sinks.write_scores(scores, str(tmp_path / "s"))
    assert {r.tp for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {1}


def responses(spark, *raws):
    return spark.createDataFrame([("r", f"f{i}.py", raw) for i, raw in enumerate(raws)], "repo_id string, path string, raw string")


def test_array_responses(spark):
    df = responses(spark, 'Here: [{"severity": "LOW", "line": 3, "references": ["u"]},\n {"category": "X"}] done', "nothing", "[broken", "[1, 2", "[]")
    rows = model_io.parse_array_response(df).orderBy("ord").collect()
    assert [(r.file, r.severity, r.category, r.line, r.references, r.confidence) for r in rows] == [("f0.py", "LOW", "Unknown", 3, ["u"], "MEDIUM"), ("f0.py", "MEDIUM", "X", None, [], "MEDIUM")]
    agent = model_io.parse_array_response(responses(spark, '[{"file": "q.py"}]'), "AGENT", True).first()
    assert (agent.id, agent.file) == ("AGENT-0", "q.py")


def test_object_responses(spark):
    fenced = 'Sure\n```json\n{"findings": [{"severity": "HIGH", "cwe": "CWE-89"}]}\n```\nand ```{"findings": [{}]}```'
    df = responses(spark, fenced, '{"findings": [{"line": 1}, {"line": 2}]}', "no json", '{"other": 1}')
    assert sorted((r.file, r.severity, r.line or 0) for r in model_io.parse_object_response(df).collect()) == [("f0.py", "HIGH", 0), ("f1.py", "MEDIUM", 1), ("f1.py", "MEDIUM", 2)]


def test_chat_envelope(spark):
    df = spark.createDataFrame([("a", '{"choices":[{"message":{"content":"hi"}}],"usage":{"total_tokens":150}}'), ("b", '{"choices":[]}'), ("c", "junk")], "request_id string, response string")
    assert [(r.raw, r.total_tokens, r.error is None) for r in model_io.parse_chat_envelope(df).orderBy("request_id").collect()] == [("hi", 150, True), (None, 0, False), (None, 0, False)]
