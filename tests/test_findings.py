"""Filters, deduplication, order, chains and reports on literal findings."""

import hashlib

import pytest
from pyspark.sql import functions as F

from codesieve.operators import aggregate, chains, filters, merge, ranking, report
from codesieve.operators.profile import security_rules
from codesieve.plans.analyze import aggregate_findings, analyze


def ids(df):
    return [r.id for r in df.collect()]


def test_deduplicate_keeps_the_most_severe_at_the_first_place(finding):
    same = dict(file="a.py", line=3, category="XSS", code_snippet="s" * 200)
    df = finding({**same, "severity": "MEDIUM"}, dict(file="b.py"), {**same, "severity": "CRITICAL"}, {**same, "severity": "CRITICAL"}, {**same, "code_snippet": "s" * 149 + "t" * 51, "severity": "INFO"})
    got = aggregate.deduplicate(df).orderBy("ord").collect()
    # A snippet that differs from character 150 on is another finding.
    assert [(r.id, r.ord) for r in got] == [("F2", 0), ("F1", 1), ("F4", 4)]


def test_missing_line_and_line_zero_are_one_fingerprint_but_repositories_stay_apart(finding):
    df = finding(dict(line=None), dict(line=0), dict(line=None, repo_id="other"))
    assert aggregate.deduplicate(df).count() == 2
    fp = aggregate.with_fingerprint(df).first().fingerprint
    assert fp == hashlib.md5(b"api.py::SQL Injection:x").hexdigest()


def test_statistics(finding):
    df = finding(dict(severity="CRITICAL", cvss_score=9.0, category="XSS"), dict(cvss_score=7.5, category="XSS"), dict(cvss_score=7.0), dict(cvss_score=0.0, confidence="LOW"))
    got = {(r.section, r.key): (r.n, r.avg_cvss_score) for r in aggregate.finding_statistics(df).collect()}
    assert got[("total", None)] == (4, pytest.approx(23.5 / 3)) and got[("by_severity", "HIGH")][0] == 3 and got[("by_category", "XSS")][0] == 2
    assert got[("by_confidence", "LOW")][0] == 1
    assert {r.section: r.avg_cvss_score for r in aggregate.finding_statistics(df.limit(0)).collect()} in ({"total": 0.0}, {})


def test_cvss_and_order(finding):
    df = aggregate.assign_cvss(finding(dict(severity="LOW", cvss_score=3.0), dict(severity="CRITICAL"), dict(severity="MEDIUM", cvss_score=0.0), dict(severity="ODD"), dict(severity="LOW", cvss_score=3.5)))
    assert [(r.id, r.cvss_score) for r in aggregate.sort_by_severity(df).collect()] == [("F1", 9.5), ("F2", 5.0), ("F4", 3.5), ("F0", 3.0), ("F3", 5.0)]


def test_priority(finding):
    df = finding(dict(severity="MEDIUM", category="Other", confidence="LOW", cvss_score=5.0), dict(severity="HIGH", category="injection"), dict(severity="HIGH", category="Other"))
    assert ids(aggregate.prioritize(df)) == ["F1", "F2", "F0"]
    assert [r.priority for r in aggregate.with_priority(df, {"environment": "production", "contains_pii": True}).orderBy("ord").collect()] == [20.0, -150.0, -100.0]


def test_severity_filters(finding):
    df = finding(dict(severity="INFO"), dict(severity="MEDIUM"), dict(severity="HIGH"), dict(severity="ODD"))
    assert ids(filters.filter_by_severity(df)) == ["F1", "F2"]
    with pytest.raises(ValueError):
        filters.filter_by_severity(df, "BAD")
    with pytest.raises(Exception, match="unknown severity ODD"):
        filters.filter_by_severity_strict(df, "LOW").collect()
    assert ids(filters.filter_by_severity_strict(df.filter("severity <> 'ODD'"), "MEDIUM")) == ["F1", "F2"]


REASONS = [
    ("client_sdk", dict(category="Broken Access Control", description="missing check"), "sdk_missing_auth"),
    ("web_app", dict(category="Broken Access Control", description="missing check"), None),
    ("client_sdk", dict(category="Sensitive Data Exposure", description="api endpoint without auth"), "sdk_endpoint_exposure"),
    ("client_sdk", dict(category="Insecure Deserialization", code_snippet="json.loads(x)"), "benign_deserialisation"),
    ("client_sdk", dict(category="Insecure Deserialization", code_snippet="pickle.loads(x)"), None),
    ("web_app", dict(category="Authentication", code_snippet="if not user.authenticated: raise X"), "is_auth_check"),
    ("client_sdk", dict(category="Data Exposure", code_snippet="load(pem)"), "pem_loading"),
    ("web_app", dict(category="Insufficient Logging"), "logging"),
    ("web_app", dict(description="There is no logging"), "logging"),
    ("client_sdk", dict(category="Misconfiguration", description="public"), "sdk_public_endpoint"),
    ("web_app", dict(file="mock_server.py", code_snippet="def handler()"), "mock_server"),
    ("web_app", dict(category="Sensitive Data", code_snippet="key optional (str)"), "docstring_param"),
    ("web_app", dict(category="Sensitive Data", code_snippet="**x** param"), "docstring_param"),
    ("web_app", dict(category="Sensitive Data", code_snippet="- **api_key** the key"), "docstring_key"),
    ("web_app", dict(category="Deserialization", code_snippet="super().__init__(**response)"), "super_init"),
    ("web_app", dict(category="Deserialization", code_snippet="f(**kwargs)"), "kwargs"),
    ("web_app", dict(category="Deserialization", code_snippet="f(**kwargs); setattr(a, b)"), None),
    ("web_app", dict(category="Session", code_snippet="sid = uuid4()"), "uuid_session"),
    ("web_app", dict(category="Session", code_snippet="sid = uuid4() # predictable"), None),
    ("web_app", dict(category="Authentication", file="test_a.py", code_snippet="subscribe()"), "auth_test"),
    ("web_app", dict(file=".github/ci.yml", code_snippet="${{ secrets.KEY }}"), "ci_secret_reference"),
    ("client_sdk", dict(category="API", description="no rate limit"), "sdk_rate_limit"),
    ("web_app", dict(file="test_a.py", severity="LOW"), "test_low_severity"),
    ("web_app", dict(file="test_a.py", description="Hardcoded key"), "test_fixture"),
    (None, dict(file="test_a.py", description="Hardcoded key"), None),
    ("web_app", dict(confidence="LOW"), "low_confidence"),
    ("web_app", dict(code_snippet="url = 'http://x'"), "noise_pattern"),
    ("web_app", dict(code_snippet="def f(a: str)"), "noise_pattern"),
    ("web_app", dict(file="Django/a.py", code_snippet="X.objects.raw(q)"), "framework"),
    ("web_app", dict(category="XSS", code_snippet="flask render_template_string(q)"), "framework"),
    ("web_app", dict(), None),
]


def test_drop_reasons(spark, finding):
    df = finding(*[dict(c, repo_id=f"{i:02d}") for i, (_, c, _) in enumerate(REASONS)])
    kinds = spark.createDataFrame([(f"{i:02d}", k) for i, (k, _, _) in enumerate(REASONS) if k], "repo_id string, kind string")
    profile = kinds.select("repo_id", *security_rules(F.col("kind")))
    got = [r.drop_reason for r in filters.fp_cascade(df, None, profile, explain=True).orderBy("repo_id").collect()]
    assert got == [r for _, _, r in REASONS]
    assert filters.fp_cascade(df, None, profile).count() == sum(r is None for _, _, r in REASONS)


def test_merge(finding):
    rule = finding(dict(line=1, category="Weak Cryptographic Hash"), dict(line=None, category="XPath Injection"))
    model = finding(dict(line=1, category="weak crypto use"), dict(line=2, category="weak crypto use"), dict(line=1, category="XSS"), dict(line=1, category="xss"),
                    dict(line=None, category="xpath injection"), dict(line=None, category="XML query"), dict(line=1, category="XSS", file="b.py")).withColumn("origin", F.lit("model"))
    got = sorted((r.file, r.line or 0, r.category) for r in merge.merge_findings(rule, model).filter("origin = 'model'").collect())
    assert got == [("api.py", 1, "XSS"), ("api.py", 2, "weak crypto use"), ("b.py", 1, "XSS")]


def brute_chains(rows):
    out = []
    low = lambda r, k: r[k].lower()
    left = [r for r in rows if "auth" in low(r, "category") and r["severity"] in ("CRITICAL", "HIGH")]
    right = [r for r in rows if any(w in low(r, "category") for w in ("idor", "data_exposure", "access_control"))]
    out += [(1, a["id"], b["id"]) for a in left for b in right]
    out += [(2, a["id"], b["id"]) for a in rows if "xss" in low(a, "category") for b in rows if "session" in low(b, "description") or "cookie" in low(b, "description")]
    out += [(3, r["id"], None) for r in rows if "sql" in low(r, "category") and "injection" in low(r, "category") and ("admin" in low(r, "file") or "auth" in low(r, "file"))]
    out += [(4, r["id"], None) for r in rows if "ssrf" in low(r, "category")]
    return [(f"CHAIN-{i:03d}", *c) for i, c in enumerate(out, 1)]


def test_chains_equal_brute_force(finding, monkeypatch):
    import random
    monkeypatch.setattr(chains, "BLOCK", 3)
    rng = random.Random(3)
    rows = [dict(id=f"F{i}", ord=i, severity=rng.choice(["CRITICAL", "HIGH", "LOW"]), category=rng.choice(["authentication", "auth_idor", "XSS", "SQL Injection", "ssrf", "access_control"]),
                 description=rng.choice(["session", "Cookie", ""]), file=rng.choice(["admin/a.py", "b.py"])) for i in range(40)]
    df = finding(*rows)
    got = [(r.id, r.pattern, r.left_id, r.right_id) for r in chains.attack_chains(df).orderBy("chain_no").collect()]
    want = brute_chains(rows)
    assert got == want and len(want) > 50
    assert [r.id for r in chains.attack_chains(df, first=5).orderBy("chain_no").collect()] == [w[0] for w in want[:5]]
    assert chains.chain_counts(df).agg(F.sum("n_chains")).first()[0] == len(want)


def test_chain_text(finding):
    df = finding(dict(severity="CRITICAL", category="authentication_bypass", description="d" * 60), dict(category="idor_data_exposure", description="short"))
    chain = chains.attack_chains(df).first()
    assert chain.severity == "CRITICAL" and chain.steps == ["F0", "F1"]
    assert chain.description == f"Attacker bypasses authentication ({'d' * 60}...) then accesses sensitive data (short...)"


def test_small_scopes_are_ranked_by_one_shuffle(spark):
    """Scopes are cut when they are large alone; positions and sizes are those of a window, null scopes and numbers too."""
    df = spark.range(3_000).selectExpr("nullif(if(id < 2500, 7, id % 40), 3) as g", "nullif(id * 7919 % 1000, 5) as o", "id")
    for whole in (100, 2_499, 100_000):
        got = ranking.rank_within(df, ["g"], "o", ("id",), size="n", whole=whole).selectExpr(
            "*", "row_number() over (partition by g order by o, id) as want", "count(*) over (partition by g) as rows")
        assert got.columns == ["g", "o", "id", "n", "position", "want", "rows"]
        assert got.filter("position <> want or n <> rows").count() == 0 and got.count() == 3_000


def test_deduplicate_carries_each_column_once(spark, finding):
    """What is sorted and shuffled holds an id once and the digest as bytes; the most severe wins, then the first, at the first position."""
    df = finding(dict(severity="LOW"), dict(severity="CRITICAL", impact="second"), dict(severity="CRITICAL", impact="third"), dict(line=2, references=["a"]), dict(repo_id=None))
    got = aggregate.deduplicate(df)
    first = min(r.ord for r in df.collect())
    assert got.columns == df.columns and got.count() == 3
    assert [(r.ord, r.impact) for r in got.where("severity = 'CRITICAL' and repo_id is not null").collect()] == [(first, "second")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and "unhex" in plan


def test_rank_within_equals_row_number(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5003).alias("o"))
    got = ranking.rank_within(df, ["g"], "o").withColumn("want", F.expr("row_number() over (partition by g order by o)"))
    assert got.filter("position <> want").count() == 0 and got.count() == 5000


def test_rank_parts_follow_the_rows(spark):
    """Numbers from 0 on mixed with hashed ones, most of them far apart: no part is above three times its share."""
    df = spark.range(60_000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.xxhash64("id")).alias("o"), (F.col("id") % 10 != 0).alias("g"))
    sizes = [r.n for r in ranking.parted(df, "o").groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 3 * 60_000 / ranking.SIDE ** 2 and len(sizes) > 0.8 * ranking.SIDE ** 2
    some = df.withColumn("o", F.when(F.col("id") % 7 != 0, F.col("o")))
    got = ranking.rank_within(some, ["g"], "o", ("id",)).withColumn("want", F.expr("row_number() over (partition by g order by o, id)"))
    assert got.filter("position <> want").count() == 0 and got.count() == 60_000 and ranking.rank_within(df.limit(0), ["g"], "o").count() == 0


def test_plans_are_built_without_jobs(spark, finding):
    df = finding(dict(severity="CRITICAL", category="authentication_bypass"), dict(category="idor_data_exposure"))
    spark.sparkContext.setJobGroup("planned", "plans only")
    try:
        made = [chains.attack_chains(df), chains.attack_chains(df, first=2), chains.chain_ranges(df), aggregate.group_by_category(df), report.summary_rows(df)]
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planned")
        assert made[0].count() == 1 and spark.sparkContext.statusTracker().getJobIdsForGroup("planned")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_chains_by_number(spark, finding):
    rows = [dict(severity="HIGH", category="auth_bypass", description=f"d{i}") for i in range(4)] + [dict(category="idor_data_exposure") for _ in range(3)]
    rows += [dict(category="xss", description="session") for _ in range(2)] + [dict(category="ssrf"), dict(category="sql_injection", file="admin.py")]
    df = finding(*rows, *[{**r, "repo_id": "b"} for r in rows[:6]])
    whole = {(r.repo_id, r.chain_no): r for r in chains.attack_chains(df).collect()}
    asked = [(repo, n) for repo in ("r", "b", "none") for n in (0, 1, 1, 2, 5, 8, 11, 12, 13, 14, 17, 18, 19, 99)]
    got = {(r.repo_id, r.chain_no): r for r in chains.list_chains(df, spark.createDataFrame(asked, "repo_id string, chain_no int")).collect()}
    assert got == {k: whole[k] for k in set(asked) if k in whole} and len(got) > 10
    spread = sorted((r.repo_id, r.left_id, r.first_no + i) for r in chains.chain_ranges(df).collect() for i in range(r.n))
    assert spread == sorted((k[0], r.left_id, k[1]) for k, r in whole.items())


def test_report_tables(finding):
    df = finding(*[dict(severity=s, category="XSS", owasp="A03" if i % 2 else None) for i, s in enumerate(["CRITICAL", "HIGH", "HIGH", "LOW", "ODD"])])
    matrix = {r.severity: (r.n, len(r.bar)) for r in report.risk_matrix(df).collect()}
    assert matrix == {"CRITICAL": (1, 25), "HIGH": (2, 50), "MEDIUM": (0, 0), "LOW": (1, 25), "INFO": (0, 0), "ODD": (1, 25)}
    assert {r.phase: (r.n_findings, r.total_effort) for r in report.remediation_roadmap(df).collect()} == {
        "phase_1_immediate": (1, 6.0), "phase_2_short_term": (2, 6.0), "phase_3_medium_term": (0, 0.0), "phase_4_long_term": (1, 1.0)}
    summary = report.executive_summary(df, {"application": "Shop"}).first()
    assert summary.estimated_hours == 19.0 and summary.critical == 1 and summary.business_impact.startswith("Critical") and "on Shop." in summary.overview
    assert summary.immediate_actions == [f"Fix XSS in api.py ({s})" for s in ("CRITICAL", "HIGH", "HIGH")]
    assert report.executive_summary(df.limit(0)).first().total == 0
    assert {(r.framework, r.item): r.n for r in report.compliance_counts(df).collect()} == {("owasp", "A03"): 2, ("cwe", "CWE-89"): 5}
    assert {r.section for r in report.summary_rows(df).collect()} == {"total_findings", "by_severity", "average_cvss", "top_categories", "attack_chains"}


def test_groups_and_gate(finding):
    df = finding(dict(), dict(file="ui.py"), dict(severity="LOW", repo_id="b"), dict())
    assert sorted((r.file, r.group_position, r.group_size) for r in aggregate.group_by_file(df).filter("repo_id = 'r'").collect()) == [("api.py", 1, 2), ("api.py", 2, 2), ("ui.py", 1, 1)]
    assert {r.repo_id: r.blocked for r in aggregate.severity_gate(df, "HIGH").collect()} == {"r": True, "b": False}


def test_aggregate_and_analyze(src, finding):
    out = aggregate_findings(finding(dict()), finding(dict(severity="CRITICAL")), None)
    assert [r.severity for r in out["findings"].collect()] == ["CRITICAL"]
    files = src(("a.py", "password\nh = hashlib.md5(x)"), ("b.py", "h = hashlib.md5(x)"), ("test_c.py", "# etag\nh = hashlib.md5(x)"))
    got = analyze(files).collect()
    assert [(r.file, r.severity, r.cvss_score) for r in got] == [("a.py", "CRITICAL", 9.5), ("b.py", "MEDIUM", 5.0)]
    model = finding(dict(file="b.py", category="Command Injection", severity="HIGH"))
    assert [r.severity for r in analyze(files, model_findings=model, changed=["b.py"]).collect()] == ["HIGH", "MEDIUM"]


def test_summary_builds_only_the_first_chains(finding, monkeypatch):
    """Only the first three repositories with a chain are asked for their chains; what has no findings is still shown."""
    asked, build = [], report.attack_chains
    monkeypatch.setattr(report, "attack_chains", lambda f, **k: asked.append(f) or build(f, **k))
    rows = [dict(repo_id=r, severity="HIGH", category=c) for r in (None, "a", "b", "c", "d", "e") for c in ("auth_bypass", "xss", "idor", "idor")]
    rows = [r for r in rows if r["repo_id"] != "a" or r["category"] == "xss"] + [dict(repo_id="e", severity="ODD", category="ssrf", cvss_score=5.0)]
    made = report.summary_rows(finding(*rows))
    assert {r.repo_id for r in asked[0].collect()} == {"b", "c", "d"}
    assert made.columns == ["section", "position", "key", "value"] and dict(made.dtypes)["position"] == "int"
    got = sorted(map(tuple, made.collect()))
    text = "Attacker bypasses authentication (...) then accesses sensitive data (...)"
    assert got == sorted([
        ("total_findings", 1, "total", "22"), ("average_cvss", 1, "average", "5.0"),
        *[("by_severity", i, s, str(n)) for i, (s, n) in enumerate(dict(CRITICAL=0, HIGH=21, MEDIUM=0, LOW=0, INFO=0).items(), 1)],
        *[("top_categories", i, c, n) for i, (c, n) in enumerate([("idor", "10"), ("xss", "6"), ("auth_bypass", "5"), ("ssrf", "1")], 1)],
        ("attack_chains", 0, "count", "11"),
        *[("attack_chains", i, f"CHAIN-{n:03d}", text) for i, n in enumerate((1, 2, 1), 1)]])
    empty = sorted(map(tuple, report.summary_rows(finding(dict()).limit(0)).collect()))
    assert empty == sorted([("attack_chains", 0, "count", "0"), *[("by_severity", i, s, "0") for i, s in enumerate(["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"], 1)]])


def test_order_lines_are_dealt_out_once(spark, tmp_path, monkeypatch):
    """A shuffled join deals the order lines out by itself; they are spread only where it is a broadcast join."""
    from suite import views
    monkeypatch.setattr(views, "PIECE", 1000)
    part = spark.range(50).selectExpr("id as p_partkey", "if(id % 2 = 0, 'ECONOMY', 'LARGE') as p_type")
    line = spark.range(2000).selectExpr(
        "id as l_orderkey", "nullif(id % 60, 7) as l_partkey", "id % 9 as l_suppkey", "int(id % 7 + 1) as l_linenumber", "id / 3 as l_extendedprice", "0.05 as l_discount", "0.0 as l_tax",
        "'R' as l_returnflag", "'O' as l_linestatus")
    for name, table in (("part", part), ("lineitem", line)):
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    seen = {}
    for limit in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            df = views.findings(spark, str(tmp_path))
            plan = df._jdf.queryExecution().executedPlan().toString()
            seen[limit] = plan.count("RoundRobinPartitioning"), plan.count("Exchange hashpartitioning"), sorted(map(str, df.collect()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen["10MB"][:2] == (1, 0) and seen["-1"][:2] == (0, 2)
    assert seen["10MB"][2] == seen["-1"][2] and len(seen["-1"][2]) > 1500


def test_chains_of_many_scopes_by_one_shuffle(spark, finding, monkeypatch):
    """Scopes with short sides are listed after one shuffle, wide ones and long texts in squares; numbers and texts are the same."""
    import random
    rng = random.Random(5)
    rows = []
    for repo, n in (("a", 6), ("b", 12), ("c", 40), ("d", 9), ("e", 1), (None, 8)):
        rows += [dict(repo_id=repo, id=f"{repo}{i}", ord=rng.randrange(1000) * 100 + len(rows) + i, severity=rng.choice(["CRITICAL", "HIGH"]),
                      category=rng.choice(["authentication", "auth_idor", "XSS", "SQL Injection", "ssrf", "access_control"]),
                      description="x" * 300 if repo == "d" else rng.choice(["session", "Cookie", "y", ""]), file=rng.choice(["admin/a.py", "b.py"])) for i in range(n)]
    df = finding(*rows).repartition(5)
    want = {}
    for repo in "abcde":
        mine = sorted((r for r in rows if r["repo_id"] == repo), key=lambda r: r["ord"])
        text = {r["id"]: r["description"] for r in mine}
        for no, (name, p, left, right) in enumerate(brute_chains(mine), 1):
            want[repo, no] = (name, p, left, right, chains.texts.CHAINS[p - 1][3] % (text[left], text[right]) if p == 1 else chains.texts.CHAINS[p - 1][3])
    roles = chains.chain_roles(df)
    for block, listed, wide in ((1000, 4 << 20, set()), (3, 4 << 20, {"b", "c"}), (1000, 500, {"d"})):
        monkeypatch.setattr(chains, "BLOCK", block)
        monkeypatch.setattr(chains, "LISTED", listed)
        made = chains.attack_chains(df)
        listed_rows = made.collect()
        assert {(r.repo_id, r.chain_no): (r.id, r.pattern, r.left_id, r.right_id, r.description) for r in listed_rows} == want and len(listed_rows) == len(want) > 200
        assert wide <= {r.repo_id for r in chains._wide(roles, "repo_id").collect()} and (wide or not chains._wide(roles, "repo_id").count())
        if not wide:
            plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "Join" not in plan and plan.count("Exchange hashpartitioning(repo_id") == 1
