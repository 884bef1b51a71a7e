"""Filters, deduplication, statistics, order, chains and report sections, over the bulk findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesieve.fixed import noise, severity, texts
from codesieve.functions import identity
from codesieve.functions.severity import cvss_or_default, effort_hours, severity_rank
from codesieve.operators import aggregate, chains, filters, ranking, report, sample
from codesieve.operators.weak_hash import hash_findings, scan_weak_hash
from codesieve.plans.analyze import aggregate_findings
from codesieve.sources.sinks import report_tables
from suite import views
from suite import oracle_scan as o
from suite.oracle_views import FILE_RUNS, FINDINGS, SRC_FILES, case, lit
from suite.oracle_scan import any_like
from suite.registry import register, with_

RANK = case([(f"severity = {lit(s)}", str(i)) for i, s in enumerate(severity.SEVERITIES)], "5")
CVSS = "CASE WHEN coalesce(cvss_score, 0) <> 0 THEN cvss_score ELSE " + case([(f"severity = {lit(k)}", str(v)) for k, v in severity.DEFAULT_CVSS.items()], "5.0") + " END"
EFFORT = "CAST(" + case([(f"severity = {lit(k)}", str(v)) for k, v in severity.EFFORT_HOURS.items()], "2.0") + " AS DOUBLE)"
_SHOWN = ["repo_id", "id", "severity", "category", "file", "confidence"]
_COLS = ", ".join(_SHOWN)


def contains(col: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def bulk(fn):
    return lambda s, d: fn(views.findings(s, d))


def over_findings(name: str, fn, final: str, extra: list[str] | None = None) -> None:
    register(name, bulk(fn), with_([FINDINGS] + (extra or []), final))


# --- expressions -----------------------------------------------------------------------------------------------------
over_findings(
    "finding_expressions",
    lambda f: f.select(
        "id", identity.fingerprint_full(*[F.col(c) for c in ("file", "line", "category", "code_snippet")]).alias("full_fp"),
        identity.fingerprint_dedup(*[F.col(c) for c in ("file", "line", "category", "code_snippet")]).alias("dedup_fp"),
        severity_rank(F.col("severity")).alias("rank"), cvss_or_default(F.col("cvss_score"), F.col("severity")).alias("cvss"),
        effort_hours(F.col("severity")).alias("hours")),
    f"""SELECT id, md5(file || ':' || coalesce(CAST(line AS VARCHAR), 'None') || ':' || category || ':' || code_snippet) AS full_fp,
      md5(file || ':' || coalesce(CAST(NULLIF(line, 0) AS VARCHAR), '') || ':' || category || ':' || code_snippet) AS dedup_fp,
      {RANK} AS rank, {CVSS} AS cvss, {EFFORT} AS hours FROM findings""")

# --- filters ---------------------------------------------------------------------------------------------------------
over_findings("drop_low_confidence", lambda f: filters.drop_low_confidence(f).select(*_SHOWN), f"SELECT {_COLS} FROM findings WHERE confidence <> 'LOW'")
NOISE = any_like("code_snippet", noise.NOISE_PATTERNS)
over_findings("fp_regex_filter", lambda f: filters.fp_regex_filter(f).select(*_SHOWN), f"SELECT {_COLS} FROM findings WHERE NOT {NOISE}")
FRAMEWORK = (f"(({contains('file', 'Django')} OR {contains('code_snippet', 'django')}) AND category = 'SQL Injection' AND {contains('code_snippet', '.objects.')} "
             f"OR ({contains('file', 'Flask')} OR {contains('code_snippet', 'flask')}) AND category = 'XSS' AND {contains('code_snippet', 'render_template')})")
over_findings("framework_filter", lambda f: filters.framework_filter(f).select(*_SHOWN), f"SELECT {_COLS} FROM findings WHERE NOT {FRAMEWORK}")


def context_cases(client: str, relaxed: str, mocks: str) -> list[tuple[str, str]]:
    """(condition, reason): `client`, `relaxed` and `mocks` are SQL conditions on the repository."""
    c, t, n, f = "lower(category)", "lower(description)", "lower(code_snippet)", "lower(file)"
    auth = contains(c, "authentication", "authorization")
    inherited = contains(c, "deserialization", "sensitive data")
    test = "regexp_matches(lower(file), 'test_|_test\\.|/tests/|/test/|spec\\.')"
    rows = [
        ("sdk_missing_auth", f"{client} AND {contains(c, *noise.MISSING_AUTH_CATEGORIES)} AND {contains(t, 'missing', 'does not')}"),
        ("sdk_endpoint_exposure", f"{client} AND {contains(c, 'sensitive data exposure')} AND ({contains(t, 'api endpoint')} OR {contains(n, 'endpoint')}) AND "
         f"{contains(t, 'without')} AND {contains(t, 'auth', 'check')}"),
        ("benign_deserialisation", f"{relaxed} AND {contains(c, 'deserialization')} AND NOT {contains(n, *noise.DANGEROUS_LOADERS)}"),
        ("is_auth_check", f"{any_like(n, noise.AUTH_CHECK_PATTERNS, False)} AND {auth}"),
        ("pem_loading", f"{relaxed} AND {contains(c, 'sensitive data', 'exposure')} AND {contains(n, 'pem', 'private_key', 'api_secret')} AND {contains(n, 'load', 'serialize')}"),
        ("logging", f"({contains(c, 'insufficient logging')} OR {contains(t, 'no logging')})"),
        ("sdk_public_endpoint", f"{client} AND {contains(c, 'misconfiguration')} AND ({contains(t, 'public')} OR {contains(n, 'endpoint')})"),
        ("mock_server", f"{mocks} AND {contains(f, 'mock', 'test')} AND ({contains(c, 'websocket')} OR {contains(n, 'handler')})"),
        ("docstring_param", f"{contains(c, 'sensitive data')} AND ({contains(n, 'optional (str)')} OR {contains(n, '**')} AND {contains(n, 'param')})"),
        ("docstring_key", f"{contains(c, 'sensitive data')} AND {contains(n, '- **api_key', '- **api_secret')}"),
        ("super_init", f"{inherited} AND {contains(n, 'super().__init__(**')}"),
        ("kwargs", f"{inherited} AND {contains(n, '**kwargs')} AND NOT {contains(n, 'setattr')}"),
        ("uuid_session", f"{contains(c, 'session', 'authentication')} AND ({contains(n, 'uuid')} OR {contains(t, 'uuid4')}) AND NOT {contains(n, 'predictable')}"),
        ("auth_test", f"{test} AND {auth} AND ({contains(n, 'subscribe')} OR {contains(t, 'unauthenticated')})"),
        ("ci_secret_reference", f"{contains(f, '.github', '.yml')} AND {contains(n, 'secrets.')}"),
        ("sdk_rate_limit", f"{client} AND {contains(c, 'api')} AND {contains(t, 'rate', 'limit')}"),
    ]
    return [(cond, lit(reason)) for reason, cond in rows]


def test_cases(fixtures: str) -> list[tuple[str, str]]:
    test = "regexp_matches(lower(file), 'test_|_test\\.|/tests/|/test/|spec\\.')"
    return [(f"{test} AND severity IN ('LOW', 'INFO')", "'test_low_severity'"),
            (f"{test} AND {fixtures} AND ({contains('lower(description)', 'hardcoded')} OR {contains('lower(code_snippet)', 'test')})", "'test_fixture'")]


def cascade(client="false", relaxed="false", mocks="false", fixtures="false") -> str:
    first = [("confidence = 'LOW'", "'low_confidence'"), (NOISE, "'noise_pattern'"), (FRAMEWORK, "'framework'")]
    return case(first + context_cases(client, relaxed, mocks) + test_cases(fixtures), "'kept'")


# A profile of the bulk repositories: their type follows from their name.
def bulk_profile(findings):
    from codesieve.operators.profile import security_rules
    kind = F.when(F.length("repo_id") % 2 == 0, "client_sdk").otherwise("web_app")
    return findings.select("repo_id").distinct().select("repo_id", *security_rules(kind))


SDK = "length(repo_id) % 2 = 0"
over_findings("context_filter", lambda f: filters.context_filter(f, bulk_profile(f)).select(*_SHOWN),
              f"SELECT {_COLS} FROM findings WHERE {case(context_cases(SDK, SDK, 'true'))} IS NULL")
over_findings("test_file_filter", lambda f: filters.test_file_filter(f, bulk_profile(f)).select(*_SHOWN),
              f"SELECT {_COLS} FROM findings WHERE {case(test_cases('true'))} IS NULL")
over_findings("fp_cascade", lambda f: filters.fp_cascade(f, None, bulk_profile(f), explain=True).select(
    "repo_id", "id", F.coalesce("drop_reason", F.lit("kept")).alias("reason")),
    f"SELECT repo_id, id, {cascade(SDK, SDK, 'true', 'true')} AS reason FROM findings")
over_findings("fp_cascade_reasons", lambda f: filters.fp_cascade(f, explain=True).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(
    F.count(F.lit(1)).alias("n")), f"SELECT {cascade()} AS reason, count(*) AS n FROM findings GROUP BY 1")
over_findings("filter_by_severity", lambda f: filters.filter_by_severity(f, "MEDIUM").select(*_SHOWN),
              f"SELECT {_COLS} FROM findings WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM')")
over_findings("filter_by_severity_strict",
              lambda f: filters.filter_by_severity_strict(f.filter(F.col("severity") != "UNRATED"), "LOW").select(*_SHOWN),
              f"SELECT {_COLS} FROM findings WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')")

# --- deduplication, statistics, order --------------------------------------------------------------------------------
DEDUP = f"""keyed AS (SELECT *, md5(file || ':' || coalesce(CAST(NULLIF(line, 0) AS VARCHAR), '') || ':' || category || ':' || code_snippet) AS fp,
    {RANK} AS rank FROM findings),
unique_findings AS (SELECT * EXCLUDE (ord, fp, rank, pos, first_ord), first_ord AS ord FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, fp ORDER BY rank, ord, id) AS pos, min(ord) OVER (PARTITION BY repo_id, fp) AS first_ord FROM keyed)
  WHERE pos = 1)"""
over_findings("deduplicate", lambda f: aggregate.deduplicate(f).select(*_SHOWN, "ord"), f"SELECT {_COLS}, ord FROM unique_findings", [DEDUP])
STATS = """SELECT 'by_severity' AS section, severity AS key, count(*) AS n, -1.0 AS avg_cvss_score FROM {t} GROUP BY severity
  UNION ALL SELECT 'by_category', category, count(*), -1.0 FROM {t} GROUP BY category
  UNION ALL SELECT 'by_confidence', confidence, count(*), -1.0 FROM {t} GROUP BY confidence
  UNION ALL SELECT 'total', 'all', count(*), round(coalesce(avg(NULLIF(cvss_score, 0)), 0.0), 6) FROM {t}"""


def _stats(df):
    return df.select("section", F.coalesce("key", F.lit("all")).alias("key"), "n", F.coalesce(F.round("avg_cvss_score", 6), F.lit(-1.0)).alias("avg_cvss_score"))


over_findings("finding_statistics", lambda f: _stats(aggregate.finding_statistics(f)), STATS.format(t="findings"))
over_findings("aggregate_findings", lambda f: _stats(aggregate_findings(
    f.filter(F.col("confidence") == "HIGH"), f.filter(F.col("confidence") == "MEDIUM"), f.filter(F.col("confidence") == "LOW"))["statistics"]),
    STATS.format(t="unique_findings"), [DEDUP])
over_findings("finding_statistics_by_repo", lambda f: aggregate.finding_statistics(f, ["repo_id"]).filter("section = 'total'").select(
    "repo_id", "n", F.round("avg_cvss_score", 6).alias("avg_cvss_score")),
    "SELECT repo_id, count(*) AS n, round(coalesce(avg(NULLIF(cvss_score, 0)), 0.0), 6) AS avg_cvss_score FROM findings GROUP BY repo_id")
over_findings("severity_breakdown", aggregate.severity_breakdown, "SELECT severity, count(*) AS n FROM findings GROUP BY severity")
over_findings("assign_cvss", lambda f: aggregate.assign_cvss(f).select("id", "cvss_score"), f"SELECT id, {CVSS} AS cvss_score FROM findings")
over_findings("sort_by_severity_first", lambda f: ranking.top_k(aggregate.assign_cvss(f), 1000, aggregate.severity_order()).select("id", "severity", "cvss_score"),
              f"SELECT id, severity, {CVSS} AS cvss_score FROM findings ORDER BY {RANK}, 3 DESC, ord, id LIMIT 1000")
over_findings("sort_by_severity", lambda f: aggregate.sort_by_severity(aggregate.assign_cvss(f)).select("id", "severity", "cvss_score"),
              f"SELECT id, severity, {CVSS} AS cvss_score FROM findings ORDER BY {RANK}, 3 DESC, ord, id")
PRIORITY = ("(" + case([(f"severity = {lit(k)}", str(v)) for k, v in severity.PRIORITY_BASE.items()], "500") +
            f" - CASE WHEN {contains('lower(category)', *severity.PRIORITY_CATEGORIES)} THEN 50 ELSE 0 END - CASE WHEN confidence = 'HIGH' THEN 25 ELSE 0 END"
            " - coalesce(cvss_score, 0.0) - {extra})")
over_findings("prioritize", lambda f: aggregate.with_priority(f, {"environment": "production", "contains_pii": True}).select(
    "id", F.round("priority", 6).alias("priority")).orderBy("priority", "id"),
    f"SELECT id, round({PRIORITY.format(extra='175')}, 6) AS priority FROM findings")
over_findings("prioritize_first", lambda f: aggregate.prioritize(f).limit(500).select("id", "severity", "category"),
              f"SELECT id, severity, category FROM findings ORDER BY {PRIORITY.format(extra='0')}, ord, id LIMIT 500")
over_findings("top_k_per_repo", lambda f: ranking.top_k(f, 5, [severity_rank(F.col("severity")), "ord"], ["repo_id"]).select("repo_id", "id", "severity"),
              f"SELECT repo_id, id, severity FROM findings QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY {RANK}, ord) <= 5")
over_findings("severity_gate", lambda f: aggregate.severity_gate(f.filter(F.col("confidence") == "HIGH"), "CRITICAL").select(
    "repo_id", F.col("blocked").cast("int").alias("blocked")),
    "SELECT repo_id, CAST(bool_or(severity = 'CRITICAL') AS INTEGER) AS blocked FROM findings WHERE confidence = 'HIGH' GROUP BY repo_id")
for _name, _fn, _key in (("group_by_file", aggregate.group_by_file, "repo_id, file"), ("group_by_category", aggregate.group_by_category, "category")):
    over_findings(_name, (lambda fn: lambda f: fn(f).select("repo_id", "file", "category", "id", "group_position", "group_size"))(_fn),
                  f"""SELECT repo_id, file, category, id, row_number() OVER (PARTITION BY {_key} ORDER BY ord, id) AS group_position,
                  count(*) OVER (PARTITION BY {_key}) AS group_size FROM findings""")

# --- attack chains ---------------------------------------------------------------------------------------------------
_C, _D, _F = "lower(category)", "lower(description)", "lower(file)"
CHAINS = f"""l1 AS (SELECT * FROM findings WHERE {contains(_C, 'auth')} AND severity IN ('CRITICAL', 'HIGH')),
r1 AS (SELECT * FROM findings WHERE {contains(_C, *texts.CHAIN_DATA_CATEGORIES)}),
l2 AS (SELECT * FROM findings WHERE {contains(_C, 'xss')}),
r2 AS (SELECT * FROM findings WHERE {contains(_D, 'session', 'cookie')}),
pairs AS (
  SELECT l1.repo_id, 1 AS pattern, l1.id AS left_id, r1.id AS right_id, l1.ord AS lo, r1.ord AS ro, l1.description AS ld, r1.description AS rd FROM l1 JOIN r1 USING (repo_id)
  UNION ALL SELECT l2.repo_id, 2, l2.id, r2.id, l2.ord, r2.ord, '', '' FROM l2 JOIN r2 USING (repo_id)
  UNION ALL SELECT repo_id, 3, id, '', ord, 0, '', '' FROM findings WHERE {contains(_C, 'sql')} AND {contains(_C, 'injection')} AND {contains(_F, 'admin', 'auth')}
  UNION ALL SELECT repo_id, 4, id, '', ord, 0, '', '' FROM findings WHERE {contains(_C, 'ssrf')}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY pattern, lo, ro) AS chain_no FROM pairs),
chains AS (SELECT repo_id, 'CHAIN-' || CASE WHEN chain_no < 1000 THEN lpad(CAST(chain_no AS VARCHAR), 3, '0') ELSE CAST(chain_no AS VARCHAR) END AS id, chain_no, pattern, left_id, right_id,
  {case([(f'pattern = {r[0]}', lit(r[1])) for r in texts.CHAINS])} AS severity, {case([(f'pattern = {r[0]}', lit(r[2])) for r in texts.CHAINS])} AS impact,
  CASE WHEN pattern = 1 THEN 'Attacker bypasses authentication (' || ld || '...) then accesses sensitive data (' || rd || '...)'
       ELSE {case([(f'pattern = {r[0]}', lit(r[3])) for r in texts.CHAINS[1:]])} END AS description FROM numbered)"""
_CHAIN = ["repo_id", "id", "chain_no", "pattern", "left_id", "severity", "impact", "description"]
over_findings("attack_chains", lambda f: chains.attack_chains(f).select(*_CHAIN, F.coalesce("right_id", F.lit("")).alias("right_id")),
              f"SELECT {', '.join(_CHAIN)}, right_id FROM chains", [CHAINS])
over_findings("attack_chains_first", lambda f: chains.attack_chains(f, first=3).select(*_CHAIN, F.coalesce("right_id", F.lit("")).alias("right_id")),
              f"SELECT {', '.join(_CHAIN)}, right_id FROM chains WHERE chain_no <= 3", [CHAINS])
over_findings("attack_chain_ranges", chains.chain_ranges, "SELECT repo_id, pattern, left_id, min(chain_no) AS first_no, count(*) AS n FROM chains GROUP BY repo_id, pattern, left_id", [CHAINS])


def _every_37th(f):
    """Every 37th chain of each repository, by its number alone."""
    totals = chains.chain_counts(f).groupBy("repo_id").agg(F.sum("n_chains").alias("n")).filter("n > 0")
    return chains.list_chains(f, totals.select("repo_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"), F.lit(37).cast("bigint"))).alias("chain_no")))


over_findings("attack_chains_listed", lambda f: _every_37th(f).select(*_CHAIN, F.coalesce("right_id", F.lit("")).alias("right_id")),
              f"SELECT {', '.join(_CHAIN)}, right_id FROM chains WHERE chain_no % 37 = 1", [CHAINS])
over_findings("attack_chain_counts", lambda f: chains.chain_counts(f).filter("n_chains > 0").select("repo_id", "pattern", "n_chains", (F.col("start") + 1).alias("first_no")),
              "SELECT repo_id, pattern, count(*) AS n_chains, min(chain_no) AS first_no FROM chains GROUP BY repo_id, pattern", [CHAINS])

# --- report sections -------------------------------------------------------------------------------------------------
over_findings("risk_matrix", report.risk_matrix, f"""SELECT severity, n, repeat('█', CAST(floor(CAST(n AS DOUBLE) / max(n) OVER () * 50) AS INTEGER)) AS bar
  FROM (SELECT severity, CAST(sum(n) AS BIGINT) AS n FROM (SELECT severity, count(*) AS n FROM findings GROUP BY 1 UNION ALL
        SELECT unnest([{', '.join(lit(s) for s in severity.SEVERITIES)}]), 0) GROUP BY 1)""")
over_findings("category_counts", report.category_counts, "SELECT category, count(*) AS n, min(ord) AS first_seen FROM findings GROUP BY category")
PHASE = case([(f"severity IN ({', '.join(lit(s) for s in r[2])})", lit(r[0])) for r in severity.ROADMAP])
over_findings("roadmap_items", lambda f: report.roadmap_items(f).drop("ord"), f"""SELECT repo_id, {PHASE} AS phase, id, category AS title,
  {case([(f"severity IN ({', '.join(lit(s) for s in r[2])})", lit(r[3])) for r in severity.ROADMAP])} AS effort FROM findings WHERE severity <> 'UNRATED'""")
over_findings("remediation_roadmap", report.remediation_roadmap, " UNION ALL ".join(
    f"SELECT {lit(r[0])} AS phase, {lit(r[1])} AS timeframe, count(*) AS n_findings, CAST(count(*) * {r[4]} AS DOUBLE) AS total_effort FROM findings WHERE severity IN ({', '.join(lit(s) for s in r[2])})"
    for r in severity.ROADMAP))
_IMPACT = f"CASE WHEN critical > 0 THEN {lit(texts.IMPACT_CRITICAL)} WHEN high > 2 THEN {lit(texts.IMPACT_HIGH)} ELSE {lit(texts.IMPACT_OTHER)} END"
_A, _B, _E = texts.OVERVIEW.replace("%d", "%s").split("%s")


def _summary(by):
    group, join = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {group}{lit(_A)} || 'Application' || {lit(_B)} || total || {lit(_E)} AS overview, total, critical, high, medium, low, info, {_IMPACT} AS business_impact,
      coalesce(actions, '') AS immediate_actions, estimated_hours, estimated_hours / 40 AS estimated_weeks
    FROM (SELECT {group}count(*) AS total, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in severity.SEVERITIES)}, sum({EFFORT}) AS estimated_hours
          FROM findings {'GROUP BY ' + by if by else ''}) t
    LEFT JOIN (SELECT {group}string_agg('Fix ' || category || ' in ' || file || ' (' || severity || ')', ' | ' ORDER BY pos) AS actions FROM (
          SELECT *, row_number() OVER ({part} ORDER BY {RANK}, ord, id) AS pos FROM findings WHERE severity IN ('CRITICAL', 'HIGH')) WHERE pos <= 3 {'GROUP BY ' + by if by else ''}) a {join}"""


def _flat_summary(df):
    return df.withColumn("immediate_actions", F.concat_ws(" | ", "immediate_actions")).drop("phases")


over_findings("executive_summary", lambda f: _flat_summary(report.executive_summary(f)), _summary(None))
over_findings("executive_summary_by_repo", lambda f: _flat_summary(report.executive_summary(f, by=["repo_id"])), _summary("repo_id"))
over_findings("compliance_counts", report.compliance_counts, """SELECT 'owasp' AS framework, owasp AS item, count(*) AS n FROM findings WHERE owasp <> '' GROUP BY 2
  UNION ALL SELECT 'cwe', cwe, count(*) FROM findings WHERE cwe <> '' GROUP BY 2""")
over_findings("cvss_appendix", report.cvss_appendix, f"SELECT repo_id, id AS finding_id, coalesce(cvss_score, 0.0) AS cvss_score, {lit(severity.CVSS_VECTOR)} AS cvss_vector FROM findings")
over_findings("remediation_guidance", lambda f: report.remediation_guidance(f).drop("references", "line"), f"""SELECT id AS finding_id, category AS vulnerability, file, description, impact,
  remediation, remediation AS code_example, {lit(texts.TESTING_PROCEDURE)} AS testing_procedure FROM findings""")
over_findings("summary_rows", report.summary_rows, f"""
  SELECT 'total_findings' AS section, 1 AS position, 'total' AS key, CAST(count(*) AS VARCHAR) AS value FROM findings
  UNION ALL SELECT 'by_severity', {RANK} + 1, severity, CAST(count(*) AS VARCHAR) FROM findings WHERE severity <> 'UNRATED' GROUP BY severity
  UNION ALL SELECT 'average_cvss', 1, 'average', format('{{:.1f}}', avg(NULLIF(cvss_score, 0))) FROM findings
  UNION ALL SELECT 'top_categories', row_number() OVER (ORDER BY n DESC, f), category, CAST(n AS VARCHAR) FROM (
     SELECT category, count(*) AS n, min(ord) AS f FROM findings GROUP BY category ORDER BY n DESC, f LIMIT 5)
  UNION ALL SELECT 'attack_chains', 0, 'count', CAST(count(*) AS VARCHAR) FROM chains
  UNION ALL SELECT 'attack_chains', row_number() OVER (ORDER BY repo_id, chain_no), id, description FROM (SELECT * FROM chains ORDER BY repo_id, chain_no LIMIT 3)""", [CHAINS])
over_findings("report_tables_high", lambda f: report_tables(f.filter("severity <> 'UNRATED'"), min_severity="HIGH")["compliance_mapping"],
              """SELECT 'owasp' AS framework, owasp AS item, count(*) AS n FROM findings WHERE owasp <> '' AND severity IN ('CRITICAL', 'HIGH') GROUP BY 2
  UNION ALL SELECT 'cwe', cwe, count(*) FROM findings WHERE cwe <> '' AND severity IN ('CRITICAL', 'HIGH') GROUP BY 2""")

# --- the flagship ----------------------------------------------------------------------------------------------------
register(
    "weak_hash_by_severity",
    lambda s, d: aggregate.deduplicate(hash_findings(scan_weak_hash(views.src_files(s, d)))).groupBy("repo_id", "severity").agg(F.count(F.lit(1)).alias("n")),
    with_(o.hash_ctes(), """SELECT repo_id, severity, count(*) AS n FROM (
      SELECT repo_id, severity, row_number() OVER (PARTITION BY repo_id, path, line_no, code_snippet ORDER BY
        CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END) AS pos FROM hash_scan) WHERE pos = 1 GROUP BY 1, 2"""),
)

# --- batches and run logs --------------------------------------------------------------------------------------------
register("assign_batches", lambda s, d: sample.assign_batches(views.src_files(s, d).select("repo_id", "path"), 5),
         with_([SRC_FILES], f"""SELECT repo_id, path, (row_number() OVER (PARTITION BY repo_id ORDER BY {o.file_no('path')}, path) - 1) // 5 AS batch_id FROM src_files"""))
register("run_statistics", lambda s, d: sample.run_statistics(views.file_runs(s, d)).select(
            "total_files", "total_batches", "total_findings", *[F.round(c, 6).alias(c) for c in ("parallel_time", "sequential_time", "speedup", "files_per_second")]),
         with_([FILE_RUNS, "batches AS (SELECT batch_id, count(*) AS files, sum(findings) AS findings, sum(seconds) AS seconds FROM file_runs GROUP BY 1)"],
               """SELECT CAST(sum(files) AS BIGINT) AS total_files, count(*) AS total_batches, CAST(sum(findings) AS BIGINT) AS total_findings, round(max(seconds), 6) AS parallel_time,
               round(sum(seconds), 6) AS sequential_time, round(sum(seconds) / max(seconds), 6) AS speedup, round(sum(files) / max(seconds), 6) AS files_per_second FROM batches"""))
register("estimate_cost", lambda s, d: sample.estimate_cost(views.file_runs(s, d)).select(F.round("cost", 6).alias("cost")),
         with_([FILE_RUNS], "SELECT round(count(*) * 1000 / 1000000.0 * 0.15, 6) AS cost FROM file_runs"))
