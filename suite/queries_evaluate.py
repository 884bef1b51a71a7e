"""Evaluation, samples, foreign formats and model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesieve.fixed import models, texts
from codesieve.functions.paths import norm_path, rel_path
from codesieve.operators import evaluate, merge, model_io, sample
from codesieve.operators.weak_hash import hash_findings, scan_weak_hash
from codesieve.plans.score import score_engine
from codesieve.sources import files, findings, labels
from suite import views
from suite import oracle_scan as o
from suite.oracle_views import (CHAT_ENVELOPES, GROUND_TRUTH, MODEL_RESPONSES, NORM_FINDINGS, PATH, USAGE_LOG, case, lit, pick)
from suite.registry import register, with_

# --- matching and metrics --------------------------------------------------------------------------------------------
NORM = "regexp_replace(replace({p}, chr(92), '/'), '^[./]+', '')"
MATCH = f"""gt AS (SELECT *, {NORM.format(p='file')} AS a FROM ground_truth),
nf AS (SELECT *, {NORM.format(p='file')} AS b FROM norm_findings),
paired AS (SELECT gt.id, gt.cwe, gt.is_vulnerable, gt.line AS gt_line, nf.run_id, nf.line AS f_line,
    (a = b OR (CASE WHEN least(len(string_split(a, '/')), len(string_split(b, '/'))) >= 2
        THEN string_split(a, '/')[-2:] = string_split(b, '/')[-2:] ELSE string_split(a, '/')[-1] = string_split(b, '/')[-1] END
      AND (ends_with(a, b) OR ends_with(b, a)))) AS same
  FROM gt JOIN nf ON gt.cwe IS NOT DISTINCT FROM nf.cwe),
file_hits AS (SELECT DISTINCT run_id, id FROM paired WHERE same),
line_hits AS (SELECT DISTINCT run_id, id FROM paired WHERE same AND (NOT is_vulnerable OR abs(f_line - gt_line) <= 3)),
detected AS (SELECT 'file_cwe' AS granularity, r.run_id, gt.*, h.id IS NOT NULL AS hit FROM gt CROSS JOIN (SELECT DISTINCT run_id FROM nf) r LEFT JOIN file_hits h ON h.run_id = r.run_id AND h.id = gt.id
  UNION ALL SELECT 'line', r.run_id, gt.*, h.id IS NOT NULL FROM gt CROSS JOIN (SELECT DISTINCT run_id FROM nf) r LEFT JOIN line_hits h ON h.run_id = r.run_id AND h.id = gt.id),
bucketed AS (SELECT *, 'overall' AS bucket FROM detected UNION ALL SELECT *, CAST(cwe AS VARCHAR) FROM detected WHERE cwe IS NOT NULL),
counts AS (SELECT run_id, granularity, bucket, count(*) FILTER (WHERE is_vulnerable AND hit) AS tp, count(*) FILTER (WHERE NOT is_vulnerable AND hit) AS fp,
  count(*) FILTER (WHERE is_vulnerable AND NOT hit) AS fn, count(*) FILTER (WHERE NOT is_vulnerable AND NOT hit) AS tn FROM bucketed GROUP BY ALL),
rates AS (SELECT *, CASE WHEN fp + tn > 0 AND tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr FROM counts),
scores AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) WHEN p + r = 0 THEN 0.0 END AS f1, r - fpr AS youden FROM rates)"""
EVAL = [GROUND_TRUTH, NORM_FINDINGS, MATCH]
# A metric that is undefined shows as -9.
_METRIC = lambda c: F.coalesce(F.round(c, 6), F.lit(-9.0)).alias(c)


def both(s, d):
    return views.ground_truth(s, d), views.norm_findings(s, d)


register("match_ground_truth", lambda s, d: evaluate.match_ground_truth(*both(s, d)).select("run_id", "id"), with_(EVAL, "SELECT run_id, id FROM file_hits"))
register("match_within_lines", lambda s, d: evaluate.match_within_lines(*both(s, d)).select("run_id", "id"), with_(EVAL, "SELECT run_id, id FROM line_hits"))


def _confusion(s, d):
    truth, found = both(s, d)
    counts = evaluate.confusion_counts(truth, evaluate.match_ground_truth(truth, found), evaluate.run_list(found))
    return counts.drop("dataset")


register("confusion_counts", _confusion, with_(EVAL, "SELECT run_id, bucket, tp, fp, fn, tn FROM counts WHERE granularity = 'file_cwe'"))
_NOTES = f"""concat_ws(' | ', CASE WHEN fp + tn = 0 THEN {lit(texts.NOTE_NO_SAFE)} WHEN tp + fp = 0 THEN {lit(texts.NOTE_NO_PREDICTIONS)} END,
  CASE WHEN tp + fn = 0 THEN {lit(texts.NOTE_NO_VULNERABLE)} END)"""
_R = lambda c: f"coalesce(round({c}, 6), -9.0)"
register("score_tool", lambda s, d: evaluate.score_tool(*both(s, d)).select(
            "run_id", "granularity", "bucket", "tp", "fp", "fn", "tn", *[_METRIC(c) for c in ("precision", "recall", "f1", "fpr", "youden")],
            F.concat_ws(" | ", "notes").alias("notes")),
         with_(EVAL, f"""SELECT run_id, granularity, bucket, tp, fp, fn, tn, {_R('p')} AS precision, {_R('r')} AS recall, {_R('f1')} AS f1, {_R('fpr')} AS fpr,
           {_R('youden')} AS youden, {_NOTES} AS notes FROM scores"""))
register("score_counts", lambda s, d: evaluate.score_counts(*both(s, d)).drop("dataset"),
         with_(EVAL, """SELECT g.*, f.* FROM (SELECT count(*) AS ground_truth_entries, count(*) FILTER (WHERE is_vulnerable) AS vulnerable, count(*) FILTER (WHERE NOT is_vulnerable) AS non_vulnerable,
           count(*) FILTER (WHERE is_vulnerable AND line IS NOT NULL) AS vulnerable_entries_with_line_labels FROM ground_truth) g,
           (SELECT run_id, count(*) AS tool_findings FROM norm_findings GROUP BY 1) f"""))


def _repositories(s, d):
    """Ground truth and reports in two datasets and several repositories, with a run that reports on one dataset only."""
    truth, found = both(s, d)
    n = F.regexp_extract("id", r"(\d+)", 1).cast("bigint")
    truth = truth.withColumns({"repo_id": F.concat(F.lit("r"), (n % 3).cast("string")), "dataset": F.concat(F.lit("d"), F.floor(n % 4 / 2).cast("string"))})
    n = F.regexp_extract("file", r"doc_(\d+)", 1).cast("bigint")
    found = found.withColumns({"repo_id": F.when(n % 7 == 0, "r9").otherwise(F.concat(F.lit("r"), (n % 3).cast("string"))), "dataset": F.concat(F.lit("d"), F.floor(n % 4 / 2).cast("string"))})
    return truth, found.unionByName(found.filter("run_id = 'run0' AND dataset = 'd0'").withColumn("run_id", F.lit("quiet")))


_BY_REPOSITORY = [GROUND_TRUTH, NORM_FINDINGS, f"""gt AS (SELECT *, {NORM.format(p='file')} AS a, 'r' || (CAST(substr(id, 3) AS BIGINT) % 3) AS repo, 'd' || (CAST(substr(id, 3) AS BIGINT) % 4 // 2) AS dataset FROM ground_truth)""",
                  f"""numbered AS (SELECT *, {NORM.format(p='file')} AS b, CAST(regexp_extract(file, 'doc_([0-9]+)', 1) AS BIGINT) AS n FROM norm_findings)""",
                  """placed AS (SELECT run_id, b, line, cwe, CASE WHEN n % 7 = 0 THEN 'r9' ELSE 'r' || (n % 3) END AS repo, 'd' || (n % 4 // 2) AS dataset FROM numbered)""",
                  """nf AS (SELECT * FROM placed UNION ALL SELECT 'quiet', b, line, cwe, repo, dataset FROM placed WHERE run_id = 'run0' AND dataset = 'd0')""",
                  """paired AS (SELECT gt.id, gt.is_vulnerable, gt.line AS gt_line, nf.run_id, nf.line AS f_line FROM gt JOIN nf ON gt.cwe IS NOT DISTINCT FROM nf.cwe AND gt.repo = nf.repo AND gt.dataset = nf.dataset
    AND (a = b OR (CASE WHEN least(len(string_split(a, '/')), len(string_split(b, '/'))) >= 2 THEN string_split(a, '/')[-2:] = string_split(b, '/')[-2:] ELSE string_split(a, '/')[-1] = string_split(b, '/')[-1] END
      AND (ends_with(a, b) OR ends_with(b, a)))))""",
                  """hits AS (SELECT DISTINCT 'file_cwe' AS granularity, run_id, id FROM paired UNION ALL SELECT DISTINCT 'line', run_id, id FROM paired WHERE NOT is_vulnerable OR abs(f_line - gt_line) <= 3)""",
                  """detected AS (SELECT g.granularity, r.run_id, gt.*, h.id IS NOT NULL AS hit FROM gt CROSS JOIN (SELECT DISTINCT run_id FROM nf) r CROSS JOIN (SELECT unnest(['file_cwe', 'line']) AS granularity) g
    LEFT JOIN hits h ON h.run_id = r.run_id AND h.id = gt.id AND h.granularity = g.granularity)""",
                  """bucketed AS (SELECT *, 'overall' AS bucket FROM detected UNION ALL SELECT *, CAST(cwe AS VARCHAR) FROM detected WHERE cwe IS NOT NULL)"""]
register("score_repositories", lambda s, d: evaluate.score_tool(*_repositories(s, d)).select("run_id", "dataset", "granularity", "bucket", "tp", "fp", "fn", "tn"),
         with_(_BY_REPOSITORY, """SELECT run_id, dataset, granularity, bucket, count(*) FILTER (WHERE is_vulnerable AND hit) AS tp, count(*) FILTER (WHERE NOT is_vulnerable AND hit) AS fp,
           count(*) FILTER (WHERE is_vulnerable AND NOT hit) AS fn, count(*) FILTER (WHERE NOT is_vulnerable AND NOT hit) AS tn FROM bucketed GROUP BY ALL"""))
_LONG = "UNION ALL ".join(f"SELECT bucket, '{m}' AS metric, {c} AS value FROM scores WHERE granularity = 'file_cwe' AND bucket = 'overall' "
                          for m, c in (("precision", "p"), ("recall", "r"), ("f1", "f1"), ("tpr", "r"), ("fpr", "fpr"), ("youden", "youden")))
register("metrics_across_runs", lambda s, d: evaluate.metrics_across_runs(evaluate.score_tool(*both(s, d))).select(
            "bucket", "metric", *[_METRIC(c) for c in ("mean", "min", "max")], "runs_defined"),
         with_(EVAL + [f"long AS ({_LONG} UNION ALL SELECT bucket, 'recall', r FROM scores WHERE granularity = 'file_cwe' AND bucket <> 'overall')"],
               f"SELECT bucket, metric, {_R('avg(value)')} AS mean, {_R('min(value)')} AS min, {_R('max(value)')} AS max, count(value) AS runs_defined FROM long GROUP BY 1, 2"))
register("finding_stability", lambda s, d: evaluate.finding_stability(views.norm_findings(s, d)).select(F.round("stability", 6).alias("stability"), "in_all", "in_any"),
         with_(EVAL, """SELECT round(in_all / in_any, 6) AS stability, in_all, in_any FROM (SELECT count(*) FILTER (WHERE n = (SELECT count(DISTINCT run_id) FROM nf)) AS in_all, count(*) AS in_any
           FROM (SELECT b, cwe, count(DISTINCT run_id) AS n FROM nf GROUP BY 1, 2))"""))
register("cwe_distribution", lambda s, d: evaluate.cwe_distribution(views.ground_truth(s, d).filter("cwe IS NOT NULL")),
         with_([GROUND_TRUTH], "SELECT cwe, count(*) AS n FROM ground_truth WHERE cwe IS NOT NULL GROUP BY cwe"))


def _engine_score(s, d):
    return score_engine(views.src_files(s, d), views.ground_truth(s, d)).select("granularity", "bucket", "tp", "fp", "fn", "tn")


_ENGINE = [c for c in o.hash_findings_ctes() + o.xpath_findings_ctes()] + [GROUND_TRUTH, """norm_findings AS (
  SELECT 'run' AS run_id, file, line, CAST(regexp_extract(cwe, '(\\d+)', 1) AS INTEGER) AS cwe FROM (SELECT file, line, cwe FROM hash_findings UNION ALL SELECT file, line, cwe FROM xpath_findings))""", MATCH]
register("score_engine", _engine_score, with_(_ENGINE, "SELECT granularity, bucket, tp, fp, fn, tn FROM counts"))
register("path_forms", lambda s, d: views.norm_findings(s, d).select(
            "run_id", "file", norm_path(F.col("file")).alias("norm"), rel_path(F.col("file"), "/srv/corpus").alias("rel")),
         with_([NORM_FINDINGS], f"""SELECT run_id, file, {NORM.format(p='file')} AS norm, CASE WHEN starts_with(file, '/srv/corpus/') THEN substr(file, 13)
           ELSE regexp_replace(file, '^(\\./)+', '') END AS rel FROM norm_findings"""))

# --- samples ---------------------------------------------------------------------------------------------------------
DRAW = lambda seed: f"CAST('0x' || substr(md5('{seed}:' || id), 1, 15) AS BIGINT)"
_TARGET = 100
register("sample_largest_remainder", lambda s, d: sample.sample_largest_remainder(views.ground_truth(s, d), ["category", "is_vulnerable"], _TARGET).select("id", "category"),
         with_([GROUND_TRUTH], f"""SELECT id, category FROM (SELECT g.*, row_number() OVER (PARTITION BY category, is_vulnerable ORDER BY {DRAW(42)}, id) AS pos FROM ground_truth g)
           JOIN (SELECT category, is_vulnerable, least(n, base + CAST(row_number() OVER (ORDER BY exact - base DESC, seen) <= {_TARGET} - sum(base) OVER () AS INTEGER)) AS take FROM (
             SELECT *, CAST(floor(exact) AS BIGINT) AS base FROM (SELECT category, is_vulnerable, count(*) AS n, min(id) AS seen, count(*) / (SELECT count(*) FROM ground_truth) * {_TARGET} AS exact
               FROM ground_truth GROUP BY 1, 2))) USING (category, is_vulnerable) WHERE pos <= take"""))
register("largest_remainder", lambda s, d: sample.largest_remainder(views.ground_truth(s, d), ["cwe"], _TARGET).select(F.coalesce("cwe", F.lit(-1)).alias("cwe"), "n", "take"),
         with_([GROUND_TRUTH], f"""SELECT coalesce(cwe, -1) AS cwe, n, least(n, base + CAST(row_number() OVER (ORDER BY exact - base DESC, seen) <= {_TARGET} - sum(base) OVER () AS INTEGER)) AS take FROM (
             SELECT *, CAST(floor(exact) AS BIGINT) AS base FROM (SELECT cwe, count(*) AS n, min(id) AS seen, count(*) / (SELECT count(*) FROM ground_truth) * {_TARGET} AS exact FROM ground_truth GROUP BY 1))"""))
register("sample_fraction", lambda s, d: sample.sample_fraction(views.ground_truth(s, d), ["cwe", "is_vulnerable"], 80).select("id", F.coalesce("cwe", F.lit(-1)).alias("cwe")),
         with_([GROUND_TRUTH], f"""SELECT id, coalesce(cwe, -1) AS cwe FROM (SELECT *, row_number() OVER (PARTITION BY cwe, is_vulnerable ORDER BY {DRAW(42)}, id) AS pos,
           greatest(1, round_even(count(*) OVER (PARTITION BY cwe, is_vulnerable) * (80.0::DOUBLE / count(*) OVER ()), 0)) AS take FROM ground_truth) WHERE pos <= take"""))
register("sample_spread", lambda s, d: sample.sample_spread(views.ground_truth(s, d), "category", 5).select("id", "category"),
         with_([GROUND_TRUTH], f"SELECT id, category FROM (SELECT * FROM ground_truth QUALIFY row_number() OVER (PARTITION BY category ORDER BY {DRAW(42)}, id) = 1) ORDER BY {DRAW(43)}, id LIMIT 5"))

# --- foreign formats -------------------------------------------------------------------------------------------------
K = "coalesce(json_extract_string(props, '$.k'), '0')"
_LINE = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c)
_NORM = lambda df: df.select("document", "file", _LINE("line"), _LINE("cwe"), "severity", F.coalesce("rule_id", F.lit("")).alias("rule_id"))


def _docs(s, d, kind):
    return views.scanner_documents(s, d).select("document", F.col(kind).alias("value"))


register("read_semgrep_json", lambda s, d: _NORM(findings.semgrep_findings(_docs(s, d, "semgrep"), "/srv/app")),
         f"""SELECT CAST(event_id AS VARCHAR) AS document, 'src/' || event_type || '_' || {K} || '.py' AS file, CAST({K} AS INTEGER) AS line,
           CASE WHEN event_id % 3 < 2 THEN CAST({K} AS INTEGER) ELSE -1 END AS cwe, 'ERROR' AS severity, 'rule.' || event_type AS rule_id FROM events
           UNION ALL SELECT CAST(event_id AS VARCHAR), '/else/x.py', 1, -1, 'UNKNOWN', '' FROM events""")
register("read_sarif", lambda s, d: _NORM(findings.sarif_findings(_docs(s, d, "sarif"), "/srv/app")),
         f"""SELECT CAST(event_id AS VARCHAR) AS document, 'src/' || event_type || '.js' AS file, CAST({K} AS INTEGER) AS line, CAST('0' || {K} AS INTEGER) AS cwe,
           CASE WHEN event_id % 2 = 0 THEN 'ERROR' ELSE 'WARNING' END AS severity, 'r1' AS rule_id FROM events
           UNION ALL SELECT CAST(event_id AS VARCHAR), 'src/b.js', -1, CAST('0' || {K} AS INTEGER), CASE WHEN event_id % 2 = 0 THEN 'ERROR' ELSE 'WARNING' END, 'r1' FROM events
           UNION ALL SELECT CAST(event_id AS VARCHAR), 'c.js', 3, -1, 'NOTE', 'r2' FROM events""")
register("read_findings_json", lambda s, d: findings.findings_of_documents(_docs(s, d, "findings")).select(
            "repo_id", "id", "severity", "category", "file", _LINE("line"), F.coalesce("cvss_score", F.lit(-1.0)).alias("cvss_score"), "confidence", "ord"),
         f"""SELECT CAST(event_id AS VARCHAR) AS repo_id, 'X' || event_id AS id, 'HIGH' AS severity, 'XSS' AS category, event_type || '.py' AS file, CAST({K} AS INTEGER) AS line,
           CAST(7.5 AS DOUBLE) AS cvss_score, 'MEDIUM' AS confidence, 0 AS ord FROM events
           UNION ALL SELECT CAST(event_id AS VARCHAR), 'UNKNOWN', 'MEDIUM', 'Unknown', 'plain.py', -1, CAST(-1.0 AS DOUBLE), 'MEDIUM', 1 FROM events""")
register("read_envelopes", lambda s, d: findings.envelope_findings(_docs(s, d, "envelope")).select(
            "run_id", "file", _LINE("line"), _LINE("cwe"), "severity", F.coalesce("tool", F.lit("")).alias("tool"), F.coalesce("dry_run", F.lit(False)).cast("int").alias("dry_run")),
         f"""SELECT CAST(event_id AS VARCHAR) AS run_id, event_type || '.py' AS file, CASE WHEN event_id % 5 = 0 THEN CAST({K} AS INTEGER) ELSE -1 END AS line, CAST({K} AS INTEGER) AS cwe,
           CASE WHEN event_id % 5 = 0 THEN 'LOW' ELSE 'HIGH' END AS severity, CASE WHEN event_id % 5 = 0 THEN '' ELSE 't-' || event_type END AS tool,
           CAST(event_id % 5 <> 0 AS INTEGER) AS dry_run FROM events""")
_N = len(models.CATEGORY_CWE)
register("read_expected_csv", lambda s, d: labels.audit_categories(views.expected_rows(s, d)).select("id", "file", "cwe", F.col("is_vulnerable").cast("int").alias("is_vulnerable"), "category"),
         f"""SELECT 'Case' || doc_id AS id, '{models.JAVA_CASE_DIR}/Case' || doc_id || '.java' AS file, {pick([n for _, n in models.CATEGORY_CWE], f'doc_id % {_N}')} AS cwe,
           CAST(doc_id % 3 = 0 AS INTEGER) AS is_vulnerable, {pick([c for c, _ in models.CATEGORY_CWE], f'doc_id % {_N}')} AS category FROM documents""")
register("read_labelled_jsonl", lambda s, d: labels.split_labelled(views.labelled_records(s, d), views.labelled_sources(s, d))[0].select("id", "file", "cwe"),
         f"""SELECT 'CWE-0' || (doc_id % 90 + 10) || '_author_' || doc_id || '.py' AS id, '{models.PYTHON_CASE_DIR}/CWE-0' || (doc_id % 90 + 10) || '/author_' || doc_id || '.py' AS file,
           doc_id % 90 + 10 AS cwe FROM documents WHERE doc_id % 7 <> 0""")
register("missing_labelled_sources", lambda s, d: labels.split_labelled(views.labelled_records(s, d), views.labelled_sources(s, d))[1],
         "SELECT 'CWE-0' || (doc_id % 90 + 10) || '_author_' || doc_id || '.py' AS id FROM documents WHERE doc_id % 7 = 0")
register("read_fixture_labels", lambda s, d: files.read_fixture_labels(views.commented_files(s, d)).select(
            "repo_id", "file", *[F.coalesce(c, F.lit("")).alias(c) for c in ("vulnerability", "severity", "description", "secure_code", "pattern")], _LINE("cwe"),
            F.col("is_vulnerable").cast("int").alias("is_vulnerable")),
         f"""SELECT source AS repo_id, {PATH} AS file, CASE WHEN bad THEN 'Kind ' || (doc_id % 5) ELSE '' END AS vulnerability, CASE WHEN bad THEN 'HIGH' ELSE '' END AS severity,
           CASE WHEN bad THEN 'text ' || doc_id ELSE '' END AS description, CASE WHEN bad THEN '' ELSE 'Kind ' || (doc_id % 5) END AS secure_code, CASE WHEN bad THEN '' ELSE 'safe' END AS pattern,
           CASE WHEN bad THEN doc_id % 900 ELSE -1 END AS cwe, CAST(bad AS INTEGER) AS is_vulnerable FROM (SELECT *, doc_id % 3 = 0 AS bad FROM documents WHERE doc_id % 3 < 2)""")

# --- model requests and responses ------------------------------------------------------------------------------------
register("select_model", lambda s, d: model_io.select_model(views.usage_log(s, d).drop("model")).select("request_id", "task", "model"),
         with_([USAGE_LOG], f"SELECT request_id, task, {case([(f'lower(task) = {lit(t)}', lit(m)) for t, m in models.TASK_MODELS], lit(models.DEFAULT_MODEL))} AS model FROM usage_log"))
_ITEMS = ["repo_id", "file", "id", "severity", "category", "code_snippet", "description", "confidence", "ord"]
_JSON = "{{'severity': json_extract_string(j, '$.severity')}}"


def _parsed(list_sql: str) -> str:
    """Findings of the JSON lists in column `items` of `docs`."""
    get = lambda k, default: f"coalesce(json_extract_string(j, '$.{k}'), {lit(default)})"
    return f"""SELECT repo_id, path AS file, 'FIND-' || upper(substr(md5(path || ord), 1, 8)) AS id, {get('severity', 'MEDIUM')} AS severity, {get('category', 'Unknown')} AS category,
      coalesce(CAST(json_extract_string(j, '$.line') AS INTEGER), -1) AS line, coalesce(json_extract_string(j, '$.cwe'), '') AS cwe, {get('code_snippet', '')} AS code_snippet,
      {get('description', '')} AS description, coalesce(CAST(json_extract_string(j, '$.cvss_score') AS DOUBLE), -1.0) AS cvss_score, {get('confidence', 'MEDIUM')} AS confidence, ord
      FROM (SELECT repo_id, path, unnest(items) AS j, unnest(range(len(items))) AS ord FROM ({list_sql}))"""


_FLAT = lambda df: df.select(*_ITEMS, _LINE("line"), F.coalesce("cwe", F.lit("")).alias("cwe"), F.coalesce("cvss_score", F.lit(-1.0)).alias("cvss_score"))
ARRAYS = "SELECT *, json_extract(try_cast(regexp_extract(raw, '(?s)\\[.*\\]') AS JSON), '$[*]') AS items FROM model_responses WHERE json_valid(NULLIF(regexp_extract(raw, '(?s)\\[.*\\]'), ''))"
register("parse_array_response", lambda s, d: _FLAT(model_io.parse_array_response(views.model_responses(s, d))), with_([MODEL_RESPONSES], _parsed(ARRAYS)))
OBJECTS = "SELECT *, json_extract(try_cast(regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1) AS JSON), '$.findings[*]') AS items FROM model_responses WHERE regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1) <> ''"
register("parse_object_response", lambda s, d: _FLAT(model_io.parse_object_response(views.model_responses(s, d))), with_([MODEL_RESPONSES], _parsed(OBJECTS)))
register("parse_chat_envelope", lambda s, d: model_io.parse_chat_envelope(views.chat_envelopes(s, d)).select(
            "request_id", F.md5(F.coalesce("raw", F.lit(""))).alias("digest"), "total_tokens", F.coalesce("error", F.lit("")).alias("error")),
         with_([CHAT_ENVELOPES], """SELECT request_id, md5(coalesce(json_extract_string(response, '$.choices[0].message.content'), '')) AS digest,
           CASE WHEN json_extract_string(response, '$.choices[0].message.content') IS NULL THEN 0 ELSE CAST(json_extract_string(response, '$.usage.total_tokens') AS BIGINT) END AS total_tokens,
           CASE WHEN json_extract_string(response, '$.choices[0].message.content') IS NULL THEN 'Invalid response structure' ELSE '' END AS error FROM chat_envelopes"""))
_ID = case([(f"model = {lit(a)}", lit(b)) for a, b in models.MODEL_IDS], "model")
_PRICE = lambda i: case([(f"model_id = {lit(p[0])}", str(p[i])) for p in models.PRICES], "0")
COST = f"""identified AS (SELECT *, {_ID} AS model_id FROM usage_log),
costed AS (SELECT *, input_tokens / 1000000.0 * CAST({_PRICE(1)} AS DOUBLE) + output_tokens / 1000000.0 * CAST({_PRICE(2)} AS DOUBLE) AS exact FROM identified)"""
register("cost_of_request", lambda s, d: model_io.cost_of_request(views.usage_log(s, d)).select("request_id", "model_id", F.round("exact_cost", 9).alias("exact_cost")),
         with_([USAGE_LOG, COST], "SELECT request_id, model_id, round(exact, 9) AS exact_cost FROM costed"))
register("usage_totals", lambda s, d: model_io.usage_totals(views.usage_log(s, d)).withColumn("model_id", F.coalesce("model_id", F.lit("all"))),
         with_([USAGE_LOG, COST], """SELECT coalesce(model_id, 'all') AS model_id, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
           CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, round(sum(exact), 4) AS total_cost, round(sum(exact) / count(*), 4) AS average_cost_per_request FROM costed GROUP BY ROLLUP (model_id)"""))
register("last_requests", lambda s, d: model_io.last_requests(views.usage_log(s, d)).select("request_id", "model_id", "input_tokens", "output_tokens"),
         with_([USAGE_LOG, COST], "SELECT request_id, model_id, input_tokens, output_tokens FROM costed ORDER BY ts DESC, request_id LIMIT 10"))


def _merge(s, d):
    """Rule findings against model findings on the same lines: the catalogue's hits stand in for a model."""
    from codesieve.operators.vectors import scan_vectors
    from codesieve.sources.rules import default_vector_rules
    src = views.src_files(s, d)
    return merge.merge_findings(hash_findings(scan_weak_hash(src)), scan_vectors(src, default_vector_rules(s))).select("repo_id", "id", "category", "file", "line", "origin", "ord")


register("merge_findings", _merge, with_(o.vector_ctes(o.default_vectors(), o.hash_findings_ctes()) + [f"""fresh AS (SELECT * FROM (
    SELECT repo_id, {o.finding_id('VECTOR', 'path', 'line_no')} AS id, vector_name AS category, path AS file, line_no AS line, 'vector' AS origin, {o.input_order('path', '3', 'line_no', 'rule_no')} AS ord FROM vector_scan)
  QUALIFY row_number() OVER (PARTITION BY repo_id, file, line, lower(category) ORDER BY ord, id) = 1)"""],
    """SELECT repo_id, id, category, file, line, origin, ord FROM hash_findings UNION ALL
       SELECT repo_id, id, category, file, line, origin, ord FROM fresh m WHERE NOT EXISTS (SELECT 1 FROM hash_findings r WHERE r.repo_id = m.repo_id AND r.file = m.file AND r.line = m.line
         AND (lower(r.category) = lower(m.category) OR regexp_matches(lower(m.category), 'weak hash|weak crypto|md5|sha-1|sha1|cryptographic')))"""))


def score_batches(batches):
    for batch in batches:
        yield batch.assign(length=batch["raw"].str.len(), marked=batch["raw"].str.contains("severity").astype("int32"))[["request_id", "length", "marked"]]


register("score_with", lambda s, d: model_io.score_with(views.model_responses(s, d).select("request_id", "raw"), score_batches, "request_id string, length bigint, marked int"),
         with_([MODEL_RESPONSES], "SELECT request_id, length(raw) AS length, CAST(contains(raw, 'severity') AS INTEGER) AS marked FROM model_responses"))
