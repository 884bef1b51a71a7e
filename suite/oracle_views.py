"""The same input tables in DuckDB SQL."""

from __future__ import annotations

from suite import idioms


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def pick(values: list, index: str) -> str:
    return f"list_extract([{', '.join(lit(v) for v in values)}], ({index}) + 1)"


def number(*parts: str) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 15) AS BIGINT)"


def case(pairs, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in pairs) + f" ELSE {default} END"


PATH = (f"{pick(idioms.DIRECTORIES, f'doc_id % {len(idioms.DIRECTORIES)}')} || '/' || CASE WHEN doc_id % 5 = 0 THEN 'test_' ELSE '' END || 'doc_' || "
        f"doc_id || {pick(idioms.SUFFIXES, f'doc_id % {len(idioms.SUFFIXES)}')}")

_IDIOM = pick(idioms.IDIOMS, f"doc_id % {len(idioms.IDIOMS)}")
_CWE = f"NULLIF({pick(idioms.IDIOM_CWE, f'doc_id % {len(idioms.IDIOMS)}')}, 0)"
_LINES = "len(string_split(text, chr(10)))"
_SAID = "regexp_replace(text, '[^A-Za-z0-9 .,]', '', 'g')"

SRC_FILES = f"""src_files AS (
  SELECT source AS repo_id, {PATH} AS path,
         text || chr(10) || {_IDIOM} || chr(10) || string_split(text, chr(10))[1] AS content
  FROM documents)"""

# One row per line of the files that are not blank, with the rule-set language.
LANGUAGE = case([
    ("path LIKE '%.py'", "'Python'"), ("path LIKE '%.js'", "'JavaScript'"), ("path LIKE '%.jsx'", "'React/JSX'"), ("path LIKE '%.ts'", "'TypeScript'"),
    ("path LIKE '%.tsx'", "'TypeScript/React'"), ("path LIKE '%.java'", "'Java'"), ("path LIKE '%.go'", "'Go'"), ("path LIKE '%.rb'", "'Ruby'"),
    ("path LIKE '%.php'", "'PHP'"), ("path LIKE '%.yml'", "'YAML'"), ("path LIKE '%.yaml'", "'YAML'"), ("path LIKE '%.cs'", "'CSharp'"),
    ("path LIKE '%Dockerfile%'", "'Docker'")], "'Unknown'")
KEY = case([
    ("lang IN ('JavaScript', 'TypeScript', 'React/JSX', 'TypeScript/React')", "'javascript'"), ("lang = 'Ruby'", "'ruby'"), ("lang = 'CSharp'", "'csharp'")],
    "lower(lang)")
LINES = f"""lang_files AS (SELECT *, {LANGUAGE} AS lang FROM src_files WHERE regexp_matches(content, '\\S')),
key_files AS (SELECT *, {KEY} AS language FROM lang_files),
lines AS (
  SELECT repo_id, path, language, unnest(string_split(content, chr(10))) AS line,
         unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no
  FROM key_files)"""

_TYPES = {i: case([(f"p_type = {lit(r[0])}", lit(r[i])) for r in idioms.CATEGORIES]) for i in (1, 2, 3)}
_NUMBER = number("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(round(l_extendedprice * 100) AS BIGINT)")
FINDINGS = f"""findings AS (
  SELECT 'repo' || l_suppkey || '-' || (l_partkey % 8) AS repo_id, 'F-' || {_NUMBER} AS id,
         {case([(f"l_returnflag = '{a}' AND l_linestatus = '{b}'", lit(s)) for a, b, s in idioms.SEVERITIES], "'UNRATED'")} AS severity,
         {_TYPES[1]} AS category, {_TYPES[2]} AS cwe, {_TYPES[3]} AS owasp,
         {pick(idioms.DIRECTORIES, f'l_partkey % {len(idioms.DIRECTORIES)}')} || '/' || CASE WHEN l_partkey % 9 = 0 THEN 'test_' ELSE '' END || 'part_' ||
           (l_partkey % 40) || '.py' AS file,
         CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS line,
         {pick(idioms.SNIPPETS, f'l_orderkey % {len(idioms.SNIPPETS)}')} AS code_snippet,
         {pick(idioms.DESCRIPTIONS, f'l_partkey % {len(idioms.DESCRIPTIONS)}')} AS description,
         'impact' AS impact, 'remedy' AS remediation,
         CASE WHEN l_tax <> 0 THEN round(l_discount * 100, 1) END AS cvss_score,
         {pick(['HIGH', 'MEDIUM', 'LOW'], 'l_linenumber % 3')} AS confidence, {_NUMBER} AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

GROUND_TRUTH = f"""ground_truth AS (
  SELECT 'gt' || doc_id AS id, {PATH} AS file, {_CWE} AS cwe, (toxic = 1 OR doc_id % 3 <> 0) AS is_vulnerable,
         CASE WHEN doc_id % 2 = 0 THEN {_LINES} + 2 END AS line, {pick(idioms.DIRECTORIES, f'doc_id % {len(idioms.DIRECTORIES)}')} AS category
  FROM documents JOIN labels USING (doc_id))"""

NORM_FINDINGS = f"""norm_findings AS (
  SELECT 'run' || run AS run_id, {pick(['./', '/srv/corpus/', '', 'corpus' + chr(92)], 'doc_id % 4')} || {PATH} AS file,
         CASE WHEN doc_id % 6 <> 1 THEN {_LINES} + doc_id % 8 END AS line,
         CASE WHEN doc_id % 10 = 0 THEN 20 ELSE {_CWE} END AS cwe, 'HIGH' AS severity, 'rule' AS rule_id
  FROM documents, (SELECT unnest(range({idioms.RUNS})) AS run) r
  WHERE doc_id % (run + 4) <> 0 AND doc_id % 13 <> 0)"""

USAGE_LOG = f"""usage_log AS (
  SELECT event_id AS request_id, ts, {case([(f"event_type = '{k}'", lit(m)) for k, m in idioms.MODELS])} AS model,
         CAST(floor(value * 10) AS BIGINT) AS input_tokens,
         coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS output_tokens, {pick(idioms.TASKS, f'event_id % {len(idioms.TASKS)}')} AS task
  FROM events)"""

MODEL_RESPONSES = f"""model_responses AS (
  SELECT conv_id || '-' || turn AS request_id, 'r' || (conv_id % 10) AS repo_id, 'chat/' || conv_id || '_' || turn || '.py' AS path,
         CASE WHEN conv_id % 3 = 0 THEN 'Result:' || chr(10) || '[{{"severity":"HIGH","category":"XSS","line":' || (turn + 1) || ',"description":"' || {_SAID} ||
                '"}},{{"category":"SQL Injection","cwe":"CWE-89","cvss_score":8.5}}]' || chr(10) || 'Done.'
              WHEN conv_id % 3 = 1 THEN 'Here:' || chr(10) || '```json' || chr(10) || '{{"findings":[{{"severity":"LOW","category":"Weak crypto","line":' || (turn + 1) ||
                ',"code_snippet":"x = 1","confidence":"HIGH","description":"' || {_SAID} || '"}}]}}' || chr(10) || '```' || chr(10) || 'End'
              ELSE 'Sorry [ {{"severity": ' || {_SAID} END AS raw
  FROM conversations WHERE role = 'assistant')"""

CHAT_ENVELOPES = f"""chat_envelopes AS (
  SELECT conv_id || '-' || turn AS request_id,
         CASE WHEN conv_id % 4 = 0 THEN '{{"usage":{{"total_tokens":5}}}}'
              ELSE '{{"choices":[{{"message":{{"content":"' || {_SAID} || '"}}}}],"usage":{{"total_tokens":' || length({_SAID}) || '}}}}' END AS response
  FROM conversations WHERE role = 'assistant')"""

FILE_RUNS = f"""file_runs AS (
  SELECT doc_id // 5 AS batch_id, {PATH} AS path, doc_id % 3 AS findings, n_chars / 1000.0 AS seconds FROM documents)"""

HTML_LINES = """lines AS (
  SELECT 'web' AS repo_id, page_id || '.html' AS path, '*' AS language, unnest(string_split(html, chr(10))) AS line,
         unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line_no
  FROM pages WHERE regexp_matches(html, '\\S'))"""
