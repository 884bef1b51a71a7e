"""DuckDB text of the scans, line by line with windows and joins."""

from __future__ import annotations

from codesieve.fixed import texts, vectors, weak_hash, xpath
from suite.oracle_views import HTML_LINES, LINES, SRC_FILES, case, lit


def like(col: str, pattern: str, ignore_case: bool = True) -> str:
    return f"regexp_matches({col}, {lit(pattern)}, '{'i' if ignore_case else 'c'}')"


def any_like(col: str, patterns: list[str], ignore_case: bool = True) -> str:
    return "(" + " OR ".join(like(col, p, ignore_case) for p in patterns) + ")"


def matched(rows: list[tuple]) -> str:
    """List of the numbers of the matching (language, pattern) rows."""
    items = []
    for n, (language, pattern) in enumerate(rows, 1):
        test = like("line", pattern) if language == "*" else f"language = {lit(language)} AND {like('line', pattern)}"
        items.append(f"CASE WHEN {test} THEN {n} END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def lookup(index: str, values: list) -> str:
    return f"list_extract([{', '.join(lit(v) for v in values)}], {index})"


STRIP = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"


def file_no(path: str) -> str:
    return f"CAST('0x' || substr(md5(repo_id || ':' || {path}), 1, 8) AS BIGINT)"


def input_order(path: str, phase: str, line_no: str, rule_no: str) -> str:
    return f"({file_no(path)} * 2147483648 + {phase} * 536870912 + {line_no} * 256 + {rule_no})"


def finding_id(prefix: str, path: str, n: str) -> str:
    return f"'{prefix}-' || upper(substr(md5({path} || {n}), 1, 8))"


_HASH = weak_hash.WEAK_HASH_RULES + weak_hash.CONFIG_RULES


def hash_ctes(aggressive: bool = True, base: list[str] | None = None) -> list[str]:
    around = case([(like("around", p, False), lit(k)) for k, p in weak_hash.SECURITY_USAGES], "'security_general'")
    usage = case([(any_like("around", weak_hash.SECURITY_CONTEXT), around), (any_like("around", weak_hash.NON_SECURITY_CONTEXT), "'non_security'")],
                 "'unknown'")
    secure = f"CASE WHEN usage = 'unknown' THEN {str(aggressive).lower()} ELSE usage <> 'non_security' END"
    severity = "CASE WHEN NOT is_security THEN 'LOW' WHEN usage IN ('password_hashing', 'key_derivation') THEN 'CRITICAL' WHEN usage = 'unknown' THEN 'MEDIUM' ELSE 'HIGH' END"
    return (base or [SRC_FILES, LINES]) + [
        "framed AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY repo_id, path ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS context FROM lines)",
        f"hash_hits AS (SELECT *, unnest({matched([(r[0], r[1]) for r in _HASH])}) AS rule_no FROM framed)",
        "hash_around AS (SELECT *, lower(line || ' ' || context || ' ' || path) AS around FROM hash_hits)",
        f"hash_usage AS (SELECT *, {usage} AS usage FROM hash_around)",
        f"hash_secure AS (SELECT *, {secure} AS is_security FROM hash_usage)",
        f"""hash_scan AS (SELECT *, {severity} AS severity, CASE WHEN is_security THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
            {lookup('rule_no', [r[2] for r in _HASH])} AS function_name, {lookup('rule_no', [r[3] for r in _HASH])} AS algorithm, {STRIP} AS code_snippet
            FROM hash_secure {'' if aggressive else 'WHERE is_security'})""",
    ]


def _text(expr: str, table: dict) -> str:
    return case([(f"{expr} = {lit(k)}", lit(v)) for k, v in table.items() if k], lit(table.get("", "operations")))


def hash_findings_ctes() -> list[str]:
    parts = texts.HASH_DESCRIPTION.split("%s")
    description = " || ".join([lit(parts[0]), "algorithm", lit(parts[1]), "function_name", lit(parts[2]), f"({_text('usage', texts.HASH_USES)})",
                               lit(parts[3]), "algorithm", lit(parts[4])])
    return hash_ctes() + [f"""hash_findings AS (SELECT repo_id, {finding_id('CRYPTO', 'path', 'line_no')} AS id, severity, {lit(texts.HASH_CATEGORY)} AS category,
      {lit(texts.HASH_CWE)} AS cwe, {lit(texts.HASH_OWASP)} AS owasp, path AS file, line_no AS line, code_snippet, {description} AS description,
      {_text('usage', texts.HASH_IMPACTS)} AS impact, {_text('usage', texts.HASH_REMEDIES)} AS remediation, NULL::DOUBLE AS cvss_score, confidence,
      'crypto' AS origin, {input_order('path', '0', 'line_no', 'rule_no')} AS ord FROM hash_scan)"""]


def xpath_ctes(suppress: bool = True) -> list[str]:
    signs = ", ".join(f"min(CASE WHEN {like('lower(line)', p)} THEN line_no END) AS u{i}" for i, p in enumerate(xpath.USER_INPUT, 1))
    variable = [i for i, p in enumerate(xpath.USER_INPUT, 1) if "?" in p]
    texts_ = ", ".join(
        f"arg_min(regexp_extract(lower(line), {lit(xpath.USER_INPUT[i - 1])}), line_no) FILTER (WHERE {like('lower(line)', xpath.USER_INPUT[i - 1])}) AS t{i}"
        for i in variable)
    safe = f"min(CASE WHEN {any_like('lower(line)', xpath.SANITISERS)} THEN line_no END) AS safe_line"
    kind = case([
        (any_like("line", xpath.INITIALISERS, False), "NULL"),
        (any_like("line", xpath.USER_INPUT + xpath.INDIRECT_INPUT), "'user_input'"),
        (f"{any_like('line', xpath.SAFE_ASSIGNMENTS, False)} AND NOT contains(line, '\"\"') AND NOT contains(line, '''''')", "'safe'")], "'other'")
    between, before = (f"regexp_extract(line, {lit(p)}, 1)" for p in (xpath.VARIABLE_BETWEEN, xpath.VARIABLE_BEFORE))
    name = f"CASE WHEN {between} <> '' THEN {between} ELSE {before} END"
    generic = ", ".join(lit(g) for g in xpath.GENERIC_NAMES)

    def source():
        rows = []
        for i, p in enumerate(xpath.USER_INPUT, 1):
            if i in variable:
                value = f"coalesce(NULLIF(regexp_extract(lower(line), {lit(p)}), ''), t{i})"
            else:
                value = lit(p.replace("\\", "").lower())
            rows.append((f"u{i} <= line_no + 5", value))
        return case(rows, "'unknown'")

    last = "(SELECT max_by(a.kind, a.line_no) FROM assigned a WHERE a.repo_id = s.repo_id AND a.path = s.path AND a.var = s.var AND a.line_no <= s.line_no + 5 AND a.kind IS NOT NULL)"
    verdict = case([
        ("len(rule_nos) = 0", "NULL"),
        ("dyn AND san", "'dynamic_query_building/MEDIUM/MEDIUM'"), ("dyn", "'dynamic_query_building/HIGH/HIGH'"),
        ("concat AND usr AND san", "'concatenation_with_user_input/MEDIUM/MEDIUM'"), ("concat AND usr", "'concatenation_with_user_input/CRITICAL/HIGH'"),
        ("concat AND NOT san", "'concatenation/HIGH/MEDIUM'"), ("usr AND NOT san AND NOT concat", "'unsanitized_input/HIGH/MEDIUM'")])
    string = case([("san", "'xpath_query_concatenation_sanitized/LOW/LOW'"), ("usr", "'xpath_query_concatenation/HIGH/HIGH'")],
                  "'xpath_query_concatenation/MEDIUM/MEDIUM'")
    names = [r[2] for r in xpath.XPATH_RULES]
    return [SRC_FILES, LINES,
        f"""marked AS (SELECT *, {matched([(r[0], r[1]) for r in xpath.XPATH_RULES])} AS rule_nos, {any_like('line', xpath.CONCATENATION)} AS concat,
            {any_like('line', xpath.DYNAMIC_QUERY)} AS dyn, {any_like('line', xpath.QUERY_LITERALS, False)} AS literal, {name} AS name FROM lines)""",
        f"signs AS (SELECT repo_id, path, {signs}, {texts_}, {safe} FROM lines GROUP BY repo_id, path)",
        f"""suspects AS (SELECT m.*, s.* EXCLUDE (repo_id, path), CASE WHEN name <> '' AND name NOT IN ({generic}) THEN lower(name) END AS var
            FROM marked m JOIN signs s USING (repo_id, path) WHERE len(rule_nos) > 0 OR (literal AND concat))""",
        rf"assigned AS (SELECT repo_id, path, line_no, lower(unnest(regexp_extract_all(line, '\b(\w+)\s*=', 1))) AS var, {kind} AS kind FROM lines)",
        f"""judged AS (SELECT *, {last} AS last_assignment, {source()} AS user_source, coalesce(safe_line <= line_no + 5, false) AS san FROM suspects s)""",
        f"""verdicts AS (SELECT *, user_source <> 'unknown' AS usr FROM judged {"WHERE coalesce(last_assignment <> 'safe', true)" if suppress else ''})""",
        f"decided AS (SELECT *, {verdict} AS call_verdict FROM verdicts)",
        f"""xpath_rows AS (
            SELECT *, 1 AS phase, unnest(rule_nos) AS rule_no, call_verdict AS verdict FROM decided WHERE call_verdict IS NOT NULL
            UNION ALL
            SELECT *, 2, 0, {string} FROM decided WHERE call_verdict IS NULL AND literal AND concat)""",
        f"""xpath_scan AS (SELECT repo_id, path, phase, line_no, rule_no,
            CASE WHEN rule_no > 0 THEN {lookup('rule_no', names)} ELSE 'XPath query string' END AS function_name, {STRIP} AS code_snippet, user_source, san,
            string_split(verdict, '/')[1] AS pattern_type, string_split(verdict, '/')[2] AS severity, string_split(verdict, '/')[3] AS confidence,
            var, last_assignment FROM xpath_rows)"""]


def xpath_findings_ctes() -> list[str]:
    def middle(text):
        if "%s" not in text:
            return lit(" " + text)
        a, b = text.split("%s")
        return f"{lit(' ' + a)} || user_source || {lit(b)}"

    a, b = texts.XPATH_OPENING.split("%s")
    description = (f"{lit(a)} || function_name || {lit(b)} || " + "(" + case([(f"pattern_type = {lit(k)}", middle(t)) for k, t in texts.XPATH_MIDDLE.items()], "''")
                   + f") || CASE WHEN san THEN '' ELSE {lit(' ' + texts.XPATH_ENDING)} END")
    return xpath_ctes() + [f"""xpath_findings AS (SELECT repo_id, {finding_id('XPATH', 'path', 'line_no')} AS id, severity, {lit(texts.XPATH_CATEGORY)} AS category,
      {lit(texts.XPATH_CWE)} AS cwe, {lit(texts.XPATH_OWASP)} AS owasp, path AS file, line_no AS line, code_snippet, {description} AS description,
      {lit(texts.XPATH_IMPACT)} AS impact, {lit(texts.XPATH_REMEDY)} AS remediation, NULL::DOUBLE AS cvss_score, confidence, 'xpath' AS origin,
      {input_order('path', 'phase', 'line_no', 'rule_no')} AS ord FROM xpath_scan)"""]


def vector_ctes(rows: list[tuple], base: list[str]) -> list[str]:
    """rows: (vector id, name, category, cwe, owasp, severity, pattern)."""
    names = ["vector_id", "vector_name", "category_name", "cwe", "owasp", "severity"]
    fields = ", ".join(f"{lookup('rule_no', [r[i] for r in rows])} AS {n}" for i, n in enumerate(names))
    return base + [f"vector_hits AS (SELECT *, unnest({matched([('*', r[6]) for r in rows])}) AS rule_no FROM lines)",
                   f"vector_scan AS (SELECT *, {fields}, {STRIP} AS code_snippet FROM vector_hits)"]


def default_vectors() -> list[tuple]:
    names = {k: (n, o) for k, n, o in vectors.VECTOR_CATEGORIES}
    return [(v[1], v[2], names[v[0]][0], v[3], names[v[0]][1], v[4], p) for v in vectors.VECTORS for p in v[5]]


HTML_BASE = [HTML_LINES]
