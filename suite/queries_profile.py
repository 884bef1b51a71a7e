"""Repository profile, and the whole analysis that uses it."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesieve.fixed import profile as fixed
from codesieve.operators import parents, profile
from codesieve.operators.model_io import build_requests
from codesieve.plans.analyze import analyze
from codesieve.sources.files import scan_context_files
from suite import oracle_scan as o
from suite import views
from suite.oracle_scan import any_like, like
from suite.oracle_views import LANGUAGE, SRC_FILES, case, lit
from suite.queries_findings import CVSS, NOISE, cascade
from suite.registry import register, with_

CTX = r"ctx AS (SELECT * FROM src_files WHERE regexp_matches(path, '\.(py|js|jsx|ts|tsx|java|go|rb|php|yml|yaml|json)$'))"


def _flag(test: str) -> str:
    return f"coalesce(bool_or({test}), false)"


def _signs() -> str:
    out = [f"{_flag(any_like('content', p))} AS fw_{name}" for name, p in fixed.FRAMEWORKS]
    for kind, patterns in fixed.TYPE_SIGNS:
        out += [f"({_flag(like('content', p))} OR bool_or({like('path', p)})) AS {kind}_{i}" for i, p in enumerate(patterns)]
    out.append(f"({_flag(like('content', fixed.ROUTE_SIGN, False))} OR bool_or({like('path', fixed.ROUTE_SIGN, False)})) AS routes")
    out.append(f"({_flag(like('content', fixed.CLIENT_SIGN, False))} OR bool_or({like('path', fixed.CLIENT_SIGN, False)})) AS client")
    out.append("bool_or(contains(path, 'setup.py') OR contains(path, 'pyproject.toml')) AS packaged")
    out.append(f"{_flag(any_like('content', fixed.SERVER_ROUTES, False))} AS server_routes")
    calls = " + ".join(f"CAST({like('content', p, False)} AS INTEGER)" for p in fixed.CLIENT_CALLS)
    out.append(f"{_flag(f'({calls}) >= 2')} AS api_client")
    out.append(f"count(*) FILTER (WHERE {any_like('content', fixed.AUTH_SIGNS)}) AS n_auth")
    out.append("count(*) AS n_files")
    return ", ".join(out)


def _score(kind: str) -> str:
    count = len(dict(fixed.TYPE_SIGNS)[kind])
    parts = [f"CAST({kind}_{i} AS INTEGER)" for i in range(count)] or ["0"]
    if kind == "web_app":
        parts += ["CASE WHEN fw_django OR fw_flask THEN 2 ELSE 0 END", "CASE WHEN fw_react OR fw_vue THEN 1 ELSE 0 END"]
    if kind == "backend_api":
        parts.append("CASE WHEN fw_fastapi THEN 2 ELSE 0 END")
    if kind == "client_sdk":
        parts.append("CASE WHEN NOT routes AND client THEN 3 ELSE 0 END")
    if kind in ("client_sdk", "library"):
        parts.append("CASE WHEN NOT routes AND packaged THEN 2 ELSE 0 END")
    return f"({' + '.join(parts)}) AS score_{kind}"


_KINDS = [k for k, _ in fixed.TYPE_SIGNS]
_NAMES = ", ".join(f"CASE WHEN fw_{n} THEN '{n}' END" for n, _ in fixed.FRAMEWORKS)
_TOP = f"greatest({', '.join(f'score_{k}' for k in _KINDS)})"
PROFILE = [
    SRC_FILES, CTX, f"signs_by_repo AS (SELECT repo_id, {_signs()} FROM ctx GROUP BY repo_id)",
    f"scored AS (SELECT *, {', '.join(_score(k) for k in _KINDS)}, coalesce(NULLIF(concat_ws(',', {_NAMES}), ''), 'none') AS frameworks FROM signs_by_repo)",
    f"profile AS (SELECT *, {case([(f'{_TOP} = 0', lit('unknown'))] + [(f'score_{k} = {_TOP}', lit(k)) for k in _KINDS])} AS codebase_type FROM scored)",
]


def ctx(s, d):
    return scan_context_files(views.src_files(s, d))


register("detect_frameworks", lambda s, d: profile.detect_frameworks(ctx(s, d)).select("repo_id", F.array_join("frameworks", ",").alias("frameworks")),
         with_(PROFILE, "SELECT repo_id, frameworks FROM profile"))
register("detect_codebase_type", lambda s, d: profile.detect_codebase_type(ctx(s, d)).withColumn("frameworks", F.array_join("frameworks", ",")),
         with_(PROFILE, f"SELECT repo_id, frameworks, {', '.join(f'score_{k}' for k in _KINDS)}, codebase_type FROM profile"))
register("server_routes_and_clients", lambda s, d: profile.has_server_routes(ctx(s, d)).join(profile.has_api_client_pattern(ctx(s, d)), "repo_id").select(
            "repo_id", F.col("has_server_routes").cast("int").alias("routes"), F.col("has_api_client_pattern").cast("int").alias("client")),
         with_(PROFILE, "SELECT repo_id, CAST(server_routes AS INTEGER) AS routes, CAST(api_client AS INTEGER) AS client FROM profile"))

_TEST = "regexp_matches(lower(path), 'test_|_test\\.|/tests/|/test/|spec\\.')"
CONTEXT = [SRC_FILES, CTX, f"""contexts AS (SELECT repo_id, path, content, {any_like('content', fixed.AUTH_SIGNS)} AS auth, {any_like('content', fixed.VALIDATION_SIGNS)} AS validation,
  {_TEST} AS is_test, (contains(lower(path), 'mock') OR contains(content, 'Mock')) AS is_mock, {like('content', fixed.EXPORTED_CALL, False)} AS exports,
  regexp_extract_all(content, {lit(fixed.CLASS_PARENTS)}, 1) AS captures,
  list_zip(regexp_extract_all(content, {lit(fixed.IMPORTS)}, 1), regexp_extract_all(content, {lit(fixed.IMPORTS)}, 2)) AS pairs FROM ctx)""",
  "parents AS (SELECT repo_id, path, trim(p) AS parent FROM (SELECT repo_id, path, unnest(string_split(array_to_string(captures, ','), ',')) AS p FROM contexts WHERE len(captures) > 0))",
  "bases AS (SELECT repo_id, path, lower(string_split(parent, '.')[-1]) AS base FROM parents)",
  """edges AS (SELECT b.repo_id, b.path, b.base, c.path AS parent_path, c.auth FROM bases b JOIN contexts c ON b.repo_id = c.repo_id AND contains(lower(c.path), b.base))"""]


def context(s, d):
    return profile.file_context(ctx(s, d))


register("file_context", lambda s, d: context(s, d).select(
            "repo_id", "path", F.array_join("parent_classes", ",").alias("parents"), F.array_join("imports", ",").alias("imports"),
            *[F.col(a).cast("int").alias(b) for a, b in (("has_auth_check", "auth"), ("has_input_validation", "validation"), ("is_test_file", "is_test"),
                                                         ("is_mock", "is_mock"), ("exports_api", "exports"))]),
         with_(CONTEXT, """SELECT repo_id, path, coalesce((SELECT string_agg(trim(x), ',') FROM (SELECT unnest(string_split(array_to_string(captures, ','), ',')) AS x WHERE len(captures) > 0)), '') AS parents,
           array_to_string([CASE WHEN p[1] <> '' THEN p[1] ELSE p[2] END for p in pairs], ',') AS imports, CAST(auth AS INTEGER) AS auth, CAST(validation AS INTEGER) AS validation,
           CAST(is_test AS INTEGER) AS is_test, CAST(is_mock AS INTEGER) AS is_mock, CAST(exports AS INTEGER) AS exports FROM contexts"""))
register("inheritance_edges", lambda s, d: parents.inheritance_edges(context(s, d)).select("repo_id", "path", "parent_path"),
         with_(CONTEXT, "SELECT repo_id, path, parent_path FROM edges"))
register("parent_has_auth", lambda s, d: parents.parent_has_auth(context(s, d)).select("repo_id", "path", F.col("parent_has_auth").cast("int").alias("parent_has_auth")),
         with_(CONTEXT, "SELECT c.repo_id, c.path, CAST(coalesce(bool_or(e.auth), false) AS INTEGER) AS parent_has_auth FROM contexts c LEFT JOIN edges e USING (repo_id, path) GROUP BY 1, 2"))
register("parent_counts", lambda s, d: parents.parent_counts(context(s, d)),
         with_(CONTEXT, "SELECT repo_id, base, count(DISTINCT parent_path) AS n_files FROM edges GROUP BY 1, 2"))


def _rarest(s, d):
    """Edges of the parent names that the fewest paths of their repository hold."""
    files = context(s, d)
    counts = parents.parent_counts(files)
    least = counts.groupBy("repo_id").agg(F.min("n_files").alias("n_files"))
    return parents.inheritance_edges(files, counts.join(least, ["repo_id", "n_files"])).select("repo_id", "path", "parent_path")


register("rarest_parents", _rarest,
         with_(CONTEXT + ["held AS (SELECT repo_id, base, count(DISTINCT parent_path) AS n FROM edges GROUP BY 1, 2)"], """SELECT repo_id, path, parent_path FROM edges
           WHERE (repo_id, base) IN (SELECT (h.repo_id, h.base) FROM held h WHERE h.n = (SELECT min(n) FROM held x WHERE x.repo_id = h.repo_id))"""))
register("auth_files", lambda s, d: profile.auth_files(context(s, d)), with_(CONTEXT, "SELECT repo_id, path FROM contexts WHERE auth"))
register("test_directories", lambda s, d: profile.test_directories(views.src_files(s, d)),
         with_([SRC_FILES], "SELECT DISTINCT repo_id, string_split(path, '/')[1] AS directory FROM src_files WHERE contains(path, '/') AND lower(string_split(path, '/')[1]) IN ('tests', 'test', 'spec', '__tests__')"))
register("lookup_file_context", lambda s, d: profile.lookup_file_context(
            views.src_files(s, d).select("repo_id", F.concat(F.lit("./"), F.col("path")).alias("path")), context(s, d)).select(
            "repo_id", "path", F.coalesce(F.col("file_context.has_auth_check").cast("int"), F.lit(-1)).alias("auth")),
         with_(CONTEXT, "SELECT f.repo_id, './' || f.path AS path, coalesce(CAST(c.auth AS INTEGER), -1) AS auth FROM src_files f LEFT JOIN contexts c USING (repo_id, path)"))
_RULES = list(fixed.RULE_DEFAULTS)
register("profile_repo", lambda s, d: profile.profile_repo(views.src_files(s, d)).select(
            "repo_id", "codebase_type", F.array_join("frameworks", ",").alias("frameworks"), "n_files", "n_auth_files", F.array_join("test_directories", ",").alias("tests"),
            *[F.col(c).cast("int").alias(c) for c in ["has_server_routes", "has_auth_middleware", "has_api_client_pattern", *_RULES]]),
         with_(PROFILE, """SELECT p.repo_id, codebase_type, frameworks, n_files, n_auth AS n_auth_files, coalesce(t.tests, '') AS tests, CAST(server_routes AS INTEGER) AS has_server_routes,
           CAST(n_auth > 0 AS INTEGER) AS has_auth_middleware, CAST(api_client AS INTEGER) AS has_api_client_pattern, CAST(codebase_type <> 'client_sdk' AS INTEGER) AS check_client_side_auth,
           CAST(codebase_type NOT IN ('client_sdk', 'library') AS INTEGER) AS flag_missing_server_auth, 0 AS flag_hardcoded_keys_in_tests, 0 AS flag_mock_without_auth,
           CAST(codebase_type <> 'client_sdk' AS INTEGER) AS deserialization_strict
           FROM profile p LEFT JOIN (SELECT repo_id, string_agg(DISTINCT string_split(path, '/')[1], ',') AS tests FROM src_files
             WHERE lower(string_split(path, '/')[1]) IN ('tests', 'test', 'spec', '__tests__') GROUP BY 1) t USING (repo_id)"""))

# The whole analysis: scan, profile, filters, scores, order.
_ALL = o.hash_findings_ctes() + o.xpath_findings_ctes()
_FINDING = "repo_id, id, severity, category, file, line, code_snippet, description, confidence, cvss_score, ord"
_UNION = f"found AS (SELECT {_FINDING} FROM hash_findings UNION ALL SELECT {_FINDING} FROM xpath_findings)"
_JOINED = "judged_findings AS (SELECT f.*, coalesce(p.codebase_type = 'client_sdk', false) AS sdk, p.codebase_type IS NOT NULL AS profiled FROM found f LEFT JOIN profile p USING (repo_id))"
register("analyze", lambda s, d: analyze(views.src_files(s, d)).select("repo_id", "id", "severity", "category", "file", "line", "confidence", "cvss_score", "ord"),
         with_(_ALL + PROFILE + [_UNION, _JOINED], f"""SELECT repo_id, id, severity, category, file, line, confidence, {CVSS} AS cvss_score, ord
           FROM judged_findings WHERE {cascade('sdk', 'sdk', 'profiled', 'profiled')} = 'kept'"""))
register("analyze_without_noise_rules", lambda s, d: analyze(views.src_files(s, d), fp_rules=[], with_profile=False, min_severity="HIGH").select(
            "repo_id", "id", "severity", "file", "line", "cvss_score"),
         with_(_ALL + [_UNION], f"""SELECT repo_id, id, severity, file, line, {CVSS} AS cvss_score FROM found
           WHERE {cascade().replace(NOISE, 'false')} = 'kept' AND severity IN ('CRITICAL', 'HIGH')"""))
register("build_requests", lambda s, d: build_requests(views.src_files(s, d), context(s, d), profile.profile_repo(views.src_files(s, d)), {"rule": "no eval"}).select(
            "repo_id", "path", F.md5("user").alias("user_digest"), F.col("system").contains("Parent class HAS authentication checks").cast("int").alias("parent_auth"),
            F.col("system").contains("client library").cast("int").alias("client"), F.col("system").contains("- Is test file: True").cast("int").alias("is_test"),
            F.regexp_extract("system", r"CODEBASE TYPE: (\w+)", 1).alias("codebase_type")),
         with_(PROFILE + CONTEXT + ["lang_of AS (SELECT *, " + LANGUAGE + " AS lang FROM src_files)",
                "inherit AS (SELECT repo_id, path, bool_or(auth) AS pa FROM edges GROUP BY 1, 2)"], """
           SELECT f.repo_id, f.path, md5('Analyze this ' || lang || ' code for security vulnerabilities:' || chr(10) || chr(10) || 'File: ' || f.path || chr(10) || chr(10) || '```' || lang || chr(10) ||
             f.content || chr(10) || '```' || chr(10)) AS user_digest, CAST(coalesce(i.pa, false) AS INTEGER) AS parent_auth, CAST(p.codebase_type = 'client_sdk' AS INTEGER) AS client,
             CAST(coalesce(c.is_test, false) AS INTEGER) AS is_test, p.codebase_type
           FROM lang_of f LEFT JOIN contexts c USING (repo_id, path) LEFT JOIN inherit i USING (repo_id, path) LEFT JOIN profile p USING (repo_id)"""))
