"""False-positive filters. Every drop has a name, so that it can be counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.fixed import noise
from codesieve.fixed import severity as fixed
from codesieve.functions.paths import is_test_file
from codesieve.functions.severity import severity_rank
from codesieve.functions.text import any_of, has_any, matches

FLAGS = ["check_client_side_auth", "flag_hardcoded_keys_in_tests", "flag_mock_without_auth", "deserialization_strict"]


def drop_low_confidence(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("confidence").eqNullSafe("LOW"))


def noise_condition(fp_rules: DataFrame | list[str] | None) -> Column:
    """True where one of the noise patterns matches the snippet."""
    if fp_rules is None:
        patterns = noise.NOISE_PATTERNS
    elif isinstance(fp_rules, list):
        patterns = fp_rules
    else:
        from codesieve.sources.rules import rule_rows
        patterns = [r["pattern"] for r in rule_rows(fp_rules)]
    if not patterns:
        return F.lit(False)
    return matches(F.coalesce("code_snippet", F.lit("")), any_of(patterns))


def fp_regex_filter(findings: DataFrame, fp_rules=None) -> DataFrame:
    return findings.filter(~noise_condition(fp_rules))


def framework_condition() -> Column:
    file, snippet, category = _text("file"), _text("code_snippet"), _text("category")

    def protected(upper, lower, name, sign):
        return (file.contains(upper) | snippet.contains(lower)) & (category == name) & snippet.contains(sign)

    return protected("Django", "django", "SQL Injection", ".objects.") | protected("Flask", "flask", "XSS", "render_template")


def framework_filter(findings: DataFrame) -> DataFrame:
    return findings.filter(~framework_condition())


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# Columns that the conditions read in lower case; they are folded once per row.
LOWERED = ["category", "description", "code_snippet", "file"]


def context_conditions(flag) -> list[tuple[str, Column]]:
    """(reason, condition) in the order they are tried; `flag(name)` gives a security rule of the repository."""
    c, t, n, f = (F.col(f"_low_{x}") for x in LOWERED)
    client = ~flag("check_client_side_auth")
    relaxed = ~flag("deserialization_strict")
    mocks = ~flag("flag_mock_without_auth")
    has = lambda col, *words: has_any(col, list(words))
    auth_category = has(c, "authentication", "authorization")
    inherited = has(c, "deserialization", "sensitive data")
    return [
        ("sdk_missing_auth", client & has_any(c, noise.MISSING_AUTH_CATEGORIES) & has(t, "missing", "does not")),
        ("sdk_endpoint_exposure", client & has(c, "sensitive data exposure") & (has(t, "api endpoint") | has(n, "endpoint"))
         & has(t, "without") & has(t, "auth", "check")),
        ("benign_deserialisation", relaxed & has(c, "deserialization") & ~has_any(n, noise.DANGEROUS_LOADERS)),
        ("is_auth_check", matches(n, any_of(noise.AUTH_CHECK_PATTERNS), False) & auth_category),
        ("pem_loading", relaxed & has(c, "sensitive data", "exposure") & has(n, "pem", "private_key", "api_secret")
         & has(n, "load", "serialize")),
        ("logging", has(c, "insufficient logging") | has(t, "no logging")),
        ("sdk_public_endpoint", client & has(c, "misconfiguration") & (has(t, "public") | has(n, "endpoint"))),
        ("mock_server", mocks & has(f, "mock", "test") & (has(c, "websocket") | has(n, "handler"))),
        ("docstring_param", has(c, "sensitive data") & (has(n, "optional (str)") | (has(n, "**") & has(n, "param")))),
        ("docstring_key", has(c, "sensitive data") & has(n, "- **api_key", "- **api_secret")),
        ("super_init", inherited & has(n, "super().__init__(**")),
        ("kwargs", inherited & has(n, "**kwargs") & ~has(n, "setattr")),
        ("uuid_session", has(c, "session", "authentication") & (has(n, "uuid") | has(t, "uuid4")) & ~has(n, "predictable")),
        ("auth_test", is_test_file(_text("file")) & auth_category & (has(n, "subscribe") | has(t, "unauthenticated"))),
        ("ci_secret_reference", has(f, ".github", ".yml") & has(n, "secrets.")),
        ("sdk_rate_limit", client & has(c, "api") & has(t, "rate", "limit")),
    ]


def test_file_conditions(flag) -> list[tuple[str, Column]]:
    in_test = is_test_file(_text("file"))
    fixture = F.col("_low_description").contains("hardcoded") | F.col("_low_code_snippet").contains("test")
    return [
        ("test_low_severity", in_test & F.col("severity").isin("LOW", "INFO")),
        ("test_fixture", in_test & ~flag("flag_hardcoded_keys_in_tests") & fixture),
    ]


def _with_flags(findings: DataFrame, repo_profile: DataFrame | None):
    """Findings with their repository's security rules; without a profile every rule holds."""
    if repo_profile is None:
        return findings, lambda name: F.lit(True)
    rules = repo_profile.select("repo_id", F.struct(*FLAGS).alias("_rules"))
    return findings.join(rules, "repo_id", "left"), lambda name: F.coalesce(F.col(f"_rules.{name}"), F.lit(True))


def _first_reason(conditions: list[tuple[str, Column]]) -> Column:
    return reduce(lambda out, c: F.when(c[1], c[0]) if out is None else out.when(c[1], c[0]), conditions, None)


def _keep(findings: DataFrame, repo_profile, conditions, explain: bool = False) -> DataFrame:
    joined, flag = _with_flags(findings, repo_profile)
    folded = joined.withColumns({f"_low_{x}": F.lower(_text(x)) for x in LOWERED})
    reasoned = folded.withColumn("drop_reason", _first_reason(conditions(flag))).drop("_rules", *[f"_low_{x}" for x in LOWERED])
    return reasoned if explain else reasoned.filter(F.col("drop_reason").isNull()).drop("drop_reason")


def context_filter(findings: DataFrame, repo_profile: DataFrame | None = None) -> DataFrame:
    return _keep(findings, repo_profile, context_conditions)


def test_file_filter(findings: DataFrame, repo_profile: DataFrame | None = None) -> DataFrame:
    return _keep(findings, repo_profile, test_file_conditions)


def fp_cascade(findings: DataFrame, fp_rules=None, repo_profile: DataFrame | None = None, explain: bool = False) -> DataFrame:
    """All filters in order. With `explain` all rows stay and carry the reason of their first drop."""
    def conditions(flag):
        return [
            ("low_confidence", F.col("confidence").eqNullSafe("LOW")),
            ("noise_pattern", noise_condition(fp_rules)),
            ("framework", framework_condition()),
            *context_conditions(flag),
            *test_file_conditions(flag),
        ]
    return _keep(findings, repo_profile, conditions, explain)


def _threshold(min_severity: str) -> int:
    if min_severity not in fixed.SEVERITIES:
        raise ValueError(f"unknown severity {min_severity!r}")
    return fixed.SEVERITIES.index(min_severity)


def filter_by_severity(findings: DataFrame, min_severity: str = "MEDIUM") -> DataFrame:
    """Findings at or above a severity; an unknown severity is dropped."""
    return findings.filter(F.col("severity").isin(fixed.SEVERITIES[: _threshold(min_severity) + 1]))


def filter_by_severity_strict(findings: DataFrame, min_severity: str) -> DataFrame:
    """The same, but an unknown severity fails the job."""
    limit, rank = _threshold(min_severity), severity_rank(F.col("severity"))
    problem = F.raise_error(F.concat(F.lit("unknown severity "), F.coalesce(F.col("severity"), F.lit("null"))))
    return findings.filter(F.when(rank < fixed.UNKNOWN_RANK, rank <= limit).otherwise(problem.cast("boolean")))
