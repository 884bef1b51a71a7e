"""Rule tables: the fixed ones, and those a user keeps in JSON or text files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve import schemas
from codesieve.fixed import noise, vectors, weak_hash, xpath
from codesieve.functions.text import java_regex

# A rule table is configuration: it becomes part of the query plan, so its size is checked before it is read.
MAX_RULES = 20_000


class Rule(NamedTuple):
    rule_set: str
    rule_no: int
    rule_id: str
    language: str
    pattern: str
    function_name: str
    algorithm_or_library: str


def _numbered(rule_set: str, rows: list[tuple], start: int = 1) -> list[Rule]:
    return [Rule(rule_set, n, f"{rule_set}-{n:03d}", *row) for n, row in enumerate(rows, start)]


WEAK_HASH = _numbered("hash", weak_hash.WEAK_HASH_RULES)
CONFIG = _numbered("hash", weak_hash.CONFIG_RULES, len(WEAK_HASH) + 1)
XPATH = _numbered("xpath", xpath.XPATH_RULES)


def load_weak_hash_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEAK_HASH, schemas.RULES)


def load_config_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONFIG, schemas.RULES)


def load_xpath_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(XPATH, schemas.RULES)


def load_xpath_word_lists(spark: SparkSession) -> DataFrame:
    """The ordered pattern lists that qualify an XPath hit."""
    lists = {
        "query_literal": xpath.QUERY_LITERALS, "user_input": xpath.USER_INPUT, "concatenation": xpath.CONCATENATION,
        "safe": xpath.SANITISERS, "safe_assignment": xpath.SAFE_ASSIGNMENTS,
    }
    rows = [(name, n, p) for name, patterns in lists.items() for n, p in enumerate(patterns, 1)]
    return spark.createDataFrame(rows, "list_name string, pat_idx int, pattern string")


def default_vector_rules(spark: SparkSession) -> DataFrame:
    """One row per detection pattern of the default catalogue."""
    names = {key: (name, owasp) for key, name, owasp in vectors.VECTOR_CATEGORIES}
    rows = [
        (key, names[key][0], vector_id, name, cwe, names[key][1], severity, pattern, i)
        for key, vector_id, name, cwe, severity, patterns in vectors.VECTORS
        for i, pattern in enumerate(patterns, 1)
    ]
    return spark.createDataFrame(
        [("vector", n, f"{r[2]}/{r[8]}", "*", r[7], *r[:7], None) for n, r in enumerate(rows, 1)], schemas.VECTOR_RULES
    )


def load_vector_rules(spark: SparkSession, path: str, custom: DataFrame | None = None) -> DataFrame:
    """Rules of a catalogue file, its `custom_vectors`, and a further table of vectors (columns of a catalogue vector)."""
    doc = spark.read.schema(schemas.VECTOR_CATALOGUE).json(path, multiLine=True)
    listed = doc.select(F.explode("categories").alias("category_key", "c")).select(
        "category_key", F.col("c.name").alias("category_name"), F.col("c.owasp").alias("category_owasp"),
        F.explode("c.vectors").alias("v"),
    )
    own = doc.select(
        F.lit("custom").alias("category_key"), F.lit("Custom").alias("category_name"), F.lit(None).cast("string").alias("category_owasp"),
        F.explode("custom_vectors").alias("v"),
    )
    vectors_ = listed.unionByName(own)
    if custom is not None:
        given = custom.select(F.struct(*[
            F.col(f.name) if f.name in custom.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.VECTOR
        ]).alias("v"))
        vectors_ = vectors_.unionByName(given.select(
            F.lit("custom").alias("category_key"), F.lit("Custom").alias("category_name"),
            F.lit(None).cast("string").alias("category_owasp"), "v"))
    patterns = vectors_.select(
        "*", F.posexplode("v.detection_patterns").alias("pos", "pattern")
    )
    return patterns.select(
        F.lit("vector").alias("rule_set"),
        F.lit(None).cast("int").alias("rule_no"),
        F.concat_ws("/", "v.id", (F.col("pos") + 1).cast("string")).alias("rule_id"),
        F.lit("*").alias("language"),
        "pattern",
        "category_key",
        F.coalesce("v.category", "category_name").alias("category_name"),
        F.col("v.id").alias("vector_id"),
        F.col("v.name").alias("vector_name"),
        F.col("v.cwe").alias("cwe"),
        F.coalesce("v.owasp", "category_owasp").alias("owasp"),
        F.coalesce("v.severity", F.lit("MEDIUM")).alias("severity"),
        F.col("v.test_payloads").alias("test_payloads"),
    )


def load_fp_filters(spark: SparkSession, path: str | None = None, keep_hash_patterns: bool = False) -> DataFrame:
    """Noise patterns of a text file, one per line; without a path the fixed list.

    Lines that start with `#` are comments; `keep_hash_patterns` keeps those
    that carry a suppression marker such as `# nosec`.
    """
    if path is None:
        extra = noise.NOISE_FALLBACK if keep_hash_patterns else []
        return spark.createDataFrame([(p,) for p in noise.NOISE_PATTERNS + extra], "pattern string")
    try:
        lines = spark.read.text(path)
        lines.schema
    except AnalysisException as e:
        # Only a file that is not there has a substitute; any other failure is the caller's to see.
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([(p,) for p in noise.NOISE_FALLBACK], "pattern string")
    active = ~F.col("value").startswith("#")
    if keep_hash_patterns:
        active = active | F.trim("value").isin(noise.NOISE_FALLBACK)
    text = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return lines.filter(active & (text != "")).select(text.alias("pattern"))


def load_severity_matrix(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Four dimension tables: levels, metric weights, severity by type, context multipliers."""
    doc = spark.read.schema(schemas.SEVERITY_MATRIX).json(path, multiLine=True)
    levels = doc.select(F.explode("severity_levels").alias("severity", "v")).select(
        "severity", F.col("v.cvss_range")[0].alias("cvss_min"), F.col("v.cvss_range")[1].alias("cvss_max"), "v.description",
        "v.response_time", "v.examples", "v.business_impact")
    weights = doc.select(F.explode("cvss_metrics").alias("metric", "v")).select("metric", F.explode("v").alias("value", "weight"))
    mapping = doc.select(F.explode("vulnerability_type_severity_mapping").alias("vulnerability_type", "v")).select(
        "vulnerability_type", F.explode("v").alias("condition", "severity"))
    modifiers = doc.select(F.explode("context_modifiers").alias("context", "v")).select("context", "v.multiplier", "v.description")
    return {"severity_levels": levels, "cvss_metrics": weights, "type_severity": mapping, "context_modifiers": modifiers}


def rule_rows(rules: DataFrame | list) -> list:
    """The rows of a rule table, checked to be of configuration size and to compile."""
    if isinstance(rules, DataFrame):
        rows = rules.limit(MAX_RULES + 1).collect()
        if len(rows) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules: a rule table is configuration, not data")
        return rows
    return list(rules)


def own_rules(rules: DataFrame | list) -> list[Rule]:
    """A user's rule table, numbered in its own order; without a language a rule applies everywhere."""
    if not isinstance(rules, DataFrame):
        return list(rules)
    rows = sorted(rule_rows(rules), key=lambda r: (r["rule_no"] or 0, r["rule_id"]))
    return [Rule(r["rule_set"], n, r["rule_id"], r["language"] or "*", r["pattern"], r["function_name"], r["algorithm_or_library"])
            for n, r in enumerate(rows, 1)]


def check_rules(spark: SparkSession, rules: DataFrame | list) -> DataFrame:
    """Rules with the pattern as the JVM reads it and a flag whether it compiles."""
    rows = []
    for r in rule_rows(rules):
        text = java_regex(r["pattern"] if not isinstance(r, Rule) else r.pattern)
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(text)
            ok = True
        except Exception:
            ok = False
        rows.append((r["rule_id"] if not isinstance(r, Rule) else r.rule_id, text, ok))
    return spark.createDataFrame(rows, "rule_id string, java_pattern string, compiles boolean")
