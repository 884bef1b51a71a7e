"""Rule findings of a file set, all families in one pass over the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve import schemas
from codesieve.functions.severity import crypto_confidence, crypto_severity
from codesieve.functions.text import strip
from codesieve.operators import vectors, weak_hash, xpath
from codesieve.operators.scan import context_window, prepare, rule_column, rule_hits
from codesieve.sources.rules import CONFIG, WEAK_HASH, XPATH, own_rules

HASH, CALL, VECTOR = "hash", "xpath", "vector"


def _event(hit: Column, family: str, context: Column) -> Column:
    """A hit in the shape of an XPath hit, so that both leave the file together."""
    empty = dict(is_string="boolean", concat="boolean", dynamic="boolean", var="string", user_source="string", sanitised="boolean", last_assignment="string")
    return F.struct(
        hit.line_no.alias("line_no"), hit.line.alias("line"), hit.rule_nos.alias("rule_nos"),
        *[F.lit(None).cast(t).alias(n) for n, t in empty.items()], F.lit(family).alias("family"), context.alias("context"))


def _by_family(**values: Column) -> Column:
    out = None
    for family, value in values.items():
        out = F.when(F.col("family") == family, value) if out is None else out.when(F.col("family") == family, value)
    return out


def scan_specialized(src_files: DataFrame, rules=None, aggressive: bool = True, vector_rules: DataFrame | None = None) -> DataFrame:
    """Weak-hash findings, XPath findings, and those of a vector catalogue if one is given.

    `rules` may hold a user's own weak-hash and XPath rule tables under the
    keys "hash" and "xpath".  Each file is read, folded and split once, and
    judged inside its row; nothing is shuffled.
    """
    rules = rules or {}
    hash_rules = own_rules(rules["hash"]) if rules.get("hash") is not None else WEAK_HASH + CONFIG
    xpath_rules = own_rules(rules["xpath"]) if rules.get("xpath") is not None else XPATH
    catalogue = vectors.numbered_vectors(vector_rules) if vector_rules is not None else []

    files = prepare(src_files, xpath_rules, live_hash=hash_rules, live_vector=catalogue)
    files = files.withColumn("hash_hits", rule_hits(hash_rules, "live_hash")).withColumn("vector_hits", rule_hits(catalogue, "live_vector"))
    none = F.array().cast(xpath.HIT_ARRAY)
    others = F.concat(
        F.coalesce(F.transform("hash_hits", lambda h: _event(h, HASH, context_window(F.col("lines"), h.line_no))), none),
        F.coalesce(F.transform("vector_hits", lambda h: _event(h, VECTOR, F.lit(None).cast("string"))), none))
    lines = xpath.file_hits(xpath.candidates(files.withColumn("others", others), xpath_rules))
    lines = xpath.safe_reassignment(lines)

    verdict = F.lit(None).cast("struct<pattern_type:string,severity:string,confidence:string>")
    plain = lambda phase: F.transform("rule_nos", lambda n: F.struct(
        F.lit(phase).alias("phase"), n.alias("rule_no"), verdict.alias("verdict")))
    entries = _by_family(hash=plain(weak_hash.PHASE), vector=plain(vectors.PHASE), xpath=xpath.verdict_entries())
    rows = lines.select("*", F.explode_outer(entries).alias("entry")).filter(F.col("entry").isNotNull())
    rows = weak_hash.classify_usage(rows.select("*", "entry.*").drop("entry"), aggressive)
    if not aggressive:
        rows = rows.filter((F.col("family") != HASH) | F.col("is_security"))

    rule_no, secure = F.col("rule_no"), F.col("is_security")
    rows = rows.withColumn("algorithm", rule_column(hash_rules, rule_no, "algorithm_or_library"))
    vector_columns = {f: rule_column(catalogue, rule_no, f) for f in vectors.FIELDS}
    rows = rows.select(
        "repo_id", "path", "family", "phase", "line_no", "line", "rule_no", "usage", "algorithm", "user_source",
        F.col("sanitised").alias("has_sanitization"), F.col("verdict.pattern_type").alias("pattern_type"), strip(F.col("line")).alias("code_snippet"),
        _by_family(hash=rule_column(hash_rules, rule_no, "function_name"), xpath=xpath.function_of(xpath_rules, rule_no)).alias("function_name"),
        _by_family(hash=crypto_severity(secure, F.col("usage")), xpath=F.col("verdict.severity"), vector=vector_columns["severity"]).alias("severity"),
        _by_family(hash=crypto_confidence(F.col("algorithm"), secure), xpath=F.col("verdict.confidence")).alias("confidence"),
        *[c.alias(f) for f, c in vector_columns.items() if f != "severity"])
    families = {HASH: weak_hash.finding_columns(), CALL: xpath.finding_columns()}
    if catalogue:
        families[VECTOR] = vectors.finding_columns()
    found = F.struct(*[_by_family(**{f: columns[name] for f, columns in families.items()}).alias(name) for name in schemas.FINDING_COLUMNS])
    # Unpacked from a one-element array: filters on a finding then run after it is built, instead of building it twice.
    return rows.select(F.explode(F.array(found)).alias("found")).select("found.*")
