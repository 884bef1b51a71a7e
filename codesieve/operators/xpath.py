"""XPath injection: calls, query strings, and reassignment of the concatenated variable.

The context of a hit is everything up to five lines below it.  Reading that
text again for every hit would be quadratic in the file, so each sign is
located once per file: it lies in the context of line n iff its first line is
at most n + 5.  No sign spans a line break, which makes this exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.fixed import texts
from codesieve.fixed import xpath as fixed
from codesieve.functions.identity import finding_id, input_order
from codesieve.functions.text import any_of, first_line_of, java_regex, matches, sql_matches, strip
from codesieve.operators.scan import matched_rules, prepare, rule_column
from codesieve.sources.rules import XPATH, own_rules

LOOK_AHEAD = 5
CALLS, STRINGS = 1, 2


def _variable(line: Column) -> Column:
    """Lower-cased name of the concatenated variable, null if there is none worth following."""
    between = F.regexp_extract(line, java_regex(fixed.VARIABLE_BETWEEN, False), 1)
    before = F.regexp_extract(line, java_regex(fixed.VARIABLE_BEFORE, False), 1)
    name = F.when(between != "", between).otherwise(before)
    return F.when((name != "") & ~name.isin(fixed.GENERIC_NAMES), F.lower(name))


def _assignment_kind(line: Column) -> Column:
    """What a line assigns: safe, user_input or other; null if it only initialises."""
    safe = matches(line, any_of(fixed.SAFE_ASSIGNMENTS), False) & ~line.contains('""') & ~line.contains("''")
    user = matches(line, any_of(fixed.USER_INPUT + fixed.INDIRECT_INPUT))
    return F.when(
        ~matches(line, any_of(fixed.INITIALISERS), False),
        F.when(user, "user_input").when(safe, "safe").otherwise("other"),
    )


def _plain_text(pattern: str) -> str | None:
    """The only text a user-input pattern can match, or None if there are several."""
    return None if "?" in pattern else pattern.replace("\\", "").lower()


def _user_source(index: Column, line: Column, first_texts: Column) -> Column:
    """The matched text of the first user-input pattern that occurs."""
    plain = F.element_at(F.array(*[F.lit(_plain_text(p)) for p in fixed.USER_INPUT]), index)
    variable = [(i, p) for i, p in enumerate(fixed.USER_INPUT, 1) if _plain_text(p) is None]
    here = None
    for slot, (i, p) in enumerate(variable):
        on_line = F.nullif(F.regexp_extract(F.lower(line), java_regex(p), 0), F.lit(""))
        value = F.coalesce(on_line, first_texts[slot])
        here = F.when(index == i, value) if here is None else here.when(index == i, value)
    return F.coalesce(here, plain, F.lit("unknown"))


def candidates(files: DataFrame, rules: list) -> DataFrame:
    """Per file, the lines that match a call rule or hold a concatenated query literal."""
    line = "get(lines, i)"
    literal = (f"(contains(low, '//') or contains(low, '@')) and {sql_matches(line, any_of(fixed.QUERY_LITERALS), False)} "
               f"and {sql_matches(line, any_of(fixed.CONCATENATION))}")
    entry = (f"named_struct('line_no', i + 1, 'line', {line}, 'rule_nos', "
             f"if(size(live) > 0, {matched_rules(rules)}, live), 'is_string', {literal})")
    possible = "size(live) > 0 or contains(folded, '//') or contains(folded, '@')"
    found = f"filter(transform(lows, (low, i) -> {entry}), c -> size(c.rule_nos) > 0 or c.is_string)"
    return files.withColumn("found", F.expr(f"if({possible}, {found}, null)"))


def file_hits(files: DataFrame) -> DataFrame:
    """One row per hit of a file, with the last assignment of its variable.

    Hits of other rule families, in the column `others`, are passed along. Nothing is shuffled.
    """
    if "others" not in files.columns:
        files = files.withColumn("others", F.array().cast(HIT_ARRAY))
    folded, lines = F.col("folded"), F.col("lines")
    shown = F.transform("found", lambda c: F.struct(
        c.line_no.alias("line_no"), c.line.alias("line"), c.rule_nos.alias("rule_nos"), c.is_string.alias("is_string"),
        matches(c.line, any_of(fixed.CONCATENATION)).alias("concat"),
        matches(c.line, any_of(fixed.DYNAMIC_QUERY)).alias("dynamic"),
        _variable(c.line).alias("var"),
        F.least(c.line_no + LOOK_AHEAD, F.size(lines)).alias("last_line"),
    ))
    variable = [p for p in fixed.USER_INPUT if _plain_text(p) is None]
    some = F.size("found") > 0
    files = files.select(
        "repo_id", "path", "lines", "others",
        F.when(some, shown).alias("found"),
        F.when(some, F.expr(f"array({', '.join(first_line_of('folded', p) for p in fixed.USER_INPUT)})")).alias("user_lines"),
        F.when(some, F.array(*[F.regexp_extract(folded, java_regex(p), 0) for p in variable])).alias("user_texts"),
        F.when(some, F.expr(first_line_of("folded", any_of(fixed.SANITISERS)))).alias("safe_line"),
    )
    numbers = F.array(*[F.lit(i) for i in range(1, len(fixed.USER_INPUT) + 1)])

    def hit(c):
        seen = F.filter(numbers, lambda k: F.element_at("user_lines", k) <= c.last_line)
        index = F.get(seen, F.lit(0))
        return F.struct(
            c.line_no.alias("line_no"), c.line.alias("line"), c.rule_nos.alias("rule_nos"), c.is_string.alias("is_string"),
            c.concat.alias("concat"), c.dynamic.alias("dynamic"), c["var"].alias("var"),
            _user_source(index, c.line, F.col("user_texts")).alias("user_source"),
            F.coalesce(F.col("safe_line") <= c.last_line, F.lit(False)).alias("sanitised"),
            F.lit(None).cast("string").alias("last_assignment"),
            F.lit("xpath").alias("family"), F.lit(None).cast("string").alias("context"),
        )

    used = F.array_distinct(F.filter(F.transform("found", lambda c: c["var"]), lambda v: v.isNotNull()))
    files = files.select("repo_id", "path", "lines", "others", F.transform("found", hit).alias("hits"), used.alias("used"))

    def assigned(line):
        names = F.regexp_extract_all(line, F.lit(java_regex(r"\b(\w+)\s*=", False)), 1)
        return F.array_intersect(F.transform(names, F.lower), F.col("used"))

    targets = F.filter(
        F.transform("lines", lambda line, i: F.struct(
            (i + 1).cast("int").alias("line_no"),
            line.alias("line"),
            F.when(line.contains("="), assigned(line)).otherwise(F.array().cast("array<string>")).alias("names"))),
        lambda t: F.size(t.names) > 0,
    )
    files = files.withColumn("targets", F.when(F.size("used") > 0, targets))
    assignments = F.flatten(F.transform("targets", lambda t: F.transform(t.names, lambda name: F.struct(
        name.alias("var"), t.line_no.alias("upto"), F.lit(-1).alias("hit"), _assignment_kind(t.line).alias("kind")))))
    uses = F.transform("hits", lambda h, i: F.struct(
        h["var"].alias("var"), (h.line_no + LOOK_AHEAD).alias("upto"), i.alias("hit"), F.lit(None).cast("string").alias("kind")))
    files = with_last_assignment(files.select("repo_id", "path", "others", "hits", F.filter(assignments, lambda a: a.kind.isNotNull()).alias("assignments"), uses.alias("uses")))
    none = F.array().cast(HIT_ARRAY)
    hits = F.zip_with("hits", "last", lambda h, r: h.withField("last_assignment", r.kind))
    found = F.concat(F.coalesce(hits, none), F.coalesce("others", none))
    return files.select("repo_id", "path", F.explode(found).alias("e")).select("repo_id", "path", "e.*")


def with_last_assignment(files: DataFrame) -> DataFrame:
    """Adds `last`: (hit, kind) of each of `uses`, the kind of the latest of `assignments` to its variable up to its line.

    Both lists are sorted as one, by (variable, line). The j-th use, found at place i, has i - j assignments before it, and
    only the last of these can be its variable's. So a file costs one sort, however many hits and assignments it has.
    """
    merged = F.array_sort(F.concat(F.coalesce("assignments", F.array().cast(_USES)), "uses"))
    files = files.withColumn("merged", F.when(F.col("hits").isNotNull(), merged))
    places = F.filter(F.transform("merged", lambda e, i: F.struct(e["var"].alias("var"), e.hit.alias("hit"), i.alias("at"))), lambda e: e.hit >= 0)
    files = files.withColumns({"places": places, "given": F.filter("merged", lambda e: e.hit < 0)})

    def before(use, j):
        last = F.get("given", use["at"] - j - 1)
        return F.struct(use.hit.alias("hit"), F.when(F.get("given", use["at"] - j - 1)["var"] == use["var"], last.kind).alias("kind"))

    return files.withColumn("last", F.array_sort(F.transform("places", before))).drop("merged", "places", "given")


_USES = "array<struct<var:string,upto:int,hit:int,kind:string>>"
HIT_ARRAY = (
    "array<struct<line_no:int,line:string,rule_nos:array<int>,is_string:boolean,concat:boolean,dynamic:boolean,var:string,"
    "user_source:string,sanitised:boolean,last_assignment:string,family:string,context:string>>"
)


def find_xpath_lines(src_files: DataFrame, rules=None) -> DataFrame:
    """One row per suspicious line with its signs and the last assignment of its variable; found inside the file's row."""
    rules = XPATH if rules is None else own_rules(rules)
    return file_hits(candidates(prepare(src_files, rules), rules)).drop("family", "context")


def safe_reassignment(hits: DataFrame) -> DataFrame:
    """Drop hits whose variable was last given a constant."""
    return hits.filter(F.coalesce(F.col("last_assignment") != "safe", F.lit(True)))


def _call_verdict() -> Column:
    """Pattern type, severity and confidence of a call, null if it is harmless."""
    user, clean = F.col("user_source") != "unknown", F.col("sanitised")
    concat = F.col("concat")

    def verdict(kind, severity, confidence):
        return F.struct(F.lit(kind).alias("pattern_type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))

    return (
        F.when(F.col("dynamic") & clean, verdict("dynamic_query_building", "MEDIUM", "MEDIUM"))
        .when(F.col("dynamic"), verdict("dynamic_query_building", "HIGH", "HIGH"))
        .when(concat & user & clean, verdict("concatenation_with_user_input", "MEDIUM", "MEDIUM"))
        .when(concat & user, verdict("concatenation_with_user_input", "CRITICAL", "HIGH"))
        .when(concat & ~clean, verdict("concatenation", "HIGH", "MEDIUM"))
        .when(user & ~clean & ~concat, verdict("unsanitized_input", "HIGH", "MEDIUM"))
    )


def _string_verdict() -> Column:
    user, clean = F.col("user_source") != "unknown", F.col("sanitised")

    def verdict(kind, severity):
        return F.struct(F.lit(kind).alias("pattern_type"), F.lit(severity).alias("severity"), F.lit(severity).alias("confidence"))

    return (
        F.when(clean, verdict("xpath_query_concatenation_sanitized", "LOW"))
        .when(user, verdict("xpath_query_concatenation", "HIGH"))
        .otherwise(verdict("xpath_query_concatenation", "MEDIUM"))
    )


def verdict_entries() -> Column:
    """What a line is reported for: (phase, rule, verdict) of each of its calls, or of its query string."""
    def entry(phase, rule_no, verdict):
        return F.struct(F.lit(phase).alias("phase"), rule_no.alias("rule_no"), verdict.alias("verdict"))

    call = F.when(F.size("rule_nos") > 0, _call_verdict())
    calls = F.transform("rule_nos", lambda n: entry(CALLS, n, call))
    return F.when(call.isNotNull(), calls).when(F.col("is_string"), F.array(entry(STRINGS, F.lit(0), _string_verdict())))


def function_of(rules: list, rule_no: Column) -> Column:
    return F.when(rule_no > 0, rule_column(rules, rule_no, "function_name")).otherwise(texts.XPATH_STRING_NAME)


def scan_xpath(src_files: DataFrame, rules=None, suppress: bool = True) -> DataFrame:
    """Calls (phase 1), then query strings on lines without a vulnerable call (phase 2)."""
    rules = XPATH if rules is None else own_rules(rules)
    lines = find_xpath_lines(src_files, rules)
    if suppress:
        lines = safe_reassignment(lines)
    rows = lines.select("*", F.explode_outer(verdict_entries()).alias("entry")).filter(F.col("entry").isNotNull())
    rule_no = F.col("entry.rule_no")
    return rows.select(
        "repo_id", "path", F.col("entry.phase").alias("phase"), "line_no", rule_no.alias("rule_no"),
        function_of(rules, rule_no).alias("function_name"), F.when(rule_no > 0, rule_column(rules, rule_no, "algorithm_or_library")).alias("library"),
        strip(F.col("line")).alias("code_snippet"), "user_source", F.col("sanitised").alias("has_sanitization"),
        F.col("entry.verdict.pattern_type").alias("pattern_type"), F.col("entry.verdict.severity").alias("severity"),
        F.col("entry.verdict.confidence").alias("confidence"), F.col("var").alias("variable"), "last_assignment",
    )


def scan_xpath_calls(src_files: DataFrame, rules=None) -> DataFrame:
    return scan_xpath(src_files, rules).filter(F.col("phase") == CALLS)


def scan_xpath_strings(src_files: DataFrame, rules=None) -> DataFrame:
    return scan_xpath(src_files, rules).filter(F.col("phase") == STRINGS)


def xpath_description(function_name: Column, pattern_type: Column, user_source: Column, sanitised: Column) -> Column:
    middle = None
    for kind, text in texts.XPATH_MIDDLE.items():
        value = F.format_string(text, user_source) if "%s" in text else F.lit(text)
        middle = F.when(pattern_type == kind, value) if middle is None else middle.when(pattern_type == kind, value)
    ending = F.when(~sanitised, texts.XPATH_ENDING)
    return F.concat_ws(" ", F.format_string(texts.XPATH_OPENING, function_name), middle, ending)


def finding_columns() -> dict[str, Column]:
    """The columns of a finding, from the columns of a hit."""
    path = F.col("path")
    return {
        "repo_id": F.col("repo_id"),
        "id": finding_id("XPATH", path, F.col("line_no")),
        "severity": F.col("severity"),
        "category": F.lit(texts.XPATH_CATEGORY),
        "cwe": F.lit(texts.XPATH_CWE),
        "owasp": F.lit(texts.XPATH_OWASP),
        "file": path,
        "line": F.col("line_no").cast("int"),
        "code_snippet": F.col("code_snippet"),
        "description": xpath_description(F.col("function_name"), F.col("pattern_type"), F.col("user_source"), F.col("has_sanitization")),
        "impact": F.lit(texts.XPATH_IMPACT),
        "remediation": F.lit(texts.XPATH_REMEDY),
        "references": F.array(*[F.lit(x) for x in texts.XPATH_LINKS]),
        "cvss_score": F.lit(None).cast("double"),
        "confidence": F.col("confidence"),
        "origin": F.lit("xpath"),
        "ord": input_order(F.col("repo_id"), path, F.col("phase"), F.col("line_no"), F.col("rule_no")),
    }


def xpath_findings(hits: DataFrame) -> DataFrame:
    """Hits as findings."""
    return hits.select(*[c.alias(name) for name, c in finding_columns().items()])
