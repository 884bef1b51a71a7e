"""What all line scans share: language, rules that can match, lines that do.

A file stays one row until its hits are known.  First the rules are narrowed
to those whose plain text occurs somewhere in the file, then each line meets
only these, with the substring test before the regular expression.  Only hits
are exploded.  Nothing is shuffled and no text is copied per line.

The expressions are written as SQL text: a rule set is one expression, not
thousands of calls to the driver's JVM.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.paths import detect_language, normalize_language
from codesieve.functions.text import fold, quoted, required_literal, sql_matches
from codesieve.sources.files import drop_blank_files


def prepare(src_files: DataFrame, rules: list, **more: list) -> DataFrame:
    """Files with their rule-set language, lines, folded lines and, in `live`, the numbers of the rules that can match.

    Further rule sets are narrowed in the same pass, each into a column of its name.
    """
    files = drop_blank_files(src_files).select(
        "repo_id", "path", "content", normalize_language(detect_language(F.col("path"))).alias("language"), fold(F.col("content")).alias("folded"))
    live = {"live": rules, **more}
    return files.select(
        "repo_id", "path", "language", "folded", *[F.expr(live_rules(r)).alias(name) for name, r in live.items()],
        F.split("content", "\n").alias("lines"), F.split("folded", "\n").alias("lows"))


def live_rules(rules: list) -> str:
    """Numbers of the rules for the file's language whose plain text occurs in the file."""
    def numbers(some):
        tests = []
        for r in some:
            literal = required_literal(r.pattern)
            tests.append(f"if(contains(folded, {quoted(literal)}), {r.rule_no}, null)" if literal else str(r.rule_no))
        return f"array_compact(array({', '.join(tests)}))"

    ordered = sorted(rules, key=lambda r: (r.language, r.rule_no))
    by_language = {k: list(g) for k, g in groupby(ordered, key=lambda r: r.language)}
    everywhere = by_language.pop("*", [])
    none = "cast(array() as array<int>)"
    parts = []
    if by_language:
        branches = " ".join(f"when {quoted(name)} then {numbers(some)}" for name, some in by_language.items())
        parts.append(f"case language {branches} else {none} end")
    if everywhere:
        parts.append(numbers(everywhere))
    return f"concat({', '.join(parts)})" if parts else none


def matched_rules(rules: list, line: str = "get(lines, i)", low: str = "low", live: str = "live") -> str:
    """Which of the live rules match a line."""
    branches = []
    for r in rules:
        literal = required_literal(r.pattern)
        gate = f"contains({low}, {quoted(literal)}) and " if literal else ""
        branches.append(f"when {r.rule_no} then {gate}{sql_matches(line, r.pattern)}")
    return f"filter({live}, n -> case n {' '.join(branches)} end)" if branches else "cast(array() as array<int>)"


def rule_hits(rules: list, live: str = "live") -> Column:
    """Array of (line_no, line, rule_nos) of the matching lines; null where no rule can match."""
    found = f"transform(lows, (low, i) -> named_struct('line_no', i + 1, 'line', get(lines, i), 'rule_nos', {matched_rules(rules, live=live)}))"
    return F.expr(f"if(size({live}) > 0, filter({found}, h -> size(h.rule_nos) > 0), null)")


def rule_column(rules: list, rule_no: Column, field: str) -> Column:
    """A column of the rule table, looked up by rule number in a constant array or map."""
    values = ", ".join(f"{r.rule_no}, {'null' if getattr(r, field) is None else quoted(getattr(r, field))}" for r in rules)
    return F.try_element_at(F.expr(f"map({values})"), rule_no) if rules else F.lit(None).cast("string")


def context_window(lines: Column, line_no: Column, before: int = 5, after: int = 5) -> Column:
    """The lines around a line, joined by newlines and clamped to the file."""
    first = F.greatest(line_no - before, F.lit(1))
    return F.array_join(F.slice(lines, first, line_no + after - first + 1), "\n")
