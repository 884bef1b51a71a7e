"""Regular expressions and text helpers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A brace that opens or closes a counted repetition, such as {2,} or {1,3}.
_QUANTIFIER = re.compile(r"\{\d+(?:,\d*)?\}")


def java_regex(pattern: str, ignore_case: bool = True) -> str:
    """A pattern in Python syntax, rewritten for the JVM.

    Bare braces are escaped, `.` stops at newline only, and classes and case
    folding follow Unicode, as they do in Python.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
            out.append("\\[" if ch == "[" else ch)
        elif ch == "[":
            in_class = True
            out.append(ch)
        elif ch == "{" and _QUANTIFIER.match(pattern, i):
            end = pattern.index("}", i) + 1
            out.append(pattern[i:end])
            i = end
            continue
        elif ch in "{}":
            out.append("\\" + ch)
        else:
            out.append(ch)
        i += 1
    return ("(?idU)" if ignore_case else "(?dU)") + "".join(out)


def any_of(patterns: list[str]) -> str:
    """One alternation that matches where any of the patterns does."""
    return "|".join(f"(?:{p})" for p in patterns)


def matches(col: Column, pattern: str, ignore_case: bool = True) -> Column:
    return col.rlike(java_regex(pattern, ignore_case))


def has_any(col: Column, words: list[str]) -> Column:
    """True if the text contains one of the words (plain substrings)."""
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def _class_end(pattern: str, i: int) -> int:
    """Position after the character class that opens at i."""
    i += 1
    while pattern[i] != "]":
        i += 2 if pattern[i] == "\\" else 1
    return i + 1


def _group_end(pattern: str, i: int) -> int:
    """Position after the group that opens at i."""
    depth = 0
    while True:
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "[":
            i = _class_end(pattern, i)
            continue
        depth += (ch == "(") - (ch == ")")
        i += 1
        if depth == 0:
            return i


def required_literal(pattern: str) -> str:
    """The longest run of plain characters every match of the pattern must hold, lower-cased; '' if none is sure.

    Used as a cheap `contains` test before the regular expression runs.
    """
    runs, run, i = [], "", 0
    while i < len(pattern):
        ch, token = pattern[i], None
        if ch == "|":
            return ""
        if ch == "\\":
            escaped = pattern[i + 1]
            token, i = (None if escaped.isalnum() else escaped), i + 2
        elif ch == "[":
            i = _class_end(pattern, i)
        elif ch == "(":
            i = _group_end(pattern, i)
        elif ch in ".^$" or (ch == "{" and _QUANTIFIER.match(pattern, i)):
            i = pattern.index("}", i) + 1 if ch == "{" else i + 1
        else:
            token, i = ch, i + 1
        repeat = _QUANTIFIER.match(pattern, i)
        following = pattern[i:i + 1]
        if following in ("*", "?") and following or repeat:
            token, i = None, (repeat.end() if repeat else i + 1)
        if token is not None:
            run += token
        if token is None or following == "+":
            runs.append(run)
            run = ""
            i += following == "+"
    best = max([*runs, run], key=len).lower()
    return best if len(best) > 1 else ""


def fold(col: Column) -> Column:
    """Lower case, with the long s folded too, so that `contains` finds all that ignore-case matching can."""
    return F.replace(F.lower(col), F.lit("ſ"), F.lit("s"))


def strip(col: Column) -> Column:
    """Remove leading and trailing white space of any kind (SQL trim knows blanks only)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def one_of(col: Column, table: dict, default) -> Column:
    """A small fixed lookup as one CASE expression."""
    out = None
    for key, value in table.items():
        if key == "":
            continue
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_matches(text: str, pattern: str, ignore_case: bool = True) -> str:
    return f"rlike({text}, {quoted(java_regex(pattern, ignore_case))})"


def sql_found(patterns: list[str], ignore_case: bool = True, text: str = "content", folded: str = "folded") -> str:
    """SQL that is true if one of the patterns matches, each behind a test for its plain text in the folded column."""
    tests = []
    for p in patterns:
        literal = required_literal(p)
        test = sql_matches(text, p, ignore_case)
        tests.append(f"(contains({folded}, {quoted(literal)}) and {test})" if literal else test)
    return f"({' or '.join(tests)})"


def first_line_of(column: str, pattern: str) -> str:
    """SQL for the 1-based number of the first line where the pattern matches, null if it never does."""
    parts = f"array(split({column}, {quoted(java_regex(pattern))}, 2))"
    return f"transform({parts}, p -> if(size(p) > 1, length(p[0]) - length(replace(p[0], '\\n')) + 1, null))[0]"
