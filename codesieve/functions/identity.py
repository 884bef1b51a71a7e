"""Ids, fingerprints and the input order of findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of `ord` below the file number: phase 2, line 21, rule 8.
_PHASE, _LINE = 29, 8


def finding_id(prefix: str, path: Column, n: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.md5(F.concat(path, n.cast("string"))), 1, 8)))


def fingerprint_full(file: Column, line: Column, category: Column, snippet: Column) -> Column:
    return F.md5(F.concat_ws(":", file, F.coalesce(line.cast("string"), F.lit("None")), category, snippet))


def fingerprint_dedup(file: Column, line: Column, category: Column, snippet: Column) -> Column:
    """A missing line and line 0 both print as nothing; the whole snippet counts."""
    shown = F.when(line != 0, line.cast("string")).otherwise("")
    blank = F.lit("")
    return F.md5(F.concat_ws(":", F.coalesce(file, blank), F.coalesce(shown, blank), F.coalesce(category, blank),
                             F.coalesce(snippet, blank)))


def file_no(repo_id: Column, path: Column) -> Column:
    """A fixed position of a file among all files, spread evenly over 32 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", repo_id, path)), 1, 8), 16, 10).cast("bigint")


def input_order(repo_id: Column, path: Column, phase: Column, line_no: Column, rule_no: Column) -> Column:
    """`ord` of a rule finding: by file, then rule family, then line, then rule."""
    return (
        F.shiftleft(file_no(repo_id, path), 31)
        + F.shiftleft(phase.cast("bigint"), _PHASE)
        + F.shiftleft(line_no.cast("bigint"), _LINE)
        + rule_no.cast("bigint")
    )
