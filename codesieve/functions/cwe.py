"""CWE numbers out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_cwe(text: Column) -> Column:
    """First run of digits of a text, null if it has none."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int")


def parse_cwe_list(items: Column) -> Column:
    """First item that holds a number."""
    return F.get(F.filter(F.transform(items, parse_cwe), lambda x: x.isNotNull()), F.lit(0))
