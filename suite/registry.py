"""The list of queries: a Spark function and, where SQL can say it, the same thing for DuckDB."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, run, sql: str | None = None) -> None:
    """`run(spark, sf_dir)` gives a DataFrame; `sql` is the DuckDB text."""
    if name in QUERIES:
        raise ValueError(name)
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def with_(ctes: list[str], final: str) -> str:
    seen = []
    for c in ctes:
        if c not in seen:
            seen.append(c)
    return "WITH " + ",\n".join(seen) + "\n" + final
