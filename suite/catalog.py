"""All queries, in one place."""

from suite import queries_evaluate, queries_files, queries_findings, queries_profile, queries_scan, queries_stream  # noqa: F401
from suite.registry import ORACLES, QUERIES  # noqa: F401
