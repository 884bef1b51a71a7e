"""From source files and labels to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codesieve.operators.evaluate import findings_to_norm, score_tool
from codesieve.operators.findings import scan_specialized
from codesieve.session import cut_lineage


def score_engine(src_files: DataFrame, ground_truth: DataFrame, rules=None, aggressive: bool = True, tol: int = 3,
                 vector_rules: DataFrame | None = None) -> DataFrame:
    """Score the engine's own findings. They are written out once: scoring reads them several times."""
    found = cut_lineage(findings_to_norm(scan_specialized(src_files, rules, aggressive, vector_rules)))
    return score_tool(ground_truth, found, tol)
