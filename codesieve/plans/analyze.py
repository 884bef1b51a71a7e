"""From source files to the final list of findings, and from findings to their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codesieve.operators import aggregate, chains, filters
from codesieve.operators.findings import scan_specialized
from codesieve.operators.merge import merge_findings
from codesieve.operators.profile import profile_repo
from codesieve.sources.files import scan_changed_files


def analyze(src_files: DataFrame, rules=None, fp_rules=None, model_findings: DataFrame | None = None, changed=None, aggressive: bool = True,
            vector_rules: DataFrame | None = None, with_profile: bool = True, min_severity: str | None = None, ordered: bool = True) -> DataFrame:
    """Scan, merge with model findings, filter, score and sort; every stage but the scan can be left out."""
    profile = profile_repo(src_files) if with_profile else None
    found = scan_specialized(scan_changed_files(src_files, changed), rules, aggressive, vector_rules)
    if model_findings is not None:
        found = merge_findings(found, model_findings)
    kept = aggregate.assign_cvss(filters.fp_cascade(found, fp_rules, profile))
    if min_severity:
        kept = filters.filter_by_severity(kept, min_severity)
    return aggregate.sort_by_severity(kept) if ordered else kept


def aggregate_findings(static: DataFrame | None = None, dynamic: DataFrame | None = None, infrastructure: DataFrame | None = None,
                       scope: str = "repo_id") -> dict[str, DataFrame]:
    """All sources deduplicated, with their statistics and attack chains."""
    unique = aggregate.deduplicate(aggregate.union_all(static, dynamic, infrastructure))
    return {
        "findings": unique,
        "by_category": aggregate.group_by_category(unique),
        "attack_chain_counts": chains.chain_counts(unique, scope),
        "attack_chains": chains.attack_chains(unique, scope),
        "statistics": aggregate.finding_statistics(unique),
    }
