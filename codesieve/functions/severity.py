"""Severity, score and effort expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesieve.fixed import severity as fixed
from codesieve.fixed.weak_hash import USAGE_SEVERITY
from codesieve.functions.text import has_any, one_of


def severity_rank(sev: Column) -> Column:
    """0 for the most severe; an unknown severity comes last."""
    return one_of(sev, {s: i for i, s in enumerate(fixed.SEVERITIES)}, fixed.UNKNOWN_RANK)


def cvss_or_default(score: Column, sev: Column) -> Column:
    """The score, or the one of its severity where it is missing or zero."""
    return F.when(F.coalesce(score, F.lit(0.0)) != 0.0, score).otherwise(one_of(sev, fixed.DEFAULT_CVSS, fixed.OTHER_CVSS))


def effort_hours(sev: Column) -> Column:
    return one_of(sev, fixed.EFFORT_HOURS, fixed.OTHER_EFFORT)


def priority_score(sev: Column, category: Column, confidence: Column, cvss: Column, context: dict | None = None) -> Column:
    """Lower comes first."""
    cuts = fixed.PRIORITY_CUTS
    score = one_of(sev, fixed.PRIORITY_BASE, fixed.OTHER_PRIORITY).cast("double")
    score -= F.when(has_any(F.lower(category), fixed.PRIORITY_CATEGORIES), cuts["category"]).otherwise(0)
    score -= F.when(confidence == "HIGH", cuts["confidence"]).otherwise(0)
    score -= F.coalesce(cvss, F.lit(0.0))
    context = context or {}
    if context.get("environment") == "production":
        score -= cuts["production"]
    if context.get("contains_pii"):
        score -= cuts["pii"]
    return score


def crypto_severity(is_security: Column, usage: Column) -> Column:
    return F.when(~is_security, "LOW").otherwise(one_of(usage, USAGE_SEVERITY, "MEDIUM"))


def crypto_confidence(algorithm: Column, is_security: Column) -> Column:
    return (
        F.when(algorithm.isin("MD5", "SHA-1") & is_security, "HIGH")
        .when((algorithm == "UNKNOWN") | ~is_security, "MEDIUM")
        .otherwise("HIGH")
    )
