"""Report sections as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.fixed import severity as fixed
from codesieve.fixed import texts
from codesieve.functions.severity import effort_hours, severity_rank
from codesieve.functions.text import one_of
from codesieve.operators.aggregate import finding_statistics
from codesieve.operators.chains import attack_chains, chain_counts
from codesieve.operators.ranking import top_k


def risk_matrix(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by severity, the five known ones always present, with a bar relative to the largest."""
    by = by or []
    counts = findings.groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("n"))
    zeros = F.explode(F.array(*[F.lit(s) for s in fixed.SEVERITIES])).alias("severity")
    groups = counts.select(*by).distinct() if by else findings.sparkSession.range(1).select()
    filled = counts.unionByName(groups.select(*by, zeros, F.lit(0).cast("bigint").alias("n")))
    rows = filled.groupBy(*by, "severity").agg(F.sum("n").alias("n"))
    top = rows.groupBy(*by).agg(F.max("n").alias("top"))
    joined = rows.join(top, by) if by else rows.withColumn("top", top.select("top").scalar())
    length = F.when(F.col("top") > 0, F.floor(F.col("n") / F.col("top") * fixed.BAR_LENGTH)).otherwise(0).cast("int")
    return joined.select(*by, "severity", "n", F.repeat(F.lit(fixed.BAR_CHAR), length).alias("bar"))


def category_counts(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    return findings.groupBy(*(by or []), "category").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_seen"))


def _phase(sev: Column, field: int) -> Column:
    out = None
    for row in fixed.ROADMAP:
        test, value = sev.isin(row[2]), F.lit(row[field])
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def roadmap_items(findings: DataFrame) -> DataFrame:
    """One row per finding with its phase; unknown severities have none."""
    sev = F.col("severity")
    return findings.filter(sev.isin(fixed.SEVERITIES)).select(
        "repo_id", _phase(sev, 0).alias("phase"), "id", F.col("category").alias("title"), _phase(sev, 3).alias("effort"), "ord")


def remediation_roadmap(findings: DataFrame) -> DataFrame:
    """The four phases with their number of findings and hours."""
    sev = F.col("severity")
    counted = findings.filter(sev.isin(fixed.SEVERITIES)).groupBy(_phase(sev, 0).alias("phase")).agg(F.count(F.lit(1)).alias("n"))
    phases = F.explode(F.array(*[F.lit(r[0]) for r in fixed.ROADMAP])).alias("phase")
    empty = findings.sparkSession.range(1).select(phases, F.lit(0).cast("bigint").alias("n"))
    rows = counted.unionByName(empty).groupBy("phase").agg(F.sum("n").alias("n_findings"))
    timeframe = one_of(F.col("phase"), {r[0]: r[1] for r in fixed.ROADMAP}, "")
    hours = one_of(F.col("phase"), {r[0]: r[4] for r in fixed.ROADMAP}, 0.0)
    return rows.select("phase", timeframe.alias("timeframe"), "n_findings", (F.col("n_findings") * hours).alias("total_effort"))


def immediate_actions(findings: DataFrame, k: int = 3, by: list[str] | None = None) -> DataFrame:
    """What to do first: the first critical findings, then high ones."""
    urgent = findings.filter(F.col("severity").isin("CRITICAL", "HIGH"))
    first = top_k(urgent, k, [severity_rank(F.col("severity")), F.col("ord"), F.col("id")], by)
    action = F.format_string("Fix %s in %s (%s)", F.col("category"), F.col("file"), F.col("severity"))
    return first.select(*(by or []), action.alias("action"), severity_rank(F.col("severity")).alias("rank"), "ord")


def executive_summary(findings: DataFrame, org: dict | None = None, by: list[str] | None = None) -> DataFrame:
    """One row per group (one in all without `by`): totals, impact, effort and first actions."""
    by = by or []
    n = lambda s: F.count_if(F.col("severity") == s)
    totals = findings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), *[n(s).alias(s.lower()) for s in fixed.SEVERITIES],
        F.coalesce(F.sum(effort_hours(F.col("severity"))), F.lit(0.0)).alias("estimated_hours"))
    actions = immediate_actions(findings, 3, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "ord", "action"))).alias("a"))
    if by:
        joined = totals.join(actions, by, "left")
    else:
        joined = totals.withColumn("a", actions.select("a").scalar())
    impact = F.when(F.col("critical") > 0, texts.IMPACT_CRITICAL).when(F.col("high") > 2, texts.IMPACT_HIGH).otherwise(texts.IMPACT_OTHER)
    application = (org or {}).get("application", "Application")
    return joined.select(
        *by, F.format_string(texts.OVERVIEW, F.lit(application), F.col("total")).alias("overview"), "total",
        *[s.lower() for s in fixed.SEVERITIES], impact.alias("business_impact"),
        F.coalesce(F.transform("a", lambda x: x.action), F.array().cast("array<string>")).alias("immediate_actions"), "estimated_hours",
        (F.col("estimated_hours") / fixed.HOURS_PER_WEEK).alias("estimated_weeks"), F.lit(fixed.SUMMARY_PHASES).alias("phases"))


def compliance_counts(findings: DataFrame) -> DataFrame:
    """Counts by OWASP category and by CWE, where given."""
    kinds = F.array(F.struct(F.lit("owasp").alias("framework"), F.col("owasp").alias("item")),
                    F.struct(F.lit("cwe").alias("framework"), F.col("cwe").alias("item")))
    return findings.select(F.explode(kinds).alias("k")).filter(F.coalesce(F.col("k.item"), F.lit("")) != "").groupBy("k.framework", "k.item").agg(
        F.count(F.lit(1)).alias("n"))


def cvss_appendix(findings: DataFrame) -> DataFrame:
    return findings.select("repo_id", F.col("id").alias("finding_id"), F.coalesce("cvss_score", F.lit(0.0)).alias("cvss_score"),
                           F.lit(fixed.CVSS_VECTOR).alias("cvss_vector"))


def remediation_guidance(findings: DataFrame) -> DataFrame:
    return findings.select(
        F.col("id").alias("finding_id"), F.col("category").alias("vulnerability"), "file", "line", "description", "impact", "remediation",
        F.col("remediation").alias("code_example"), F.lit(texts.TESTING_PROCEDURE).alias("testing_procedure"), "references")


def summary_rows(findings: DataFrame, with_chains: bool = True) -> DataFrame:
    """The text summary as (section, position, key, value) rows.

    The findings are read three times: for the statistics, the categories and the numbers of chains. Of the chains only those of
    the first three repositories that have any are built, as the others cannot be among the first three.
    """
    known = findings.sparkSession.range(1).select(
        F.lit("by_severity").alias("section"), F.explode(F.array(*[F.lit(s) for s in fixed.SEVERITIES])).alias("key"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("avg_cvss_score"))
    shown = (F.col("section") == "total") | (F.col("section") == "by_severity") & F.col("key").isin(fixed.SEVERITIES)
    stats = finding_statistics(findings).filter(shown).unionByName(known).groupBy("section", "key").agg(F.sum("n").alias("n"), F.max("avg_cvss_score").alias("avg_cvss_score"))
    row = lambda section, position, key, value: [
        F.lit(section).alias("section"), position.cast("int").alias("position"), key.alias("key"), value.cast("string").alias("value")]
    totals = [F.struct(*row("total_findings", F.lit(1), F.lit("total"), F.col("n"))), F.struct(*row("average_cvss", F.lit(1), F.lit("average"), F.format_number("avg_cvss_score", 1)))]
    severity = F.struct(*row("by_severity", severity_rank(F.col("key")) + 1, F.col("key"), F.col("n")))
    top = top_k(category_counts(findings), 5, [F.col("n").desc(), "first_seen", "category"])
    place = F.row_number().over(_in_order(F.col("n").desc(), "first_seen", "category"))
    parts = [
        stats.select(F.explode(F.when(F.col("section") == "total", F.array(*totals)).otherwise(F.array(severity))).alias("r")).select("r.*"),
        top.select(*row("top_categories", place, F.col("category"), F.col("n"))),
    ]
    if with_chains:
        counts = chain_counts(findings)
        # A null scope has no chains. It comes last and is in no list, as a filter would part this read of the findings from that for the count.
        scopes = top_k(counts.filter(F.col("n_chains") > 0).select("repo_id").distinct(), 3, [F.col("repo_id").asc_nulls_last()])
        theirs = findings.filter(F.array_contains(scopes.agg(F.collect_list("repo_id")).scalar(), F.col("repo_id")))
        first = top_k(attack_chains(theirs, first=3), 3, ["repo_id", "chain_no"])
        place = F.row_number().over(_in_order("repo_id", "chain_no"))
        parts += [
            counts.agg(F.coalesce(F.sum("n_chains"), F.lit(0)).alias("n")).select(*row("attack_chains", F.lit(0), F.lit("count"), F.col("n"))),
            first.select(*row("attack_chains", place, F.col("id"), F.col("description"))),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _in_order(*columns):
    """A window over a result of a handful of rows (after a limit)."""
    from pyspark.sql import Window
    return Window.orderBy(*columns)
