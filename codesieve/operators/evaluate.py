"""Detectors against labelled ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.fixed import texts
from codesieve.functions.cwe import parse_cwe
from codesieve.functions.paths import norm_path

METRICS = ["precision", "recall", "f1", "tpr", "fpr", "youden"]


def make_norm_finding(df: DataFrame) -> DataFrame:
    """file, line, cwe (any text), severity and rule_id in their normal form; other columns stay."""
    keep = [c for c in df.columns if c not in ("file", "line", "cwe", "severity", "rule_id")]
    severity = F.upper(F.coalesce(F.nullif(F.col("severity"), F.lit("")), F.lit("UNKNOWN")))
    return df.select(
        "file", F.col("line").cast("int").alias("line"), parse_cwe(F.col("cwe").cast("string")).alias("cwe"), severity.alias("severity"),
        "rule_id", *keep)


def findings_to_norm(findings: DataFrame) -> DataFrame:
    """Engine findings as normalised findings."""
    return make_norm_finding(findings.select("repo_id", "file", "line", "cwe", "severity", F.col("id").alias("rule_id")))


def _join_keys(path: Column, truth: bool) -> Column:
    """Keys under which two paths meet exactly once if their ends agree.

    Two paths with a directory each meet on their last two parts; if one has
    none, they meet on the file name.
    """
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    two = F.concat_ws("/", F.element_at(parts, -2), name)
    deep_first, flat_first = ("DF:", "FD:") if truth else ("FD:", "DF:")
    return F.when(F.size(parts) > 1, F.array(F.concat(F.lit("2:"), two), F.concat(F.lit(deep_first), name))).otherwise(
        F.array(F.concat(F.lit(flat_first), name), F.concat(F.lit("FF:"), name)))


def _same_file(a: Column, b: Column, strict: bool) -> Column:
    if strict:
        return (a == b) | F.concat(F.lit("/"), a).endswith(F.concat(F.lit("/"), b)) | F.concat(F.lit("/"), b).endswith(F.concat(F.lit("/"), a))
    return a.endswith(b) | b.endswith(a)


def _repository(df: DataFrame) -> Column:
    return F.col("repo_id") if "repo_id" in df.columns else F.lit(None).cast("string")


def _same_corpus(ground_truth: DataFrame, norm_findings: DataFrame) -> Column:
    """Same dataset and, if both tables name repositories, same repository (null meets null)."""
    same = F.col("dataset") == F.col("f_dataset")
    both = "repo_id" in ground_truth.columns and "repo_id" in norm_findings.columns
    return same & F.col("repo_id").eqNullSafe(F.col("f_repo")) if both else same


def _entries(ground_truth: DataFrame) -> DataFrame:
    dataset = F.col("dataset") if "dataset" in ground_truth.columns else F.lit("dataset")
    return ground_truth.select(
        dataset.alias("dataset"), _repository(ground_truth).alias("repo_id"), "id", norm_path(F.col("file")).alias("gt_path"), "cwe", F.coalesce("is_vulnerable", F.lit(False)).alias("is_vulnerable"),
        "line")


def _reports(norm_findings: DataFrame) -> DataFrame:
    has = norm_findings.columns
    return norm_findings.select(
        (F.col("dataset") if "dataset" in has else F.lit("dataset")).alias("f_dataset"),
        (F.col("run_id") if "run_id" in has else F.lit("run")).alias("run_id"), _repository(norm_findings).alias("f_repo"),
        norm_path(F.col("file")).alias("f_path"), F.col("cwe").alias("f_cwe"), F.col("line").alias("f_line"))


def match_ground_truth(ground_truth: DataFrame, norm_findings: DataFrame, strict: bool = False) -> DataFrame:
    """(run, dataset, repository, entry id) of the entries reported with their CWE in their file.

    A hash join on CWE and the end of the path; findings are made distinct
    first, so a file reported a million times meets its entry once.
    """
    truth = _entries(ground_truth).select("*", F.explode(_join_keys(F.col("gt_path"), True)).alias("key"))
    seen = _reports(norm_findings).select("f_dataset", "f_repo", "run_id", "f_path", "f_cwe").distinct().select(
        "*", F.explode(_join_keys(F.col("f_path"), False)).alias("f_key"))
    same = _same_corpus(ground_truth, norm_findings) & F.col("cwe").eqNullSafe(F.col("f_cwe")) & (F.col("key") == F.col("f_key"))
    return truth.join(seen, same & _same_file(F.col("gt_path"), F.col("f_path"), strict)).select("run_id", "dataset", "repo_id", "id").distinct()


def match_within_lines(ground_truth: DataFrame, norm_findings: DataFrame, tol: int = 3, strict: bool = False) -> DataFrame:
    """As above, but a vulnerable entry also needs a finding within `tol` lines of its own.

    Lines are cut into strips of 2 * tol + 1, so a hot file is spread over its
    strips; an entry looks into the one or two strips it can reach.
    """
    strip_size = 2 * tol + 1
    truth = _entries(ground_truth)
    # A safe entry ignores lines: it looks into one strip of its own that every finding is copied to once.
    labelled = truth.filter(F.col("is_vulnerable") & F.col("line").isNotNull()).select("*", F.explode(F.sequence(
        F.floor((F.col("line") - tol) / strip_size), F.floor((F.col("line") + tol) / strip_size))).alias("strip"))
    labelled = labelled.select("*", F.explode(_join_keys(F.col("gt_path"), True)).alias("key"))
    lines = _reports(norm_findings).filter(F.col("f_line").isNotNull()).distinct().select(
        "*", F.floor(F.col("f_line") / strip_size).alias("f_strip"), F.explode(_join_keys(F.col("f_path"), False)).alias("f_key"))
    same = (
        _same_corpus(ground_truth, norm_findings) & F.col("cwe").eqNullSafe(F.col("f_cwe")) & (F.col("key") == F.col("f_key"))
        & (F.col("strip") == F.col("f_strip"))
    )
    near = F.abs(F.col("line") - F.col("f_line")) <= tol
    hits = labelled.join(lines, same & near & _same_file(F.col("gt_path"), F.col("f_path"), strict)).select("run_id", "dataset", "repo_id", "id").distinct()
    safe = match_ground_truth(ground_truth.filter(~F.coalesce("is_vulnerable", F.lit(False))), norm_findings, strict)
    return hits.unionByName(safe)


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Adds the metrics of tp, fp, fn, tn; undefined ones are null and say why."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    pos, neg, called = tp + fn, fp + tn, tp + fp
    precision = F.when((neg > 0) & (called > 0), tp / called)
    recall = F.when(pos > 0, tp / pos)
    fpr = F.when(neg > 0, fp / neg)
    base = counts.select("*", precision.alias("precision"), recall.alias("recall"), fpr.alias("fpr"))
    p, r = F.col("precision"), F.col("recall")
    notes = F.array_compact(F.array(
        F.when(neg == 0, texts.NOTE_NO_SAFE).when(called == 0, texts.NOTE_NO_PREDICTIONS), F.when(pos == 0, texts.NOTE_NO_VULNERABLE)))
    return base.select(
        *[c for c in base.columns if c not in ("fpr",)],
        F.when(p + r > 0, 2 * p * r / (p + r)).when(p + r == 0, F.lit(0.0)).alias("f1"),
        r.alias("tpr"), "fpr", (r - F.col("fpr")).alias("youden"), notes.alias("notes"))


def confusion_counts(ground_truth: DataFrame, matched: DataFrame, runs: DataFrame) -> DataFrame:
    """tp, fp, fn, tn by run, dataset and bucket: `overall`, and each CWE of the ground truth.

    Misses are totals minus matches, so entries are never copied per run.
    `runs` lists (run_id, dataset), so that a run without findings counts too.
    """
    truth = _entries(ground_truth)

    def by_bucket(df, keys, vulnerable, safe):
        # Entries without a CWE count in `overall` only.
        buckets = F.array_compact(F.array(F.lit("overall"), F.col("cwe").cast("string")))
        return df.select("*", F.explode(buckets).alias("bucket")).groupBy(*keys, "bucket").agg(
            F.count_if("is_vulnerable").alias(vulnerable), F.count_if(~F.col("is_vulnerable")).alias(safe))

    totals = by_bucket(truth, ["dataset"], "pos", "neg")
    known = truth.select(F.col("dataset").alias("t_dataset"), F.col("repo_id").alias("t_repo"), F.col("id").alias("t_id"), "cwe", "is_vulnerable")
    entry = (F.col("dataset") == F.col("t_dataset")) & F.col("repo_id").eqNullSafe(F.col("t_repo")) & (F.col("id") == F.col("t_id"))
    hits = by_bucket(matched.join(known, entry), ["run_id", "dataset"], "tp", "fp")
    rows = totals.join(runs.distinct(), "dataset").join(hits, ["run_id", "dataset", "bucket"], "left")
    tp, fp = F.coalesce("tp", F.lit(0)), F.coalesce("fp", F.lit(0))
    return rows.select("run_id", "dataset", "bucket", tp.alias("tp"), fp.alias("fp"), (F.col("pos") - tp).alias("fn"), (F.col("neg") - fp).alias("tn"))


def run_list(norm_findings: DataFrame, ground_truth: DataFrame | None = None) -> DataFrame:
    """(run_id, dataset) of the findings; with the ground truth, every run on every dataset, silent ones too.

    Without any finding there is one run, named `run`. A run that is silent everywhere cannot be seen: list it in `runs`.
    """
    reports = _reports(norm_findings)
    if ground_truth is None:
        return reports.select("run_id", F.col("f_dataset").alias("dataset")).distinct()
    # As many names as there are runs: each dataset takes the list.
    runs = reports.agg(F.collect_set("run_id").alias("runs")).select(F.when(F.size("runs") > 0, F.col("runs")).otherwise(F.array(F.lit("run")))).scalar()
    return _entries(ground_truth).select("dataset").distinct().select(F.explode(runs).alias("run_id"), "dataset")


def score_tool(ground_truth: DataFrame, norm_findings: DataFrame, tol: int = 3, runs: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Metrics by run, dataset, granularity and bucket. No line rows where no vulnerable entry has a line."""
    runs = run_list(norm_findings, ground_truth) if runs is None else runs
    by_file = confusion_counts(ground_truth, match_ground_truth(ground_truth, norm_findings, strict), runs)
    labelled = _entries(ground_truth).filter(F.col("is_vulnerable") & F.col("line").isNotNull()).select("dataset").distinct()
    by_line = confusion_counts(ground_truth, match_within_lines(ground_truth, norm_findings, tol, strict), runs).join(labelled, "dataset", "left_semi")
    both = by_file.withColumn("granularity", F.lit("file_cwe")).unionByName(by_line.withColumn("granularity", F.lit("line")))
    return classification_metrics(both)


def score_counts(ground_truth: DataFrame, norm_findings: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Sizes of the ground truth by dataset, with the number of findings of each run, 0 included."""
    runs = run_list(norm_findings, ground_truth) if runs is None else runs.distinct()
    truth = _entries(ground_truth).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("ground_truth_entries"), F.count_if("is_vulnerable").alias("vulnerable"),
        F.count_if(~F.col("is_vulnerable")).alias("non_vulnerable"),
        F.count_if(F.col("is_vulnerable") & F.col("line").isNotNull()).alias("vulnerable_entries_with_line_labels"))
    reports = _reports(norm_findings).groupBy("run_id", F.col("f_dataset").alias("dataset")).agg(F.count(F.lit(1)).alias("tool_findings"))
    rows = truth.join(runs, "dataset").join(reports, ["run_id", "dataset"], "left")
    return rows.withColumn("tool_findings", F.coalesce("tool_findings", F.lit(0)))


def metrics_across_runs(scores: DataFrame) -> DataFrame:
    """Mean, least and greatest of each metric over the runs that define it: six overall, recall per CWE."""
    files = scores.filter(F.col("granularity") == "file_cwe")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    long = files.select("run_id", "dataset", "bucket", F.explode(pairs).alias("m")).select("run_id", "dataset", "bucket", "m.*")
    wanted = long.filter((F.col("bucket") == "overall") | (F.col("metric") == "recall"))
    rows = wanted.groupBy("dataset", "bucket", "metric").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("runs_defined"),
        F.count(F.lit(1)).alias("_runs"))
    enough = F.when(F.col("_runs") >= 2, F.col("runs_defined")).otherwise(F.raise_error(F.lit("need at least two runs")).cast("bigint"))
    return rows.select("dataset", "bucket", "metric", "mean", "min", "max", enough.alias("runs_defined"))


def finding_stability(norm_findings: DataFrame, n_runs: int | None = None) -> DataFrame:
    """Share of the distinct (dataset, repository, file, CWE) reports that all runs made; null without reports."""
    reports = _reports(norm_findings)
    runs = F.lit(n_runs) if n_runs else reports.select(F.count_distinct("run_id")).scalar()
    pairs = reports.groupBy("f_dataset", "f_repo", "f_path", "f_cwe").agg(F.count_distinct("run_id").alias("n"))
    return pairs.agg(F.count_if(F.col("n") == runs).alias("in_all"), F.count(F.lit(1)).alias("in_any")).select(
        F.when(F.col("in_any") > 0, F.col("in_all") / F.col("in_any")).alias("stability"), "in_all", "in_any")


def cwe_distribution(ground_truth: DataFrame, by: str = "cwe") -> DataFrame:
    return ground_truth.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), by)
