"""Scores against hand-computed and published confusion counts; samples."""

import itertools

import pytest
from pyspark.sql import functions as F

from codesieve.operators import evaluate, model_io, sample

TRUTH = [("e1", "a.py", 89, True, 10), ("e2", "b.py", 89, True, 20), ("e3", "c.py", 79, True, 5), ("e4", "d.py", 89, False, None), ("e5", "e.py", 79, False, None)]
FOUND = [("a.py", 11, 89), ("b.py", 30, 89), ("c.py", 5, 22), ("d.py", 1, 89)]


@pytest.fixture
def truth(spark):
    return lambda rows=TRUTH: spark.createDataFrame(rows, "id string, file string, cwe int, is_vulnerable boolean, line int")


@pytest.fixture
def found(spark):
    return lambda rows=FOUND: spark.createDataFrame([(r[0], r[1], r[2], *r[3:]) for r in rows], "file string, line int, cwe int" + (", run_id string" if len(rows[0]) > 3 else ""))


def test_hand_computed_scores(truth, found):
    got = {(r.granularity, r.bucket): r for r in evaluate.score_tool(truth(), found()).collect()}
    counts = {k: (r.tp, r.fp, r.fn, r.tn) for k, r in got.items()}
    assert counts == {("file_cwe", "overall"): (2, 1, 1, 1), ("file_cwe", "89"): (2, 1, 0, 0), ("file_cwe", "79"): (0, 0, 1, 1),
                      ("line", "overall"): (1, 1, 2, 1), ("line", "89"): (1, 1, 1, 0), ("line", "79"): (0, 0, 1, 1)}
    assert got["file_cwe", "89"].f1 == pytest.approx(0.8) and got["line", "overall"].f1 == pytest.approx(0.4)
    assert got["file_cwe", "79"].precision is None and got["line", "89"].youden == pytest.approx(-0.5)


def test_recall_only_corpus_has_no_line_rows(truth, found):
    rows = evaluate.score_tool(truth([("a", "a.py", 1, True, None), ("b", "b.py", 1, True, None)]), found([("a.py", 3, 1)])).collect()
    assert {r.granularity for r in rows} == {"file_cwe"}
    r = [r for r in rows if r.bucket == "overall"][0]
    assert (r.precision, r.f1, r.fpr, r.youden, r.recall) == (None, None, None, None, 0.5) and "recall only" in r.notes[0]


# tp, fp, fn, tn -> precision, recall, f1, youden (three decimals)
PUBLISHED = [
    ((167, 81, 39, 113), (0.673, 0.811, 0.736, 0.393)), ((17, 14, 2, 6), (0.548, 0.895, 0.680, 0.195)), ((18, 16, 0, 2), (0.529, 1.0, 0.692, 0.111)),
    ((30, 19, 6, 11), (0.612, 0.833, 0.706, 0.200)), ((37, 22, 3, 12), (0.627, 0.925, 0.747, 0.278)), ((4, 5, 0, 0), (0.444, 1.0, 0.615, 0.0)),
    ((0, 0, 19, 17), (None, 0.0, None, 0.0)), ((14, 0, 5, 16), (1.0, 0.737, 0.848, 0.737)), ((32, 0, 0, 40), (1.0, 1.0, 1.0, 1.0)),
    ((8, 2, 4, 4), (0.8, 0.667, 0.727, 0.333)), ((5, 0, 0, 5), (1.0, 1.0, 1.0, 1.0)), ((2, 3, 0, 0), (0.4, 1.0, 0.571, 0.0)), ((23, 0, 98, 0), (None, 0.190, None, None)),
    ((37, 0, 84, 0), (None, 0.306, None, None)), ((8, 2, 2, 8), (0.8, 0.8, 0.8, 0.6)), ((0, 1, 1, 0), (0.0, 0.0, 0.0, -1.0)), ((0, 0, 0, 0), (None, None, None, None))]


def test_published_metrics(spark):
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(PUBLISHED)], "i int, tp long, fp long, fn long, tn long")
    rows = evaluate.classification_metrics(df).orderBy("i").collect()
    third = lambda v: None if v is None else pytest.approx(v, abs=0.0006)
    for row, (_, want) in zip(rows, PUBLISHED):
        assert (row.precision, row.recall, row.f1, row.youden) == tuple(third(w) for w in want), row


def same_file(a, b):
    norm = lambda p: p.replace("\\", "/").lstrip("./")
    a, b = norm(a), norm(b)
    pa, pb = a.split("/"), b.split("/")
    depth = 2 if min(len(pa), len(pb)) >= 2 else 1
    return a == b or (pa[-depth:] == pb[-depth:] and (a.endswith(b) or b.endswith(a)))


def test_path_matching_equals_brute_force(truth, found):
    paths = ["a.py", "x/a.py", "./x/a.py", "y/x/a.py", "yx/a.py", "z\\x\\a.py", "xa.py", "/r/y/x/a.py", "b/a.py", ".x/a.py", "q/yx/a.py", ""]
    want = {(f"g{i}") for i, a in enumerate(paths) for b in paths[::2] if same_file(a, b)}
    for lists in ((paths, paths[::2]),):
        got = evaluate.match_ground_truth(truth([(f"g{i}", p, 1, True, None) for i, p in enumerate(lists[0])]), found([(p, 1, 1) for p in lists[1]]))
        assert {r.id for r in got.collect()} == want
    pairs = {(i, j) for i, j in itertools.product(range(len(paths)), repeat=2) if same_file(paths[i], paths[j])}
    runs = found([(p, 1, 1, f"r{j}") for j, p in enumerate(paths)])
    got = evaluate.match_ground_truth(truth([(f"g{i}", p, 1, True, None) for i, p in enumerate(paths)]), runs)
    assert {(int(r.id[1:]), int(r.run_id[1:])) for r in got.collect()} == pairs


def test_missing_cwes_match_each_other_and_count_in_overall_only(truth, found):
    rows = {r.bucket: r.tp for r in evaluate.score_tool(truth([("a", "a.py", None, True, None), ("b", "b.py", 5, True, None)]), found([("a.py", 1, None)])).collect()}
    assert rows == {"overall": 1, "5": 0}


@pytest.mark.parametrize("tol", [0, 3])
def test_lines_equal_brute_force(truth, found, tol):
    entries = [(f"e{i}", "a.py", 1, True, i) for i in range(0, 40, 3)]
    lines = [0, 1, 7, 8, 22, 39]
    got = evaluate.match_within_lines(truth(entries), found([("a.py", n, 1) for n in lines]), tol)
    assert {r.id for r in got.collect()} == {e[0] for e in entries if any(abs(e[4] - n) <= tol for n in lines)}


def test_runs(truth, found):
    runs = found([("a.py", 11, 89, "r1"), ("b.py", 1, 89, "r1"), ("./a.py", 12, 89, "r2")])
    rows = {(r.bucket, r.metric): r for r in evaluate.metrics_across_runs(evaluate.score_tool(truth(), runs)).collect()}
    recall = rows["overall", "recall"]
    assert (recall.mean, recall.min, recall.max, recall.runs_defined) == (pytest.approx(0.5), pytest.approx(1 / 3), pytest.approx(2 / 3), 2)
    assert rows["79", "recall"].mean == 0.0 and ("79", "f1") not in rows
    stable = evaluate.finding_stability(runs).first()
    assert (stable.stability, stable.in_all, stable.in_any) == (0.5, 1, 2)
    assert evaluate.finding_stability(runs.limit(0)).first().stability is None
    with pytest.raises(Exception, match="two runs"):
        evaluate.metrics_across_runs(evaluate.score_tool(truth(), found())).collect()
    quiet = runs.select("run_id").distinct().withColumn("dataset", F.lit("dataset")).union(runs.sparkSession.createDataFrame([("r3", "dataset")]))
    assert evaluate.score_tool(truth(), runs, runs=quiet).filter("run_id = 'r3' and bucket = 'overall' and granularity = 'file_cwe'").first().fn == 3


def test_samples(spark):
    df = spark.range(1000).select(F.format_string("id%04d", "id").alias("id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("low").alias("s"))
    assert {r.s: r.n for r in sample.sample_largest_remainder(df, ["s"], 55).groupBy("s").agg(F.count("*").alias("n")).collect()} == {"big": 39, "mid": 11, "low": 5}
    assert {r.s: r.n for r in sample.sample_fraction(df, ["s"], 4).groupBy("s").agg(F.count("*").alias("n")).collect()} == {"big": 3, "mid": 1, "low": 1}
    one = sample.sample_spread(df, "s", 2)
    assert one.count() == 2 and one.select("s").distinct().count() == 2
    a, b, c = (sorted(r.id for r in sample.sample_fraction(df.repartition(p), ["s"], 50, seed).collect()) for p, seed in ((1, 1), (7, 1), (1, 2)))
    assert a == b != c


def test_batches(spark):
    df = spark.range(23).select(F.lit("r").alias("repo_id"), F.col("id").cast("string").alias("path"))
    assert sorted(r.n for r in sample.assign_batches(df, 5).groupBy("batch_id").agg(F.count("*").alias("n")).collect()) == [3, 5, 5, 5, 5]


def test_costs_and_models(spark):
    log = spark.createDataFrame([("claude", 1000, 500), ("nobody", 10, 10)], "model string, input_tokens long, output_tokens long").withColumn("ts", F.current_timestamp())
    assert [r.cost for r in model_io.cost_of_request(log).collect()] == [0.0105, 0.0]
    total = model_io.usage_totals(log).filter("model_id is null").first()
    assert (total.requests, total.total_cost, total.total_tokens) == (2, 0.0105, 1520)
    own = spark.createDataFrame([("nobody", 1e5, 1e5)], "model_id string, input double, output double")
    assert [r.cost for r in model_io.cost_of_request(log, own).orderBy("model").collect()] == [0.0, 2.0]
    tasks = spark.createDataFrame([("SAST",), ("validation",), ("other",), (None,)], "task string")
    assert [r.model for r in model_io.select_model(tasks).collect()] == ["claude-3.7-sonnet", "gpt4o-mini", "claude", "claude"]
    assert model_io.select_model(tasks, "mine").first().model == "mine"


REPOS = "id string, repo_id string, file string, cwe int, is_vulnerable boolean, line int"


def test_repositories_are_scored_apart(spark):
    entries = spark.createDataFrame([("g1", "A", "a.py", 89, True, 3), ("g1", "B", "a.py", 89, True, 3), ("g2", None, "a.py", 89, True, 3)], REPOS)
    reports = spark.createDataFrame([("A", "a.py", 3, 89)], "repo_id string, file string, line int, cwe int")
    for match in (evaluate.match_ground_truth, evaluate.match_within_lines):
        assert [(r.repo_id, r.id) for r in match(entries, reports).collect()] == [("A", "g1")]
    got = {r.granularity: (r.tp, r.fn) for r in evaluate.score_tool(entries, reports).filter("bucket = 'overall'").collect()}
    assert got == {"file_cwe": (1, 2), "line": (1, 2)}
    # A corpus without repositories takes findings of any.
    assert evaluate.match_ground_truth(entries.filter("id = 'g2'").drop("repo_id"), reports).count() == 1
    runs = spark.createDataFrame([("A", "a.py", 3, 89, "r1"), ("B", "a.py", 3, 89, "r2")], "repo_id string, file string, line int, cwe int, run_id string")
    assert evaluate.finding_stability(runs).first().in_any == 2


def test_a_run_without_findings_misses_everything(spark):
    entries = spark.createDataFrame([("g1", "A", "a.py", 89, True, 3), ("g2", "A", "b.py", 79, False, None)], REPOS)
    none = spark.createDataFrame([], "repo_id string, file string, line int, cwe int")
    got = evaluate.score_tool(entries, none).filter("bucket = 'overall' and granularity = 'file_cwe'").first()
    assert (got.run_id, got.tp, got.fp, got.fn, got.tn) == ("run", 0, 0, 1, 1)
    assert evaluate.score_counts(entries, none).first().tool_findings == 0


def test_runs_silent_on_one_dataset(spark, truth, found):
    """Every run counts on every dataset, also where it found nothing; without findings there is one run."""
    entries = truth().withColumn("dataset", F.lit("x")).unionByName(truth().withColumn("dataset", F.lit("y")))
    reports = found([("a.py", 11, 89, "r1"), ("b.py", 1, 89, "r2")]).withColumn("dataset", F.when(F.col("run_id") == "r1", "x").otherwise("y"))
    assert {(r.run_id, r.dataset) for r in evaluate.run_list(reports, entries).collect()} == {(a, b) for a in ("r1", "r2") for b in "xy"}
    rows = {(r.run_id, r.dataset): r.tp + r.fp for r in evaluate.score_tool(entries, reports).filter("bucket = 'overall' and granularity = 'file_cwe'").collect()}
    assert len(rows) == 4 and rows["r1", "y"] == rows["r2", "x"] == 0
    assert {(r.run_id, r.dataset) for r in evaluate.run_list(reports.limit(0), entries).collect()} == {("run", "x"), ("run", "y")}
