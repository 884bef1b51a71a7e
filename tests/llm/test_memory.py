"""What a task holds does not follow the size of the batches it is given."""

import datetime

import pyarrow as pa

from codesieve.llm import jaccard, quality_rules


def test_large_batches_are_described_in_parts():
    text = " ".join(f"word{i}" for i in range(20_000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(120), pa.int64()), pa.array([f"{i} {text}" for i in range(120)])], ["key", "text"])
    for f in (jaccard._describe(4, 85), jaccard._sets(4)):
        parts = list(f(iter([batch])))
        assert len(parts) > 3 and sum(p.num_rows for p in parts) == 120
    assert list(jaccard._sets(4)(iter([batch.slice(0, 1)])))[0].num_rows == 1


def test_kept_rows_pass_whole_and_without_a_queue_of_rows(spark):
    """Rows go through the rules whole, whatever their columns are; no operator holds the other columns meanwhile."""
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, t, {"a": [i]}, datetime.datetime(2020, 1, i + 1), None) for i, t in enumerate([good, None, "", "too short", good + " more"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,array<int>>, at timestamp, none string")
    kept = quality_rules.keep(df, None)
    assert kept.schema == df.schema and sorted(kept.collect()) == sorted(r for r in df.collect() if r.doc_id in (0, 4))
    assert "EvalPython" not in kept._jdf.queryExecution().executedPlan().toString()
    raw = df.withColumn("text", df.text.cast("binary"))
    assert quality_rules.keep(raw, None).columns == raw.columns and quality_rules.keep(raw, None).count() == 2
