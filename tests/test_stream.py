"""Streaming equals batch, and a second run adds nothing."""

import itertools
import os
import shutil

from codesieve import schemas
from codesieve.operators import aggregate
from codesieve.operators.findings import scan_specialized
from codesieve.sources.files import scan_source_files
from codesieve.streaming import incremental, ledger, merged


def test_incremental_scan(spark, tmp_path):
    in_dir, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    in_dir.mkdir()
    for i in range(5):
        (in_dir / f"f{i}.py").write_text(f"password\nh = hashlib.md5({i})\n")
    (in_dir / "bad.py").write_bytes(b"\xff\xfe")
    (in_dir / "skip.md").write_text("hashlib.md5(x)")
    incremental.scan_incremental(spark, str(in_dir), out, check, "r", max_files=2)
    first = spark.read.parquet(f"{out}/findings").drop("batch").collect()
    assert sorted(r.id for r in first) == sorted(r.id for r in scan_specialized(scan_source_files(spark, str(in_dir), "r")).collect())
    assert [r.path for r in spark.read.parquet(f"{out}/files").filter("error is not null").collect()] == ["bad.py"]
    incremental.scan_incremental(spark, str(in_dir), out, check, "r")
    assert spark.read.parquet(f"{out}/findings").count() == len(first)
    (in_dir / "new.py").write_text("hashlib.sha1(x)")
    incremental.scan_incremental(spark, str(in_dir), out, check, "r")
    assert spark.read.parquet(f"{out}/findings").count() == len(first) + 1


def test_dedup_streams(spark, finding, tmp_path):
    df = finding(dict(severity="LOW"), dict(severity="CRITICAL"), dict(line=2), dict(line=2, repo_id="b"))
    df.write.parquet(str(tmp_path / "in"))
    for name, stream, mode in (("first", incremental.dedup_stream, "append"), ("best", incremental.best_stream, "complete")):
        query = stream(incremental.stream_findings(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("first").count() == 3
    assert {(r.repo_id, r.severity) for r in spark.table("best").filter("line = 1").collect()} == {("r", "CRITICAL")}
    assert spark.table("best").count() == aggregate.deduplicate(df).count()
    assert incremental.merge_batches(df, df).count() == 3


def test_ledger(spark, tmp_path):
    """Marks taken away, changed files, failed files, and a run that broke off before its marks were written."""
    in_dir, out = tmp_path / "in", str(tmp_path / "out")
    in_dir.mkdir()

    def put(name, data, at):
        (in_dir / name).write_bytes(data)
        os.utime(in_dir / name, (at, at))

    def scan():
        return ledger.scan_pending(spark, str(in_dir), out, "r")

    def found():
        return sorted((r.file, r.line, r.code_snippet) for r in ledger.findings(spark, out).collect())

    def whole():
        return sorted((r.file, r.line, r.code_snippet) for r in scan_specialized(scan_source_files(spark, str(in_dir), "r")).collect())

    for i in range(4):
        put(f"f{i}.py", b"password\nh = hashlib.md5(%d)\n" % i, 1000 + i)
    put("bad.py", b"\xff\xfe", 1000)
    put("skip.md", b"hashlib.md5(x)", 1000)
    assert scan() == 5 and found() == whole() and scan() == 0
    state = {r.path: (r.state, r.error) for r in ledger.latest(ledger.read_ledger(spark, out)).collect()}
    assert state["bad.py"] == ("failed", "not UTF-8") and state["f1.py"] == ("done", None) and len(state) == 5
    # A mark that is taken away brings its file alone back.
    ledger.take_marks_away(spark, out, spark.createDataFrame([("r", "bad.py")], "repo_id string, path string"))
    assert scan() == 1 and scan() == 0 and found() == whole()
    # A changed file is read again and its old findings go.
    put("f2.py", b"x = 1\nh = hashlib.sha1(2)\n", 2000)
    put("bad.py", b"hashlib.md5(9)", 2000)
    assert scan() == 2 and found() == whole() and not any(f == "f2.py" and "md5" in s for f, _, s in found())
    # A crash between the findings and the marks: the run is repeated under its number, nothing is lost or doubled.
    put("new.py", b"hashlib.md5(7)", 3000)
    assert scan() == 1
    last = max(os.listdir(f"{out}/ledger"), key=lambda x: int(x.split("=")[1]) if "=" in x else -1)
    shutil.rmtree(f"{out}/ledger/{last}")
    assert not any(f == "new.py" for f, _, _ in found())
    assert scan() == 1 and found() == whole() and scan() == 0


def test_ledger_names_files_or_joins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "NAMED", 0)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("hashlib.md5(x)")
    assert ledger.scan_pending(spark, str(tmp_path / "in"), str(tmp_path / "out")) == 1 and ledger.findings(spark, str(tmp_path / "out")).count() == 1


def test_merged_batches_in_any_order(spark, finding, tmp_path):
    """The most severe wins, the first among equals, at the first position, however the findings are dealt to batches."""
    df = finding(dict(severity="LOW"), dict(severity="CRITICAL", impact="second"), dict(severity="CRITICAL", impact="third"), dict(line=2), dict(line=2, repo_id="b"),
                 dict(line=None, file=None), dict(line=None, file=None), dict(severity="UNRATED", line=9), dict(severity="LOW", line=9))
    rows, want = df.collect(), sorted(map(repr, aggregate.deduplicate(df).collect()))
    for i, order in enumerate(itertools.islice(itertools.permutations(range(9)), 0, 360_000, 90_001)):
        table = str(tmp_path / f"t{i}")
        for number, part in enumerate((order[:2], order[2:5], [], order[5:], order[:1]), 1):
            merged.merge_batch(spark.createDataFrame([rows[k] for k in part], schemas.FINDINGS), number, table, buckets=3)
            if number == 2:  # repeated after a crash
                merged.merge_batch(spark.createDataFrame([rows[k] for k in part], schemas.FINDINGS), number, table, buckets=3)
        assert sorted(map(repr, merged.merged_findings(spark, table).collect())) == want
        kept = [f"{v}/{b}" for v in os.listdir(f"{table}/rows") for b in os.listdir(f"{table}/rows/{v}") if b.startswith("bucket=")]
        assert len(kept) <= 6  # at most two versions of each bucket
    assert merged.merged_findings(spark, str(tmp_path / "none")).count() == 0


def test_merged_forgets_what_is_not_seen(spark, finding, tmp_path):
    table = str(tmp_path / "t")
    for number in range(1, 6):
        merged.merge_batch(finding(dict(line=number), dict(line=100)), number, table, buckets=1, keep=2)
    assert sorted(r.line for r in merged.merged_findings(spark, table).collect()) == [4, 5, 100]


def test_merged_batches_are_written_once_a_level(spark, finding, tmp_path, monkeypatch):
    """A batch is added as it is; stored findings are written again when a level is full, and then once."""
    monkeypatch.setattr(merged, "FAN", 3)
    table, all_rows, written = str(tmp_path / "t"), [], []
    for number in range(1, 10):
        rows = finding(*(dict(line=10 * number + i) for i in range(4)), dict(line=1, severity="CRITICAL" if number == 5 else "LOW", ord=100 - number))
        all_rows += rows.collect()
        merged.merge_batch(rows, number, table)
        written.append(spark.read.parquet(f"{table}/rows/version={number}").count())
        parts = merged._valid(spark, table)
        assert len(parts) <= 4 and len(os.listdir(f"{table}/rows")) <= 6 and len([x for x in os.listdir(f"{table}/commits")]) <= 2
    assert written == [5, 5, 13, 5, 5, 13, 5, 5, 37] and parts == {9: 2}
    want = sorted(map(repr, aggregate.deduplicate(spark.createDataFrame(all_rows, schemas.FINDINGS)).collect()))
    assert sorted(map(repr, merged.merged_findings(spark, table).collect())) == want
    few = merged.merged_findings(spark, table, ["ord", "repo_id", "line"])
    assert few.columns == ["ord", "repo_id", "line"] and sorted((r.line, r.ord) for r in few.collect())[0] == (1, 91)
