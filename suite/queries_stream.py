"""Streaming forms, run to the end of their input; they must give what the batch forms give."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codesieve import schemas
from codesieve.fixed import noise
from codesieve.operators.weak_hash import hash_findings, scan_weak_hash
from codesieve.session import shared_folder
from codesieve.sources import tree
from codesieve.streaming import ledger, merged
from codesieve.streaming.incremental import dedup_stream, stream_findings
from suite import oracle_scan as o
from suite import views
from suite.oracle_views import FINDINGS, SRC_FILES
from suite.queries_findings import DEDUP
from suite.registry import register, with_


def _stream(spark, sf_dir, build):
    """Run a stream over the document table into a folder of its own and read that."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = views.table(spark, sf_dir, "documents").schema
    documents = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet")
    query = (build(views.corpus(documents)).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


_COLUMNS = ["repo_id", "id", "severity", "file", "line", "code_snippet", "ord"]
register("stream_weak_hash", lambda s, d: _stream(s, d, lambda src: hash_findings(scan_weak_hash(src)).select(*_COLUMNS)),
         with_(o.hash_findings_ctes(), f"SELECT {', '.join(_COLUMNS)} FROM hash_findings"))
register("dedup_stream", lambda s, d: _stream(s, d, lambda src: dedup_stream(hash_findings(scan_weak_hash(src))).select("repo_id", "fingerprint")).select(
            "repo_id", F.col("fingerprint")),
         with_(o.hash_findings_ctes(), "SELECT DISTINCT repo_id, md5(file || ':' || line || ':' || category || ':' || code_snippet) AS fingerprint FROM hash_findings"))


def _merged(spark, sf_dir):
    """All findings as a stream of several batches, merged into buckets."""
    folder = f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}"
    # Each task writes its findings where it has them; a third of the files, by bytes about a third of the rows, is a batch.
    views.findings(spark, sf_dir).write.parquet(f"{folder}/in")
    files = len(spark.read.schema(schemas.FINDINGS).parquet(f"{folder}/in").inputFiles())
    stream = stream_findings(spark, f"{folder}/in", max_files=max(1, -(-files // 3)))
    merged.merge_stream(stream, f"{folder}/table", f"{folder}/state", buckets=8)
    return merged.merged_findings(spark, f"{folder}/table", _KEPT)


_KEPT = ["repo_id", "id", "severity", "category", "file", "confidence", "ord"]
register("merged_findings", _merged, with_([FINDINGS, DEDUP], f"SELECT {', '.join(_KEPT)} FROM unique_findings"))


def _pending(spark, sf_dir):
    """Every file as listed, and a ledger of two runs: finished, failed, changed since, mark taken away."""
    n = F.length("content")
    files = views.src_files(spark, sf_dir).select("repo_id", "path", n.cast("long").alias("n"))
    listing = files.withColumn("modified", F.timestamp_seconds("n"))
    state = F.when(F.col("n") % 3 == 0, ledger.FAILED).otherwise(ledger.DONE)
    first = files.where("n % 4 != 0").select("repo_id", "path", F.timestamp_seconds(F.col("n") - F.when(F.col("n") % 5 == 0, 1).otherwise(0)).alias("modified"), state.alias("state"), F.lit(None).cast("string").alias("error"), F.lit(1).cast("long").alias("run"))
    second = files.where("n % 4 != 0 and n % 7 = 0").select("repo_id", "path", F.timestamp_seconds("n").alias("modified"), F.lit(ledger.OPEN).alias("state"), F.lit(None).cast("string").alias("error"), F.lit(2).cast("long").alias("run"))
    return ledger.pending(listing, first.unionByName(second)).select("repo_id", "path", "n")


register("pending_files", _pending, with_([SRC_FILES], """SELECT repo_id, path, n FROM (SELECT repo_id, path, length(content) AS n FROM src_files) f
  WHERE n % 4 = 0 OR n % 5 = 0 OR n % 7 = 0"""))


def _tree(spark, sf_dir, files=None):
    """All files as a tree, a folder for each repository; every text again in a folder no scan enters, and again with a byte that is not UTF-8."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    files = views.src_files(spark, sf_dir) if files is None else files
    body = F.col("content").cast("binary")
    placed = lambda folder, content: F.struct(F.concat_ws("/", "repo_id", *folder, "path").alias("place"), content.alias("content"))
    copies = F.array(placed([], body), placed([F.lit("vendor")], body), placed([F.lit("_odd")], F.concat(body, F.unhex(F.lit("FF")))))
    tree.write_tree(files.select(F.inline(copies)), root)
    return root


register("scan_tree", lambda s, d: tree.scan_tree(s, _tree(s, d), None).select("repo_id", "path", "length", F.md5(F.col("content").cast("binary")).alias("content_md5"), "problem"),
         with_([SRC_FILES], """SELECT repo_id, path, CAST(strlen(content) AS BIGINT) AS length, md5(content) AS content_md5, NULL AS problem FROM src_files
           UNION ALL SELECT repo_id, '_odd/' || path, CAST(strlen(content) + 1 AS BIGINT), NULL, 'not UTF-8' FROM src_files"""))


def _resumed(spark, sf_dir):
    """The findings of a tree that grew between two scans, with all marks of one repository taken away before the third."""
    files = views.src_files(spark, sf_dir)
    root, out = _tree(spark, sf_dir, files.where("length(content) % 2 = 0")), f"{shared_folder(spark)}/resumed-{uuid.uuid4().hex}"
    ledger.scan_pending(spark, root, out, None)
    rest = files.where("length(content) % 2 != 0 or content is null")
    tree.write_tree(rest.select(F.concat_ws("/", "repo_id", "path").alias("place"), "content"), root)
    ledger.scan_pending(spark, root, out, None)
    ledger.take_marks_away(spark, out, files.where(F.col("repo_id") == files.agg(F.min("repo_id")).scalar()))
    ledger.scan_pending(spark, root, out, None)
    return ledger.findings(spark, out)


_FOUND = "repo_id, id, severity, file, line, origin, ord"
register("resumed_findings", lambda s, d: _resumed(s, d).select(*_FOUND.split(", ")),
         with_(o.hash_findings_ctes() + o.xpath_findings_ctes(), f"""SELECT * FROM (SELECT {_FOUND} FROM hash_findings UNION ALL SELECT {_FOUND} FROM xpath_findings)
           WHERE {' OR '.join([f"ends_with(lower(file), '{x}')" for x in noise.SCAN_SUFFIXES] + [f"contains(file, '{x}')" for x in noise.SCAN_NAMES])}"""))
