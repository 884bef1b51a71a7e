"""The engine's input tables, derived from the given parquet tables.

Every view is one projection (and at most one join) of whole tables, so its
size grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.sources.files import spread
from suite import idioms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of the packed order lines read as one piece, about 1.3 million rows; a finding is forty times as wide.
PIECE = 16 << 20


def pieces(rows: DataFrame) -> int:
    """As many pieces as there are cores, or more, so that a task's findings can be sorted in memory."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // PIECE))


def _beside(rows: DataFrame, few: DataFrame, same: Column) -> DataFrame:
    """`rows` joined to `few`. Rows that a broadcast join leaves where they are read are spread before; a shuffled join deals them out by itself."""
    joined = rows.join(few, same)
    return joined if "BroadcastHashJoin" not in str(joined._jdf.queryExecution().sparkPlan()) else spread(rows, pieces(rows)).join(few, same)


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _number(*parts: Column) -> Column:
    """A fixed 60-bit number of a key, as text hashes are the same everywhere."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("bigint")


def _path(doc_id: Column) -> Column:
    return F.concat(
        _pick(idioms.DIRECTORIES, doc_id % len(idioms.DIRECTORIES)), F.lit("/"), F.when(doc_id % 5 == 0, "test_").otherwise(""), F.lit("doc_"),
        doc_id.cast("string"), _pick(idioms.SUFFIXES, doc_id % len(idioms.SUFFIXES)))


def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def corpus(doc: DataFrame) -> DataFrame:
    idiom = _pick(idioms.IDIOMS, F.col("doc_id") % len(idioms.IDIOMS))
    content = F.concat_ws("\n", F.col("text"), idiom, F.split("text", "\n")[0])
    return doc.select(F.col("source").alias("repo_id"), _path(F.col("doc_id")).alias("path"), content.alias("content"))


def html_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return page.select(F.lit("web").alias("repo_id"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))


def html_rules(spark: SparkSession) -> DataFrame:
    from codesieve import schemas
    rows = [("vector", n, r[0], "*", r[4], "html", "Html", r[0], r[1], r[2], None, r[3], None) for n, r in enumerate(idioms.HTML_RULES, 1)]
    return spark.createDataFrame(rows, schemas.VECTOR_RULES)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk findings out of the order lines."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    line = table(spark, sf_dir, "lineitem")
    line = _beside(line, part, F.col("l_partkey") == F.col("p_partkey"))
    flags = None
    for flag, status, severity in idioms.SEVERITIES:
        test = (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status)
        flags = F.when(test, severity) if flags is None else flags.when(test, severity)

    def by_type(i):
        out = None
        for row in idioms.CATEGORIES:
            value = F.lit(row[i]).cast("string")
            out = F.when(F.col("p_type") == row[0], value) if out is None else out.when(F.col("p_type") == row[0], value)
        return out

    number = _number(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
                     F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    file = F.concat(
        _pick(idioms.DIRECTORIES, F.col("l_partkey") % len(idioms.DIRECTORIES)), F.lit("/"), F.when(F.col("l_partkey") % 9 == 0, "test_").otherwise(""),
        F.lit("part_"), (F.col("l_partkey") % 40).cast("string"), F.lit(".py"))
    return line.select(
        F.concat(F.lit("repo"), F.col("l_suppkey").cast("string"), F.lit("-"), (F.col("l_partkey") % 8).cast("string")).alias("repo_id"),
        F.concat(F.lit("F-"), number.cast("string")).alias("id"),
        flags.otherwise("UNRATED").alias("severity"),
        by_type(1).alias("category"), by_type(2).alias("cwe"), by_type(3).alias("owasp"),
        file.alias("file"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber").cast("int")).alias("line"),
        _pick(idioms.SNIPPETS, F.col("l_orderkey") % len(idioms.SNIPPETS)).alias("code_snippet"),
        _pick(idioms.DESCRIPTIONS, F.col("l_partkey") % len(idioms.DESCRIPTIONS)).alias("description"),
        F.lit("impact").alias("impact"), F.lit("remedy").alias("remediation"), F.array().cast("array<string>").alias("references"),
        F.when(F.col("l_tax") != 0, F.round(F.col("l_discount") * 100, 1)).alias("cvss_score"),
        _pick(["HIGH", "MEDIUM", "LOW"], F.col("l_linenumber") % 3).alias("confidence"),
        F.lit("bulk").alias("origin"),
        number.alias("ord"),
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    doc = table(spark, sf_dir, "documents").join(labels, "doc_id")
    idiom = F.col("doc_id") % len(idioms.IDIOMS)
    return doc.select(
        F.concat(F.lit("gt"), F.col("doc_id").cast("string")).alias("id"), _path(F.col("doc_id")).alias("file"),
        F.nullif(_pick(idioms.IDIOM_CWE, idiom), F.lit(0)).alias("cwe"),
        ((F.col("toxic") == 1) | (F.col("doc_id") % 3 != 0)).alias("is_vulnerable"),
        F.when(F.col("doc_id") % 2 == 0, F.size(F.split("text", "\n")) + 2).alias("line"),
        _pick(idioms.DIRECTORIES, F.col("doc_id") % len(idioms.DIRECTORIES)).alias("category"),
    )


def norm_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of several runs of a detector that is right about most files, under differing path prefixes."""
    doc = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    rows = doc.select("*", F.explode(F.sequence(F.lit(0), F.lit(idioms.RUNS - 1))).alias("run"))
    rows = rows.filter((F.col("doc_id") % (F.col("run") + 4) != 0) & (F.col("doc_id") % 13 != 0))
    prefix = _pick(["./", "/srv/corpus/", "", "corpus\\"], F.col("doc_id") % 4)
    cwe = F.when(F.col("doc_id") % 10 == 0, 20).otherwise(F.nullif(_pick(idioms.IDIOM_CWE, F.col("doc_id") % len(idioms.IDIOMS)), F.lit(0)))
    return rows.select(
        F.concat(F.lit("run"), F.col("run").cast("string")).alias("run_id"), F.concat(prefix, _path(F.col("doc_id"))).alias("file"),
        F.when(F.col("doc_id") % 6 != 1, (F.col("n") + F.col("doc_id") % 8).cast("int")).alias("line"), cwe.alias("cwe"),
        F.lit("HIGH").alias("severity"), F.lit("rule").alias("rule_id"))


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    model = None
    for kind, name in idioms.MODELS:
        model = F.when(F.col("event_type") == kind, name) if model is None else model.when(F.col("event_type") == kind, name)
    return ev.select(
        F.col("event_id").alias("request_id"), "ts", model.alias("model"), F.floor(F.col("value") * 10).cast("bigint").alias("input_tokens"),
        F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0).cast("bigint")).alias("output_tokens"),
        _pick(idioms.TASKS, F.col("event_id") % len(idioms.TASKS)).alias("task"))


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns wrapped as a JSON array, a fenced object or broken text."""
    turn = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    said = F.regexp_replace("text", "[^A-Za-z0-9 .,]", "")
    place = (F.col("turn") + 1).cast("string")
    array = F.concat(F.lit('Result:\n[{"severity":"HIGH","category":"XSS","line":'), place, F.lit(',"description":"'), said,
                     F.lit('"},{"category":"SQL Injection","cwe":"CWE-89","cvss_score":8.5}]\nDone.'))
    fenced = F.concat(F.lit('Here:\n```json\n{"findings":[{"severity":"LOW","category":"Weak crypto","line":'), place,
                      F.lit(',"code_snippet":"x = 1","confidence":"HIGH","description":"'), said, F.lit('"}]}\n```\nEnd'))
    broken = F.concat(F.lit('Sorry [ {"severity": '), said)
    return turn.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.concat(F.lit("r"), (F.col("conv_id") % 10).cast("string")).alias("repo_id"),
        F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".py")).alias("path"),
        F.when(F.col("conv_id") % 3 == 0, array).when(F.col("conv_id") % 3 == 1, fenced).otherwise(broken).alias("raw"))


def chat_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as chat completions; every fourth conversation lacks its choices."""
    turn = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    said = F.regexp_replace("text", "[^A-Za-z0-9 .,]", "")
    body = F.concat(F.lit('{"choices":[{"message":{"content":"'), said, F.lit('"}}],"usage":{"total_tokens":'), F.length(said).cast("string"), F.lit("}}"))
    return turn.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
                       F.when(F.col("conv_id") % 4 == 0, '{"usage":{"total_tokens":5}}').otherwise(body).alias("response"))


def file_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = table(spark, sf_dir, "documents")
    return doc.select(F.floor(F.col("doc_id") / 5).cast("bigint").alias("batch_id"), _path(F.col("doc_id")).alias("path"),
                      (F.col("doc_id") % 3).alias("findings"), (F.col("n_chars") / 1000).alias("seconds"), F.lit(None).cast("string").alias("error"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def scanner_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Semgrep result, one SARIF log and one findings file as JSON text per event."""
    ev = spread(table(spark, sf_dir, "events")).select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    k, kind = F.coalesce("k", F.lit("0")), F.col("event_type")
    cwe = F.when(F.col("event_id") % 3 == 0, _text('["none","CWE-', k, ': text"]')).when(F.col("event_id") % 3 == 1, _text('"CWE-', k, '"')).otherwise("null")
    semgrep = _text('{"results":[{"path":"/srv/app/src/', kind, '_', k, '.py","check_id":"rule.', kind, '","start":{"line":', k,
                    '},"extra":{"severity":"error","metadata":{"cwe":', cwe, '}}},{"path":"/else/x.py","start":{"line":1},"extra":{}}]}')
    level = F.when(F.col("event_id") % 2 == 0, ',"level":"error"').otherwise("")
    sarif = _text('{"runs":[{"tool":{"driver":{"rules":[{"id":"r1","properties":{"tags":["security","external/cwe/cwe-0', k,
                  '"]}},{"id":"r2","properties":{"tags":["cwe-none","other-7"]}}]}},"results":[{"ruleId":"r1"', level,
                  ',"locations":[{"physicalLocation":{"artifactLocation":{"uri":"src/', kind, '.js"},"region":{"startLine":', k,
                  '}}},{"physicalLocation":{"artifactLocation":{"uri":"src/b.js"}}}]},{"ruleId":"r2","properties":{"severity":"note"},"locations":[',
                  '{"physicalLocation":{"artifactLocation":{"uri":"/srv/app/c.js"},"region":{"startLine":3}}}]}]}]}')
    found = _text('[{"id":"X', F.col("event_id"), '","severity":"HIGH","category":"XSS","file":"', kind, '.py","line":', k, ',"cvss_score":7.5},{"file":"plain.py"}]')
    envelope = F.when(F.col("event_id") % 5 == 0, _text('[{"file":"', kind, '.py","line":', k, ',"cwe":', k, ',"severity":"low"}]')).otherwise(
        _text('{"tool":"t-', kind, '","dry_run":true,"findings":[{"file":"', kind, '.py","line":null,"cwe":', k, ',"severity":"high","rule_id":"q"}]}'))
    return ev.select(F.col("event_id").cast("string").alias("document"), semgrep.alias("semgrep"), sarif.alias("sarif"), found.alias("findings"), envelope.alias("envelope"))


def expected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected-result rows of the documents whose idiom has a known category."""
    from codesieve.fixed.models import CATEGORY_CWE
    doc = table(spark, sf_dir, "documents")
    place = F.col("doc_id") % len(CATEGORY_CWE)
    return doc.select(_text("Case", F.col("doc_id")).alias("test_name"), _pick([c for c, _ in CATEGORY_CWE], place).alias("category"),
                      F.when(F.col("doc_id") % 3 == 0, "True").otherwise("false").alias("real_vulnerability"), _pick([n for _, n in CATEGORY_CWE], place).alias("cwe"))


def labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = table(spark, sf_dir, "documents")
    return doc.select(_text("CWE-0", F.col("doc_id") % 90 + 10, "_author_", F.col("doc_id"), ".py").alias("ID"))


def labelled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 7 != 0)
    return doc.select(_text("Testcases_Insecure_Code/CWE-0", F.col("doc_id") % 90 + 10, "/author_", F.col("doc_id"), ".py").alias("path"))


def commented_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that open with a label comment."""
    cwe = F.col("doc_id") % 900
    bad = _text("# VULNERABILITY: Kind ", F.col("doc_id") % 5, "\n# SEVERITY: HIGH\n# CWE: CWE-", cwe, "\n# DESCRIPTION: text ", F.col("doc_id"), "\n\n")
    good = _text("# SECURE CODE: Kind ", F.col("doc_id") % 5, "\n# PATTERN: safe\n\n")
    head = F.when(F.col("doc_id") % 3 == 0, bad).when(F.col("doc_id") % 3 == 1, good).otherwise("")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), _path(F.col("doc_id")).alias("path"), F.concat(head, F.col("text")).alias("content"))
