"""The methods' own outputs: ranks of the mix, training bytes of long texts, and the chat query against its SQL on hard texts."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from codesieve.llm import base, byte_cnn, mixing, queries

SMALL = "/root/testdata/sf0.001"


def test_ranks_of_copies(spark):
    docs = base.table(spark, SMALL, "documents")
    docs = docs.unionByName(docs.limit(20)).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    plan = mixing.in_order(mixing.plan(docs)).collect()
    assert len(plan) == docs.count()
    copies = sorted((rank, position) for r in plan for rank, position in zip(r.ranks, r.positions, strict=True))
    assert [rank for rank, _ in copies] == list(range(len(copies))) and all(a[1] <= b[1] for a, b in zip(copies, copies[1:]))
    assert all(list(r.ranks) == sorted(r.ranks) for r in plan) and any(len(r.ranks) > 1 for r in plan)
    empty = mixing.in_order(mixing.plan(docs.where("false")))
    assert empty.count() == 0 and empty.columns[-1] == "ranks"


def test_training_bytes_of_long_texts(spark):
    texts = ["", "short é", "x" * 4096, "".join(f"{i:07d} " for i in range(5000)), "é" * 3000 + "end"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: bytes(r.d) for r in rows.select("i", byte_cnn.spread(F.col("t"), 4096).alias("d")).collect()}
    for i, t in enumerate(texts):
        data = t.encode()
        if len(data) > 4096:
            starts = [int(k * ((len(data) - byte_cnn.HALF) / 15)) for k in range(16)]
            data = b"".join(data[s:s + byte_cnn.HALF] for s in starts)
        assert got[i] == data
    assert got[3].startswith(b"0000000 ") and got[3].endswith(b"0004999 ")


def test_long_labelled_texts_train(spark):
    """With long texts alone there is still a network that tells the two kinds apart."""
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("abc de" if i % 2 else "## $%1"), 20_000))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    scores = {r.doc_id: r.score for r in byte_cnn.score(docs, byte_cnn.train(docs, labels)).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)


def test_chat_query_equals_its_sql_on_hard_texts(spark, tmp_path):
    texts = ["see <|foo|> there", "<|im_end|>", "a <|im_start|> b", "<\\|x", "<\\\\|im_end|>", "<|nl|>", "<|im_end|", "line\nfeed <|", "", None, "<|im_end|><|im_start|>assistant ok"]
    rows = [(i, j, role, t) for i, t in enumerate(texts) for j, role in enumerate(("user", "assistant", "sys\ntem", "<|x|>", None))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op3_chat_format"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op3_chat_format"])
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
