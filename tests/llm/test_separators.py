from codesieve.llm import packing, separators


def test_counts(spark):
    rows = [(1, None), (2, ""), (3, "a b <|endoftext|> c"), (4, "word " * 300), (4, "word " * 300), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted((d or 0, len(packing.Encoder(None)(t or "")) // 4) for d, t in rows)
    for block in (7, 1 << 18):
        assert sorted((r.doc_id or 0, r.n_tokens) for r in separators.counts(df, block_ids=block).collect()) == want
    assert separators.counts(df.where("false")).count() == 0


def test_blocks_are_small_and_the_list_is_read_without_them(spark):
    df = spark.createDataFrame([(i, "word " * 50_000) for i in range(4)], "doc_id long, text string").coalesce(1)
    flat = separators.flat_files(df).collect()
    assert max(len(r.data) for r in flat if not r.listed) < 512 << 10 and [r.doc_id for r in flat if r.listed] == [0, 1, 2, 3]
    plan = separators.counts(df)._jdf.queryExecution().executedPlan().toString()
    assert any("ReadSchema" in x and "doc_id" in x and "data" not in x for x in plan.split("\n"))
