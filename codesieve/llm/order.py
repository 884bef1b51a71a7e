"""A place for each row in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.base import written

LOWEST = -(1 << 63)


def ranked(df: DataFrame, *by: str, name: str = "rank") -> DataFrame:
    """`df` with its 0-based rank by the given columns.

    Rows are range-partitioned and numbered within their partition; the written table fixes the partitions. The counts
    of the partitions, as many rows as there are partitions, give each partition its first rank and are broadcast.
    """
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by)
    parts = written(parts.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    firsts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    firsts = firsts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    return parts.join(F.broadcast(firsts), "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def by_key(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(key, doc_id, text, row) and whether ids repeat: a key per document that follows the ids, null ids first.

    The key is the id itself where ids are unique; else the rank of (id, hash of the text), which rows equal in both
    share. `row` holds the document's own columns.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    ids = F.coalesce("doc_id", F.lit(LOWEST))
    if df.groupBy(ids.alias("k")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return df.withColumn("key", ids), False
    df = df.withColumns({"id": ids, "mark": F.xxhash64("text")})
    return df.join(ranked(df.select("id", "mark").distinct(), "id", "mark", name="key"), ["id", "mark"]).drop("id", "mark"), True
