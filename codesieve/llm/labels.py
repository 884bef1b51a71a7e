"""Labelled rows for the trained operators: a bounded sample, and never a held-out document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents train a model.
SAMPLE = 3000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of at most `size` labelled documents that are not held out, the first by a hash of the id.

    The chosen labels are at most `size` rows, so they are broadcast. Labels that are null are left out.
    """
    usable = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
