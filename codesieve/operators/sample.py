"""Stratified samples. A row's draw is a hash of its id and the seed, so a sample can be repeated anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions.identity import file_no
from codesieve.operators.merge import first_per_key
from codesieve.operators.ranking import rank_within


def draw(key: Column, seed: int) -> Column:
    """An even draw from 60 bits."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 15), 16, 10).cast("bigint")


#: Samples of up to so many rows per stratum are drawn by a limited rank: a task passes on no more than that.
LIMITED = 100_000


def _picked(entries: DataFrame, strata: list[str], sizes: DataFrame, seed: int, most: int) -> DataFrame:
    """The rows with the lowest draws of each stratum, `_take` of them; `most`: an upper bound of `_take`."""
    drawn = entries.withColumn("_draw", draw(F.col("id"), seed))
    if most <= LIMITED:
        place = F.row_number().over(Window.partitionBy(*strata).orderBy("_draw", "id"))
        drawn = drawn.withColumn("_place", place).filter(F.col("_place") <= most)
    else:
        drawn = rank_within(drawn, strata, "_draw", ("id",), "_place")
    same = F.lit(True)
    for s in strata:
        same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
    return drawn.join(sizes, same).filter(F.col("_place") <= F.col("_take")).select(*entries.columns)


def largest_remainder(entries: DataFrame, strata: list[str], target: int) -> DataFrame:
    """Rows per stratum: the whole part of its share, and one more for the largest remainders (ties: first seen)."""
    counts = entries.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("_seen"))
    total = entries.select(F.count(F.lit(1))).scalar()
    shared = counts.withColumn("_exact", F.col("n") / total * target).withColumn("_base", F.floor("_exact"))
    everything = Window.partitionBy()
    by_rest = Window.orderBy((F.col("_exact") - F.col("_base")).desc(), "_seen")
    left = F.lit(target) - F.sum("_base").over(everything)
    extra = (F.row_number().over(by_rest) <= left).cast("int")
    return shared.select(*strata, "n", F.least(F.col("_base") + extra, F.col("n")).alias("take"))


def sample_largest_remainder(entries: DataFrame, strata: list[str], target: int = 400, seed: int = 42) -> DataFrame:
    sizes = largest_remainder(entries, strata, target).select(*[F.col(s).alias(f"_{s}") for s in strata], F.col("take").alias("_take"))
    return _picked(entries, strata, sizes, seed, target)


def sample_fraction(entries: DataFrame, strata: list[str], target: int, seed: int = 42) -> DataFrame:
    """Each stratum gives its share, rounded half to even, and at least one row."""
    total = entries.select(F.count(F.lit(1))).scalar()
    counts = entries.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    take = F.greatest(F.lit(1), F.bround(F.col("n") * (F.lit(float(target)) / total), 0).cast("bigint"))
    sizes = counts.select(*[F.col(s).alias(f"_{s}") for s in strata], take.alias("_take"))
    return _picked(entries, strata, sizes, seed, target + 1)


def sample_spread(entries: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """One drawn row per key, then the first n of those in a second drawn order."""
    drawn = entries.withColumn("_draw", draw(F.col("id"), seed))
    one = first_per_key(drawn, [F.col(key)], ["_draw", "id"])
    return one.orderBy(draw(F.col("id"), seed + 1), "id").limit(n).drop("_draw")


def assign_batches(src_files: DataFrame, size: int = 5) -> DataFrame:
    """Batches of `size` files, consecutive in the fixed file order of each repository."""
    numbered = rank_within(src_files.withColumn("_no", file_no(F.col("repo_id"), F.col("path"))), ["repo_id"], "_no", ("path",), "_place")
    return numbered.withColumn("batch_id", F.floor((F.col("_place") - 1) / size).cast("bigint")).drop("_no", "_place")


def run_statistics(file_runs: DataFrame) -> DataFrame:
    """Totals of a run log: batches run side by side, so the slowest one is the parallel time."""
    batches = file_runs.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("findings").alias("findings"), F.sum("seconds").alias("seconds"))
    return batches.agg(
        F.sum("files").alias("total_files"), F.count(F.lit(1)).alias("total_batches"), F.sum("findings").alias("total_findings"),
        F.coalesce(F.max("seconds"), F.lit(0.0)).alias("parallel_time"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("sequential_time"),
    ).select("*",
             F.when(F.col("parallel_time") > 0, F.col("sequential_time") / F.col("parallel_time")).otherwise(1.0).alias("speedup"),
             F.when(F.col("parallel_time") > 0, F.col("total_files") / F.col("parallel_time")).otherwise(0.0).alias("files_per_second"))


def estimate_cost(file_runs: DataFrame, tokens_per_file: int = 1000, usd_per_million: float = 0.15) -> DataFrame:
    return file_runs.agg((F.count(F.lit(1)) * tokens_per_file / F.lit(1_000_000) * usd_per_million).alias("cost"))
