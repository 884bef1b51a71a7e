"""Positions inside a group, without ever holding a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A scope of more than WHOLE rows is cut, together with the other large ones, in PARTS parts; the sketch that places the cuts errs by a tenth of a part at most.
SIDE, WHOLE = 32, 1_000_000
PARTS = SIDE * SIDE
ACCURACY = 10 * PARTS


def _quantiles(df: DataFrame, by: str) -> Column:
    """The PARTS - 1 cuts of the whole number `by`, from a mergeable sketch, as one array; null without rows."""
    points = [(i + 1) / PARTS for i in range(PARTS - 1)]
    return df.select(F.percentile_approx(F.col(by).cast("bigint"), points, ACCURACY).alias("all")).scalar()


def parted(df: DataFrame, by: str, out: str = "_part", cuts: Column | None = None) -> DataFrame:
    """Adds the part of each row when the rows are cut, in the order of the whole number `by`, in PARTS parts of about equal size.

    The cuts are quantiles of the rows, so they follow them, however uneven their numbers are; a row finds its part by halving.
    Nulls come first.
    """
    placed = df.withColumns({"_all": _quantiles(df, by) if cuts is None else cuts, out: F.lit(0)})
    step = PARTS // 2
    while step:
        placed = placed.withColumn(out, F.col(out) + F.when(F.element_at("_all", F.col(out) + step) <= F.col(by), step).otherwise(0))
        step //= 2
    return placed.drop("_all")


def rank_within(df: DataFrame, scope: list[str], by: str, ties: tuple[str, ...] = (), out: str = "position", size: str | None = None, whole: int | None = None) -> DataFrame:
    """Adds the 1-based position of each row inside its scope, ordered by the whole number `by`, then by `ties`; as `size`, the rows of the scope.

    A window over the scope alone would sort a scope that holds a third of all rows in one task. Scopes of more than `whole`
    rows, WHOLE if not given, are numbered inside (scope, part) instead, and the sizes of the parts before are added up. There are
    at most as many such scopes as the table has millions of rows, so they and their parts are broadcast; where there are
    none, their cuts and sizes cost nothing, and the rows are shuffled once.
    """
    def beside(rows: DataFrame, keys: list[str]):
        """Keys under other names, and the condition that they are the same."""
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return F.broadcast(rows.withColumnsRenamed({c: f"_{c}" for c in keys})), same

    large, same = beside(df.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > (whole or WHOLE)), scope)
    parts = parted(df.join(large, same, "left"), by, "_cut", _quantiles(df.join(large, same, "left_semi"), by))
    parts = parts.withColumn("_bucket", F.when(F.col("_n").isNotNull(), F.col("_cut")).otherwise(-1)).drop("_cut", *[f"_{c}" for c in scope])
    earlier = Window.partitionBy(*scope).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*scope, "_bucket"]
    sizes = parts.filter(F.col("_n").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    offsets, same = beside(sizes.select(*keys, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")), keys)
    numbered = parts.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys).orderBy(by, *ties)))
    if size:
        numbered = numbered.withColumn(size, F.coalesce("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    joined = numbered.join(offsets, same, "left").withColumn(out, (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("bigint"))
    return joined.drop("_n", "_inside", "_before", "_bucket", *[f"_{c}" for c in keys])


def top_k(df: DataFrame, k: int, by: list, per: list[str] | None = None) -> DataFrame:
    """The first k rows, or the first k of each group; the engine keeps only k per task before it shuffles."""
    if not per:
        return df.orderBy(*by).limit(k)
    window = Window.partitionBy(*per).orderBy(*by)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k).drop("_rank")
