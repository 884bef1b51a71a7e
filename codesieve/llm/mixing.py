"""Mixing sources to target weights with a time-varying curriculum. Built-in functions only.

Targets: the sources in code-point order (null last) get the weights in turn; they share the sum of all sizes by weight,
no target above LIMIT times its source's size, and what a source cannot take is shared again among the others.

Demand: each source has a weight schedule over training time 0 to 1, straight between its knots. Its integral, scaled to
the target, is the words demanded up to a time. A source's documents lie one after the other in a fixed shuffled order
(by MD5 of the id; of source and text where there is no id or the source has it again), as often as the target needs; the last pass ends in the middle of a document. The middle of each copy,
as a share of the target, is put through the inverse of the demand, which gives the copy its training position.

No step sees a whole source: documents are summed up in BUCKETS slices of the shuffled order, and the slices' sums give
each slice its place. Sources are ranked over range partitions.

Defined cases: null text has size 0, and size 0 is taken 0 times; a null source is one source, the last; repeated rows and
rows without an id are documents of their own, in a fixed order among ties; with no words at all every target is 0; no
rows give no rows; `mix` passes all columns on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.base import SPACES, words, written
from codesieve.llm.order import ranked

WEIGHTS, LIMIT, BUCKETS = (1, 2, 3), 3, 4096
#: Weight of a source over time, by its weight: small sources early, large ones late.
SCHEDULES = {1: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 3: ((0.0, 0.5), (0.5, 1.25), (1.0, 1.25))}


def targets(sizes: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row for each source."""
    order = sizes.withColumns({"_nil": F.col("source").isNull()})
    order = ranked(order, "_nil", "source").drop("_nil")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    order = written(order.select("source", "source_size", weight.cast("double").alias("weight")))
    total, all_weight = order.agg(F.sum("source_size"), F.sum("weight")).first()
    share, last = (total or 0) / (all_weight or 1), None
    cap = limit * F.col("source_size")
    while True:  # ends at the latest when every source has met its limit
        full = F.col("weight") * F.lit(float(share)) >= cap
        count, rest, open_weight = order.agg(F.count(F.when(full, 1)), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if count == last or not open_weight:
            break
        last, share = count, (total - (rest or 0)) / open_weight
    return order.withColumn("target", F.least(F.col("weight") * F.lit(float(share)), cap.cast("double")))


def position(share: Column, schedule) -> Column:
    """The time up to which a schedule demands the given share of its whole demand."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:])]
    whole, done, out = sum(areas), 0.0, F.lit(float(schedule[-1][0]))
    parts = []
    for (t, w), (u, v), area in zip(schedule, schedule[1:], areas):
        slope = (v - w) / (u - t)
        left = F.greatest(share * whole - done, F.lit(0.0))
        root = w + F.sqrt(F.greatest(F.lit(w * w) + 2 * slope * left, F.lit(0.0)))
        parts.append((done + area, F.when(root > 0, t + 2 * left / root).otherwise(t)))
        done += area
    for upto, at in reversed(parts):
        out = F.when(share * whole <= upto, F.least(at, F.lit(float(schedule[-1][0])))).otherwise(out)
    return out


def plan(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT, schedules=SCHEDULES) -> DataFrame:
    """What the mix takes of each document, and where.

    (doc_id, source, mark, size, source_size, target, taken, passes, extra, positions): `passes` whole copies and the first
    `extra` words of one more; `positions` has the training position of each copy, ascending. `mark` is a hash of the text.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("mark"), F.size(words(text)).cast("long").alias("size"))
    rows = written(rows)
    again = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"), F.col("source").alias("within")).agg(F.count("*").alias("n"))
    again = written(again.where("n > 1").select("id", "within", F.lit(True).alias("again")))
    if again.isEmpty():
        rows = rows.withColumn("again", F.col("doc_id").isNull())
    else:  # rows without an id stay out of the join, where they would meet in one task
        known = rows.where("doc_id is not null").join(again, (F.col("doc_id") == F.col("id")) & F.col("source").eqNullSafe(F.col("within")), "left")
        rows = known.select(*rows.columns, F.coalesce("again", F.lit(False)).alias("again")).unionByName(rows.where("doc_id is null").withColumn("again", F.lit(True)))
    salted = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), F.col("mark").cast("string"))
    order = F.md5(F.when(F.col("again"), salted).otherwise(F.col("doc_id").cast("string")).cast("binary"))
    rows = written(rows.withColumn("order", order).drop("again").withColumn("bucket", F.conv(F.substring("order", 1, 3), 16, 10).cast("int")))
    slices = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sources = targets(slices.groupBy("source").agg(F.sum("n").alias("source_size")), weights, limit)
    before = slices.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).drop("n")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    before = before.join(sources, same(before, sources)).select(before["source"].alias("of"), F.col("bucket").alias("slice"), "before", "source_size", "weight", "target")
    df = rows.join(before, rows["source"].eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("slice")))
    within = F.sum("size").over(Window.partitionBy("of", "slice").orderBy("order", "doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    df = df.withColumn("from", F.col("before") + within)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    df = df.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(0)).withColumn("cut", F.round(F.col("target") - passes * F.col("source_size")).cast("long"))
    df = df.withColumn("extra", F.least(F.greatest(F.col("cut") - F.col("from"), F.lit(0)), F.col("size")))
    copies = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(1), F.col("passes")), lambda c: (c - 1) * F.col("source_size") + F.col("from") + F.col("size") / 2)).otherwise(F.array().cast("array<double>"))
    last = F.when(F.col("extra") > 0, F.array(F.col("passes") * F.col("source_size") + F.col("from") + F.col("extra") / 2)).otherwise(F.array().cast("array<double>"))
    df = df.withColumn("middles", F.concat(copies, last))

    def placed(m: Column) -> Column:
        share = F.least(m / F.col("target"), F.lit(1.0))
        out = position(share, next(iter(schedules.values())))
        for w, s in list(schedules.items())[1:]:
            out = F.when(F.col("weight") == w, position(share, s)).otherwise(out)
        return out

    return df.select("doc_id", "source", "mark", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "passes", "extra", F.transform("middles", placed).alias("positions"))


def in_order(planned: DataFrame) -> DataFrame:
    """A plan with `ranks`: for each copy of a document its place among all copies, range-sorted by position, 0 first.

    Equal positions follow id, source and text; a document that is not taken has no ranks. Only numbers are moved.
    """
    columns = planned.columns
    planned = written(planned.withColumn("_row", F.monotonically_increasing_id()))
    copies = planned.select("_row", "doc_id", "source", "mark", F.posexplode("positions").alias("copy", "position"))
    copies = ranked(copies, "position", "doc_id", "source", "mark", "copy")
    ranks = copies.groupBy("_row").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))  # a copy for each pass, and one more
    return planned.join(ranks, "_row", "left").select(*columns, F.coalesce("ranks", F.array().cast("array<long>")).alias("ranks"))


def mix(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT, schedules=SCHEDULES) -> DataFrame:
    """The documents as training reads them: copies sorted by position over range partitions.

    A copy that is taken in part holds its first words, with the white space between them; `n_chars`, if there is such a
    column, follows. Rows equal in id, source and text share one plan row each, so none is multiplied.
    """
    chosen = plan(docs, weights, limit, schedules).select("doc_id", F.coalesce("source", F.lit("")).alias("of"), F.col("source").isNull().alias("nowhere"), "mark", "size", "passes", "extra", "positions")
    numbered = lambda df, by: df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*by)))
    full = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    full = full.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.col("row.text").cast("string")).alias("mark"),
                       F.coalesce(F.col("row.source").cast("string"), F.lit("")).alias("of"), F.col("row.source").isNull().alias("nowhere"))
    chosen = chosen.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    same = ["id", "of", "nowhere", "mark"]
    both = numbered(full, same).join(numbered(chosen, same), [*same, "_nth"])
    copies = both.select("row", "size", "passes", "extra", F.posexplode("positions").alias("copy", "position"))
    part = F.col("copy") >= F.col("passes")
    text = F.col("row.text").cast("string")
    gap, word = f"[{SPACES}]", f"[^{SPACES}]"
    head = F.regexp_substr(text, F.concat(F.lit(f"^(?:{gap}*+{word}++){{"), F.col("extra").cast("string"), F.lit("}+")))
    copies = copies.withColumn("said", F.when(part & (F.col("extra") < F.col("size")), head).otherwise(text))
    new = {"text": F.col("said"), "n_chars": F.length("said").cast("long")}
    out = copies.select("position", *(new.get(c, F.col("row").getField(c)).alias(f"_{i}") for i, c in enumerate(docs.columns)))
    out = out.repartitionByRange("position").sortWithinPartitions("position")
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
