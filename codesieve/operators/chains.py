"""Attack chains: findings that open the way for one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.fixed import texts
from codesieve.functions.text import has_any
from codesieve.operators.ranking import rank_within

# Pairs are built in squares of this side, so that no task holds a scope's whole list.
BLOCK = 1000
# A scope whose quoted texts take more bytes is built in squares too, so that no task holds all of them at once.
LISTED = 4 << 20


def chain_roles(findings: DataFrame, scope: str = "repo_id") -> DataFrame:
    """One row per part a finding plays: (pattern, side); patterns 3 and 4 have one side."""
    category, description, file = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("category", "description", "file"))
    has = lambda col, *words: has_any(col, list(words))
    parts = [
        (1, "L", has(category, "auth") & F.col("severity").isin("CRITICAL", "HIGH")),
        (1, "R", has_any(category, texts.CHAIN_DATA_CATEGORIES)),
        (2, "L", has(category, "xss")),
        (2, "R", has(description, "session", "cookie")),
        (3, "L", has(category, "sql") & has(category, "injection") & has(file, "admin", "auth")),
        (4, "L", has(category, "ssrf")),
    ]
    roles = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(p).alias("pattern"), F.lit(s).alias("side"))) for p, s, test in parts]))
    return findings.select(
        F.col(scope), F.col("id"), F.col("ord"), F.coalesce("description", F.lit("")).alias("excerpt"),
        F.explode(roles).alias("r"),
    ).select(scope, "r.pattern", "r.side", "id", "ord", "excerpt")


def chain_counts(findings: DataFrame, scope: str = "repo_id") -> DataFrame:
    """Number of chains by scope and pattern, and where each pattern's numbering starts. Linear in the findings."""
    return _counts(chain_roles(findings, scope), scope)


def _counts(roles: DataFrame, scope: str) -> DataFrame:
    n = lambda p, s: F.count_if((F.col("pattern") == p) & (F.col("side") == s))
    sides = roles.groupBy(scope).agg(
        n(1, "L").alias("l1"), n(1, "R").alias("r1"), n(2, "L").alias("l2"), n(2, "R").alias("r2"), n(3, "L").alias("l3"), n(4, "L").alias("l4"))
    one = F.lit(1).cast("bigint")
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), left.alias("n_left"), right.alias("n_right")) for p, left, right in (
        (1, F.col("l1"), F.col("r1")), (2, F.col("l2"), F.col("r2")), (3, F.col("l3"), one), (4, F.col("l4"), one))])
    start = {1: F.lit(0), 2: F.col("l1") * F.col("r1")}
    start[3] = start[2] + F.col("l2") * F.col("r2")
    start[4] = start[3] + F.col("l3")
    begin = F.when(F.col("k.pattern") == 1, start[1]).when(F.col("k.pattern") == 2, start[2]).when(
        F.col("k.pattern") == 3, start[3]).otherwise(start[4])
    return sides.select("*", F.explode(rows).alias("k")).select(
        scope, "k.*", (F.col("k.n_left") * F.col("k.n_right")).alias("n_chains"), begin.cast("bigint").alias("start"))


def attack_chains(findings: DataFrame, scope: str = "repo_id", first: int | None = None) -> DataFrame:
    """The chains, numbered in pattern, left and right order inside each scope.

    A chain's number follows from the positions of its two findings, so the
    list itself is never sorted.  `first` keeps the first chains of each scope
    and never builds the others.
    """
    # Texts that no description quotes are not carried along.
    quoted = F.col("pattern").isin([r[0] for r in texts.CHAINS if "%s" in r[3]])
    roles = chain_roles(findings, scope).withColumn("excerpt", F.when(quoted, F.col("excerpt")).otherwise(""))
    if first:
        return _described(_in_blocks(roles, scope, first), scope)
    # Wide scopes are broadcast: there are at most as many as a thousandth of the roles, or as their texts have parts of LISTED bytes.
    wide = F.broadcast(_wide(roles, scope))
    lists = _in_lists(roles.filter(F.col(scope).isNotNull()).join(wide, scope, "left_anti"), scope)
    return _described(lists.unionByName(_in_blocks(roles.join(wide, scope, "left_semi"), scope)), scope)


def _wide(roles: DataFrame, scope: str) -> DataFrame:
    """The scopes with more than BLOCK findings on a side or more than LISTED bytes of texts."""
    sides = [F.count_if((F.col("pattern") == p) & (F.col("side") == s)) for p, s in ((1, "L"), (1, "R"), (2, "L"), (2, "R"), (3, "L"), (4, "L"))]
    size = F.coalesce(F.sum(F.octet_length("excerpt")), F.lit(0))
    return roles.groupBy(scope).agg(F.greatest(*sides).alias("_side"), size.alias("_bytes")).filter((F.col("_side") > BLOCK) | (F.col("_bytes") > LISTED)).select(scope)


def _in_lists(roles: DataFrame, scope: str) -> DataFrame:
    """The chains of scopes that are not wide, by one shuffle and one sort: each left finding meets the list of its right ones."""
    n = lambda p, s: F.count_if((F.col("pattern") == p) & (F.col("side") == s)).over(Window.partitionBy(scope))
    place = F.row_number().over(Window.partitionBy(scope, "pattern", "side").orderBy("ord", "id")).cast("bigint")
    whole = Window.partitionBy(scope, "pattern").orderBy("side", "ord", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = roles.repartition(scope).withColumn("position", place).withColumn(
        "rights", F.collect_list(F.when(F.col("side") == "R", F.struct("id", "excerpt"))).over(whole)).withColumns(
        {"_1": n(1, "L") * n(1, "R"), "_2": n(2, "L") * n(2, "R"), "_3": n(3, "L")})
    start = F.when(F.col("pattern") > 1, F.col("_1")).otherwise(0) + F.when(F.col("pattern") > 2, F.col("_2")).otherwise(0) + F.when(F.col("pattern") > 3, F.col("_3")).otherwise(0)
    n_right = F.size("rights").cast("bigint")
    # Patterns 3 and 4 have no right side: a left finding is a chain by itself.
    lefts = listed.filter((F.col("side") == "L") & (~F.col("pattern").isin(1, 2) | (n_right > 0))).select(
        scope, "pattern", F.col("id").alias("left_id"), F.col("excerpt").alias("left_excerpt"),
        (start + (F.col("position") - 1) * F.greatest(n_right, F.lit(1)) + 1).alias("_no"), F.posexplode_outer("rights").alias("_place", "_right"))
    return lefts.select(
        scope, "pattern", (F.col("_no") + F.coalesce("_place", F.lit(0))).alias("chain_no"), "left_id", F.col("_right.id").alias("right_id"),
        "left_excerpt", F.coalesce("_right.excerpt", F.lit("")).alias("right_excerpt"))


def _in_blocks(roles: DataFrame, scope: str, first: int | None = None) -> DataFrame:
    """The chains of scopes of any size, in squares of BLOCK findings."""
    counts = _counts(roles, scope).filter(F.col("n_chains") > 0)
    group = [scope, "pattern", "side"]
    if first:
        # Each task passes on at most `first` rows per group.
        place = F.row_number().over(Window.partitionBy(*group).orderBy("ord", "id")).cast("bigint")
        ranked = roles.withColumn("position", place).filter(F.col("position") <= first)
    else:
        ranked = rank_within(roles, group, "ord", ("id",))
    parts = ranked.join(counts, [scope, "pattern"])
    block = F.floor((F.col("position") - 1) / BLOCK)
    limit = lambda n: F.least(n, F.lit(first)) if first else n
    blocks = lambda n: F.sequence(F.lit(0).cast("bigint"), F.floor((limit(n) - 1) / BLOCK))
    # Patterns 3 and 4 have no right side: their findings pass the same join alone, so that the left sides are read and ranked once.
    left = parts.filter(F.col("side") == "L").select(
        scope, "pattern", F.col("id").alias("left_id"), F.col("excerpt").alias("left_excerpt"), F.col("position").alias("left_position"),
        "n_right", "start", block.alias("left_block"), F.explode(blocks(F.col("n_right"))).alias("right_block"))
    right = parts.filter(F.col("side") == "R").select(
        scope, "pattern", F.col("id").alias("right_id"), F.col("excerpt").alias("right_excerpt"), F.col("position").alias("right_position"),
        block.alias("right_block"), F.explode(blocks(F.col("n_left"))).alias("left_block"))
    number = F.col("start") + (F.col("left_position") - 1) * F.col("n_right") + F.coalesce("right_position", F.lit(1))
    chains = left.join(right, [scope, "pattern", "left_block", "right_block"], "left").select(
        scope, "pattern", number.alias("chain_no"), "left_id", "right_id", "left_excerpt", F.coalesce("right_excerpt", F.lit("")).alias("right_excerpt"))
    return chains.filter(F.col("chain_no") <= first) if first else chains


def chain_ranges(findings: DataFrame, scope: str = "repo_id") -> DataFrame:
    """The chains as ranges, one per left finding: (scope, pattern, left_id, first_no, n). Linear in the findings.

    A left finding's chains have consecutive numbers, one for each right finding in its order; `list_chains` turns numbers
    into chains.
    """
    roles = chain_roles(findings, scope)
    lefts = rank_within(roles.filter("side = 'L'").drop("excerpt"), [scope, "pattern"], "ord", ("id",))
    counts = _counts(roles, scope).filter(F.col("n_chains") > 0)
    first = F.col("start") + (F.col("position") - 1) * F.col("n_right") + 1
    return lefts.join(counts, [scope, "pattern"]).select(scope, "pattern", F.col("id").alias("left_id"), first.alias("first_no"), F.col("n_right").alias("n"))


def list_chains(findings: DataFrame, wanted: DataFrame, scope: str = "repo_id") -> DataFrame:
    """The chains with the `wanted` (scope, chain_no), without the others: a number gives the places of its findings by arithmetic.

    Numbers that no chain has give no row; a number that is asked for twice gives its chain once.
    """
    roles = chain_roles(findings, scope)
    counts = _counts(roles, scope).filter(F.col("n_chains") > 0)
    places = wanted.select(scope, F.col("chain_no").cast("bigint").alias("chain_no")).distinct().join(counts, scope).filter(
        (F.col("chain_no") > F.col("start")) & (F.col("chain_no") <= F.col("start") + F.col("n_chains")))
    offset = F.col("chain_no") - F.col("start") - 1
    places = places.select(scope, "pattern", "chain_no", (F.floor(offset / F.col("n_right")) + 1).alias("left_position"), (offset % F.col("n_right") + 1).alias("right_position"))
    ranked = rank_within(roles, [scope, "pattern", "side"], "ord", ("id",))

    def side(name: str, prefix: str) -> DataFrame:
        return ranked.filter(F.col("side") == name).select(scope, "pattern", F.col("position").alias(f"{prefix}_position"), F.col("id").alias(f"{prefix}_id"), F.col("excerpt").alias(f"{prefix}_excerpt"))

    both = places.join(side("L", "left"), [scope, "pattern", "left_position"]).join(side("R", "right"), [scope, "pattern", "right_position"], "left")
    paired = F.col("pattern").isin(1, 2)
    shown = [F.when(paired, F.col(f"{p}_excerpt")).otherwise("").alias(f"{p}_excerpt") for p in ("left", "right")]
    return _described(both.select(scope, "pattern", "chain_no", "left_id", "right_id", *shown), scope)


def _described(chains: DataFrame, scope: str) -> DataFrame:
    """Chains with their texts."""
    def by_pattern(value):
        out = None
        for row in texts.CHAINS:
            out = F.when(F.col("pattern") == row[0], value(row)) if out is None else out.when(F.col("pattern") == row[0], value(row))
        return out

    described = lambda r: F.format_string(r[3], F.col("left_excerpt"), F.col("right_excerpt")) if "%s" in r[3] else F.lit(r[3])
    return chains.select(
        scope,
        F.format_string("CHAIN-%03d", F.col("chain_no")).alias("id"),
        "chain_no", "pattern", "left_id", "right_id",
        F.array_compact(F.array("left_id", "right_id")).alias("steps"),
        by_pattern(lambda r: F.lit(r[2])).alias("impact"),
        by_pattern(lambda r: F.lit(r[1])).alias("severity"),
        by_pattern(described).alias("description"),
    )
