"""Parent names found in file paths, by one automaton of many names for each part of a repository.

A name occurs in a path as plain text, so names and paths have no key to join on. The distinct names of a repository are dealt
to shards, its paths to slices, as many as their numbers ask for; each shard meets each slice once, builds an automaton
of its names and runs every path through it. A repository of any size, one whose paths all hold the same name too, is thus
cut into parts of bounded size, and what leaves a part are counts per name. Pairs of files are only made for names asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of a shard, paths of a slice, and parts into which a repository's rows are cut to learn its shards and slices.
SHARD, SLICE, SALTS = 50_000, 100_000, 16
#: Children and parents of a name meet in squares of about this side, so that no task makes all edges of a name.
SQUARE = 32


def base_names(contexts: DataFrame) -> DataFrame:
    """(repository, file, parent position, lower-cased last part of the parent's name)."""
    base = F.lower(F.element_at(F.split("parent", r"\."), -1))
    return contexts.select("repo_id", "path", F.posexplode("parent_classes").alias("pos", "parent")).select("repo_id", "path", "pos", base.alias("base"))


def _met(names: DataFrame, files: DataFrame, shard: int, size: int):
    """Shards of (repo_id, base) and slices of (repo_id, parent_path), grouped so that each shard meets each slice."""
    counts = names.groupBy("repo_id").agg(F.count("*").alias("n")).join(files.groupBy("repo_id").agg(F.count("*").alias("m")), "repo_id")
    plan = counts.select("repo_id", F.ceil(F.col("n") / shard).cast("int").alias("shards"), F.ceil(F.col("m") / size).cast("int").alias("slices"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    def dealt(rows: DataFrame, text: str, own: str, other: str):
        columns, mark = rows.columns, F.xxhash64(text)
        rows = rows.withColumn("salt", F.pmod(mark, F.lit(SALTS)).cast("int")).join(plan, ["repo_id", "salt"])
        place = F.pmod(F.xxhash64(text, F.lit(1)), F.col(f"{own}s")).cast("int")
        rows = rows.select(*columns, place.alias(own), F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other))
        # Fresh names, since both sides may come from the same files.
        return rows.select(*(F.col(c).alias(c if c in columns[1:] else f"{own}_{c}") for c in rows.columns)).groupBy(*(f"{own}_{c}" for c in ("repo_id", "shard", "slice")))

    return dealt(names, "base", "shard", "slice").cogroup(dealt(files, "parent_path", "slice", "shard"))


def _distinct(contexts: DataFrame, wanted: DataFrame | None) -> DataFrame:
    names = base_names(contexts).groupBy("repo_id", "base").agg(F.count(F.lit(1)).alias("n_children"))
    return names if wanted is None else names.join(wanted.select("repo_id", "base").distinct(), ["repo_id", "base"], "left_semi")


def _paths(files: DataFrame) -> DataFrame:
    return files.select("repo_id", F.col("path").alias("parent_path"), F.lower("path").alias("low"))


def parent_counts(contexts: DataFrame, files: DataFrame | None = None, shard: int = SHARD, size: int = SLICE) -> DataFrame:
    """(repo_id, base, n_files): in how many paths of `files` (all, if not given) each parent name occurs, if in any.

    An empty name occurs in every path.
    """
    names, files = _distinct(contexts, None), _paths(contexts if files is None else files)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        import ahocorasick
        found = np.zeros(left.num_rows, np.int64)
        if right.num_rows:
            words = ahocorasick.Automaton()
            for i, base in enumerate(left.column("base").to_pylist()):
                words.add_word(base, i)
            if len(words):
                words.make_automaton()
                for path in right.column("low").to_pylist():
                    found[list({i for _, i in words.iter(path)})] += 1
        hit = np.flatnonzero(found)
        some = left.take(pa.array(hit))
        return pa.table({"repo_id": some.column("shard_repo_id"), "base": some.column("base"), "n": pa.array(found[hit])})

    parts = _met(names.where("base != ''"), files, shard, size).applyInArrow(count, "repo_id string, base string, n long")
    everywhere = files.groupBy("repo_id").agg(F.count("*").alias("n_files")).join(names.where("base = ''"), "repo_id").select("repo_id", "base", "n_files")
    return parts.groupBy("repo_id", "base").agg(F.sum("n").alias("n_files")).unionByName(everywhere)


def parent_files(contexts: DataFrame, wanted: DataFrame | None = None, shard: int = SHARD, size: int = SLICE) -> DataFrame:
    """(repo_id, base, parent_path): the paths that hold each name, or each of the `wanted` (repo_id, base)."""
    return _held(contexts, wanted, shard, size).drop("n_children")


def _held(contexts: DataFrame, wanted: DataFrame | None, shard: int, size: int) -> DataFrame:
    """The paths that hold each name, with the number of its children."""
    names, files = _distinct(contexts, wanted), _paths(contexts)

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        import ahocorasick
        words, of, where = ahocorasick.Automaton(), [], []
        for i, base in enumerate(left.column("base").to_pylist()):
            words.add_word(base, i)
        if len(words):
            words.make_automaton()
            for j, path in enumerate(right.column("low").to_pylist()):
                hits = {i for _, i in words.iter(path)}
                of += hits
                where += [j] * len(hits)
        some, held = left.take(pa.array(of, pa.int64())), right.take(pa.array(where, pa.int64()))
        return pa.table({"repo_id": some.column("shard_repo_id"), "base": some.column("base"), "parent_path": held.column("parent_path"), "n_children": some.column("n_children")})

    pairs = _met(names.where("base != ''"), files, shard, size).applyInArrow(pair, "repo_id string, base string, parent_path string, n_children long")
    return pairs.unionByName(files.join(names.where("base = ''"), "repo_id").select("repo_id", "base", "parent_path", "n_children"))


def inheritance_edges(contexts: DataFrame, wanted: DataFrame | None = None, square: int = SQUARE) -> DataFrame:
    """File -> file whose path contains the name of one of its parents (once per parent); `wanted`: only these (repo_id, base).

    The edges of a name are as many as its children times its parents. Both are dealt to strips by a hash, and the strips meet in
    squares, each a key of its own: a task's edges are bounded by the rows it reads.
    """
    held = _held(contexts, wanted, SHARD, SLICE)
    strips = lambda n: F.ceil(F.col(n) / square).cast("int")
    strip = lambda n, *of: F.pmod(F.xxhash64(*of), strips(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), strips(n) - 1))
    sizes = held.groupBy("repo_id", "base").agg(F.count(F.lit(1)).alias("n_parents"), F.max("n_children").alias("n_children"))
    children = base_names(contexts).join(sizes, ["repo_id", "base"]).select(
        "repo_id", "base", "path", "pos", strip("n_children", "path", "pos").alias("child_strip"), every("n_parents").alias("parent_strip"))
    found = held.drop("n_children").join(sizes, ["repo_id", "base"]).select(
        "repo_id", "base", "parent_path", strip("n_parents", "parent_path").alias("parent_strip"), every("n_children").alias("child_strip"))
    return children.join(found, ["repo_id", "base", "child_strip", "parent_strip"]).select("repo_id", "path", "pos", "parent_path")


def parent_has_auth(contexts: DataFrame) -> DataFrame:
    """Per file, whether a parent file has authentication checks.

    Only the paths of files with such checks are searched, and names settled by any of them mark their children: the pairs
    of files and parents are never built.
    """
    settled = parent_counts(contexts, contexts.where("has_auth_check")).select("repo_id", "base")
    found = base_names(contexts).join(settled, ["repo_id", "base"], "left_semi").select("repo_id", "path").distinct()
    marked = found.withColumn("parent_has_auth", F.lit(True))
    return contexts.select("repo_id", "path").join(marked, ["repo_id", "path"], "left").select("repo_id", "path", F.coalesce("parent_has_auth", F.lit(False)).alias("parent_has_auth"))
