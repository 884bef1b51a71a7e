"""Repository profile: type, frameworks, file contexts, inheritance, authentication.

Everything that needs the text is computed where the file is read and leaves
as a few bits, so no source text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.fixed import profile as fixed
from codesieve.functions.text import fold, has_any, java_regex, quoted, sql_found, strip
from codesieve.sources.files import scan_context_files

_SIGNS = [(kind, p) for kind, patterns in fixed.TYPE_SIGNS for p in patterns]


def _bits(tests: list[str]) -> Column:
    """SQL conditions as the bits of a whole number, the first one lowest."""
    return F.expr(" + ".join(f"if({t}, {1 << i}L, 0L)" for i, t in enumerate(tests)))


def _bit(column: str, i: int) -> str:
    """SQL for one of the bits of a column."""
    return f"({column} & {1 << i}L) != 0"


def file_flags(ctx_files: DataFrame) -> DataFrame:
    """Per file, as bits: framework signs, type signs, route and client signs, and the same for its path."""
    path = dict(text="path", folded="low_path")
    frameworks = [sql_found(p) for _, p in fixed.FRAMEWORKS]
    kinds = [sql_found([p]) for _, p in _SIGNS]
    moves = [sql_found([p], False) for p in (fixed.ROUTE_SIGN, fixed.CLIENT_SIGN)]
    calls = " + ".join(f"cast({sql_found([p], False)} as int)" for p in fixed.CLIENT_CALLS)
    routes = [sql_found(fixed.SERVER_ROUTES, False), f"{calls} >= 2"]
    path_kinds = [sql_found([p], **path) for _, p in _SIGNS]
    path_moves = [sql_found([p], False, **path) for p in (fixed.ROUTE_SIGN, fixed.CLIENT_SIGN)]
    packaged = " or ".join(f"contains(path, {quoted(f)})" for f in fixed.PACKAGING_FILES)
    files = ctx_files.select("repo_id", "path", "content", fold(F.col("content")).alias("folded"), fold(F.col("path")).alias("low_path"))
    return files.select(
        "repo_id", "path",
        _bits(frameworks).alias("framework_bits"),
        _bits(kinds + moves).alias("type_bits"),
        _bits(routes).alias("route_bits"),
        _bits(path_kinds + path_moves + [packaged]).alias("path_bits"),
        F.expr(sql_found(fixed.AUTH_SIGNS)).alias("has_auth_check"),
    )


def _by_repo(flags: DataFrame) -> DataFrame:
    """The flags of all files of a repository together; each task sums its files up before the shuffle."""
    return flags.groupBy("repo_id").agg(
        *[F.bit_or(c).alias(c) for c in ("framework_bits", "type_bits", "route_bits", "path_bits")],
        F.count(F.lit(1)).alias("n_files"), F.count_if("has_auth_check").alias("n_auth_files"))


def _frameworks(column: str = "framework_bits") -> Column:
    names = ", ".join(f"if({_bit(column, i)}, {quoted(name)}, null)" for i, (name, _) in enumerate(fixed.FRAMEWORKS))
    return F.expr(f"transform(array(array_compact(array({names}))), f -> if(size(f) > 0, f, array('none')))[0]")


def detect_frameworks(ctx_files: DataFrame) -> DataFrame:
    return _by_repo(file_flags(ctx_files)).select("repo_id", _frameworks().alias("frameworks"))


def _type_scores() -> dict[str, Column]:
    """Points of each type, from the columns type_bits, path_bits and frameworks."""
    both = "(type_bits | path_bits)"
    routes, client, packaged = _bit(both, len(_SIGNS)), _bit(both, len(_SIGNS) + 1), _bit("path_bits", len(_SIGNS) + 2)
    points = {kind: ["0"] + [f"if({_bit(both, i)}, 1, 0)" for i, (k, _) in enumerate(_SIGNS) if k == kind] for kind, _ in fixed.TYPE_SIGNS}
    for kind, names, n in fixed.FRAMEWORK_BOOSTS:
        points[kind].append(f"if(arrays_overlap(frameworks, array({', '.join(quoted(x) for x in names)})), {n}, 0)")
    for kind, n in fixed.CLIENT_BOOSTS:
        points[kind].append(f"if(not ({routes}) and {client}, {n}, 0)")
    for kind, n in fixed.PACKAGING_BOOSTS:
        points[kind].append(f"if(not ({routes}) and {packaged}, {n}, 0)")
    return {kind: F.expr(" + ".join(parts)) for kind, parts in points.items()}


def _best_type(scores: dict[str, Column]) -> Column:
    """The highest score; ties go to the earlier type."""
    ranked = F.array_max(F.array(*[
        F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(kind).alias("kind")) for i, (kind, s) in enumerate(scores.items())]))
    return F.when(ranked.score > 0, ranked.kind).otherwise("unknown")


def detect_codebase_type(ctx_files: DataFrame) -> DataFrame:
    """Repository type with the scores it follows from."""
    signs = _by_repo(file_flags(ctx_files)).withColumn("frameworks", _frameworks())
    scores = _type_scores()
    return signs.select("repo_id", "frameworks", *[s.alias(f"score_{k}") for k, s in scores.items()],
                         _best_type(scores).alias("codebase_type"))


def has_server_routes(ctx_files: DataFrame) -> DataFrame:
    return _by_repo(file_flags(ctx_files)).select("repo_id", F.expr(_bit("route_bits", 0)).alias("has_server_routes"))


def has_api_client_pattern(ctx_files: DataFrame) -> DataFrame:
    return _by_repo(file_flags(ctx_files)).select("repo_id", F.expr(_bit("route_bits", 1)).alias("has_api_client_pattern"))


def file_context(ctx_files: DataFrame) -> DataFrame:
    """Parent classes, imports and five flags of each file."""
    text, low = F.col("content"), F.lower("path")
    parents = F.flatten(F.transform(
        F.regexp_extract_all(text, F.lit(java_regex(fixed.CLASS_PARENTS, False)), 1), lambda p: F.transform(F.split(p, ","), strip)))
    pattern = F.lit(java_regex(fixed.IMPORTS, False))
    imports = F.zip_with(F.regexp_extract_all(text, pattern, 1), F.regexp_extract_all(text, pattern, 2),
                         lambda a, b: F.when(a != "", a).otherwise(b))
    return ctx_files.select("repo_id", "path", "content", fold(text).alias("folded")).select(
        "repo_id", "path", parents.alias("parent_classes"), imports.alias("imports"),
        F.expr(sql_found(fixed.AUTH_SIGNS)).alias("has_auth_check"),
        F.expr(sql_found(fixed.VALIDATION_SIGNS)).alias("has_input_validation"),
        has_any(low, fixed.TEST_CONTEXT_SIGNS).alias("is_test_file"),
        (low.contains("mock") | text.contains("Mock")).alias("is_mock"),
        F.expr(sql_found([fixed.EXPORTED_CALL], False)).alias("exports_api"),
    )


def auth_files(contexts: DataFrame) -> DataFrame:
    return contexts.filter("has_auth_check").select("repo_id", "path")


def test_directories(src_files: DataFrame) -> DataFrame:
    """Top-level directories that hold tests."""
    parts = F.split("path", "/")
    return src_files.filter((F.size(parts) > 1) & F.lower(parts[0]).isin(fixed.TEST_DIRECTORIES)).select(
        "repo_id", parts[0].alias("directory")).distinct()


def security_rules(codebase_type: Column) -> list[Column]:
    """The five rule flags of a repository type."""
    out = []
    for name, default in fixed.RULE_DEFAULTS.items():
        off = fixed.RULE_OFF.get(name)
        value = F.when(codebase_type.isin(off), False).otherwise(default) if off else F.lit(default)
        out.append(value.alias(name))
    return out


def lookup_file_context(df: DataFrame, contexts: DataFrame, path: str = "path") -> DataFrame:
    """Adds the context of each row's file; leading dots and slashes of the path do not matter."""
    keyed = df.withColumn("_path", F.regexp_replace(path, r"^[./]+", ""))
    right = contexts.select(F.col("repo_id").alias("_repo"), F.col("path").alias("_ctx"), F.struct(
        *[c for c in contexts.columns if c not in ("repo_id", "path")]).alias("file_context"))
    return keyed.join(right, (F.col("repo_id") == F.col("_repo")) & (F.col("_path") == F.col("_ctx")), "left").drop("_path", "_repo", "_ctx")


def profile_repo(src_files: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """One row per repository.

    All files count. `flags` may be a stored `file_flags` table; otherwise the
    text is read once.
    """
    flags = file_flags(scan_context_files(src_files)) if flags is None else flags
    # At most len(TEST_DIRECTORIES) spellings apart from case.
    tests = test_directories(src_files).groupBy("repo_id").agg(F.array_sort(F.collect_set("directory")).alias("test_directories"))
    joined = _by_repo(flags).join(tests, "repo_id", "left").withColumn("frameworks", _frameworks())
    scores = _type_scores()
    typed = joined.withColumn("codebase_type", _best_type(scores))
    return typed.select(
        "repo_id", "codebase_type", "frameworks", "n_files", "n_auth_files",
        F.expr(_bit("route_bits", 0)).alias("has_server_routes"),
        (F.col("n_auth_files") > 0).alias("has_auth_middleware"),
        F.expr(_bit("route_bits", 1)).alias("has_api_client_pattern"),
        F.coalesce("test_directories", F.array().cast("array<string>")).alias("test_directories"),
        *security_rules(F.col("codebase_type")),
    )
