"""Path and language expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesieve.fixed import noise
from codesieve.functions.text import has_any


def _in_directory(path: Column, names: list[str]) -> Column:
    """True if one of the parent directories bears one of the names."""
    parents = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(parents, F.array(*[F.lit(n) for n in names]))


def has_scan_suffix(path: Column) -> Column:
    low = F.lower(path)
    by_suffix = reduce(lambda a, b: a | b, [low.endswith(s) for s in noise.SCAN_SUFFIXES])
    return by_suffix | has_any(path, noise.SCAN_NAMES)


def is_scanned(path: Column) -> Column:
    return has_scan_suffix(path) & ~_in_directory(path, noise.SCAN_SKIP_DIRS)


def is_context_file(path: Column) -> Column:
    from codesieve.fixed import profile

    parents = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return (
        suffix.isin(profile.CONTEXT_EXTENSIONS)
        & ~_in_directory(path, profile.CONTEXT_SKIP_DIRS)
        & ~F.exists(parents, lambda d: d.endswith(".egg-info"))
    )


def detect_language(path: Column) -> Column:
    """Language by suffix, first row of the table that fits."""
    out = None
    for suffix, name in noise.LANGUAGE_SUFFIXES:
        out = F.when(path.endswith(suffix), name) if out is None else out.when(path.endswith(suffix), name)
    return out.when(path.contains("Dockerfile"), "Docker").otherwise("Unknown")


def normalize_language(language: Column) -> Column:
    """Rule-set key of a language; a language without a rule set keeps its lower-cased name."""
    low = F.lower(language)
    table = F.create_map(*[F.lit(x) for pair in noise.LANGUAGE_ALIASES for x in pair])
    return F.coalesce(F.try_element_at(table, low), low)


def is_test_file(path: Column) -> Column:
    return has_any(F.lower(path), noise.TEST_FILE_SIGNS)


def rel_path(path: Column, root: str | None) -> Column:
    """Path below `root` if it lies there, else the path with its redundant separators removed."""
    clean = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), r"/{2,}", "/")
    clean = F.regexp_replace(clean, r"^(\./)+|(?<=.)/$", "")
    if not root:
        return clean
    prefix = root.rstrip("/") + "/"
    return F.when(clean.startswith(prefix), F.substr(clean, F.lit(len(prefix) + 1))).otherwise(clean)


def norm_path(path: Column) -> Column:
    """Forward slashes, without any leading dots and slashes."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^[./]+", "")
