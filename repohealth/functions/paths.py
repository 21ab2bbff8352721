"""Path columns: directory, name, extension, prefixes and path rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column, root: str = ".") -> Column:
    """Path without its last segment; ``root`` for files at the top."""
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), cut).otherwise(F.lit(root))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or '' when the name has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def top_dir(path: Column, root: str = ".") -> Column:
    return F.when(path.contains("/"), F.get(F.split(path, "/"), F.lit(0))).otherwise(F.lit(root))


def prefix2(path: Column) -> Column:
    """First two path segments (the whole path when it has one)."""
    return F.array_join(F.slice(F.split(path, "/"), 1, 2), "/")


def starts_with_any(path: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | path.startswith(prefix)
    return out


def present(path: Column, names: tuple[str, ...]) -> Column:
    """The path is one of ``names`` or lies inside one of them (a file or folder of that name exists)."""
    out = path.isin(*names)
    for name in names:
        out = out | path.startswith(name + "/")
    return out


def glob_to_regex(glob: Column) -> Column:
    """Anchored regex of a directory glob: * is one segment, ** any depth, * inside a segment is a wildcard.

    Segments starting with a dot and node_modules never match a wildcard segment.
    """
    segment = r"(?!\.|node_modules(?:/|$))[^/]+"
    cleaned = F.regexp_replace(glob, "/+$", "")
    parts = F.transform(
        F.split(cleaned, "/"),
        lambda p: F.when(p == "**", F.lit(f"(?:{segment}/)*"))
        .when(p == "*", F.lit(f"{segment}/"))
        .otherwise(F.concat(F.regexp_replace(F.regexp_replace(p, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*"), F.lit("/"))),
    )
    return F.concat(F.lit("^"), F.array_join(parts, ""), F.lit("$"))
