"""Manifest and metadata documents: workspaces, repository metadata, JSON with comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repohealth.functions.paths import dirname, glob_to_regex
from repohealth.functions.scalars import strict_json, strip, strip_json_comments


def read_jsonc(content: Column) -> Column:
    """JSON with comments as a variant; NULL when it does not parse."""
    return strict_json(strip_json_comments(content))


def repo_metadata(doc: Column) -> Column:
    """The fields kept of a hosting platform's metadata, with their defaults."""
    m = strict_json(doc)

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get(m, path, kind)

    return F.struct(
        get("$.description", "string").alias("description"), get("$.language", "string").alias("language"),
        F.coalesce(get("$.stargazers_count", "bigint"), F.lit(0).cast("bigint")).alias("stars"),
        F.coalesce(get("$.forks_count", "bigint"), F.lit(0).cast("bigint")).alias("forks"),
        F.coalesce(get("$.open_issues_count", "bigint"), F.lit(0).cast("bigint")).alias("open_issues"),
        get("$.license.spdx_id", "string").alias("license"),
        F.coalesce(F.array_join(get("$.topics", "array<string>"), ","), F.lit("")).alias("topics"),
        F.coalesce(get("$.created_at", "string"), F.lit("")).alias("created_at"),
        F.coalesce(get("$.pushed_at", "string"), F.lit("")).alias("pushed_at"),
    )


def workspace_patterns(files: DataFrame) -> DataFrame:
    """Workspace globs of every repository: the manifest's list (plain or under packages), then the YAML list."""
    root = files.where(F.col("path") == "package.json")
    raw = F.from_json("content", "workspaces string")["workspaces"]
    listed = F.coalesce(
        F.from_json(raw, "array<string>"), F.from_json(raw, "packages array<string>")["packages"]
    )
    manifest = root.where(strict_json(F.col("content")).isNotNull()).select("repo_id", F.explode(listed).alias("pattern"))

    # The block after "packages:" up to the first line that is neither an item, a comment nor blank.
    yaml = files.where(F.col("path") == "pnpm-workspace.yaml").select("repo_id", F.concat(F.lit("\n"), "content").alias("content"))
    inline = F.regexp_extract("content", r"\n\s*packages\s*:\s*\[([^\]]*)\]", 1)
    blockpart = F.regexp_extract("content", r"\n\s*packages\s*:[^\n\[]*((?:\n\s*(?:-[^\n]*|#[^\n]*)?)*)", 1)
    items = F.when(inline != "", F.split(inline, ",")).otherwise(
        F.regexp_extract_all(blockpart, F.lit(r"(?m)^\s*-\s*(.*)$"), F.lit(1))
    )
    cleaned = F.filter(F.transform(items, lambda s: strip(F.regexp_replace(strip(s), r"^['\x22]|['\x22]$", ""))), lambda s: s != "")
    from_yaml = yaml.select("repo_id", F.explode(cleaned).alias("pattern"))
    return manifest.unionByName(from_yaml)


def match_workspaces(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Directories with a manifest that match a workspace glob of their repository; the root is none.

    The few globs of a repository travel as one list, so directories meet them by an equi join.
    """
    dirs = files.where(F.col("path").endswith("/package.json")).select("repo_id", dirname(F.col("path")).alias("directory"))
    globs = patterns.select("repo_id", glob_to_regex(F.col("pattern")).alias("regex")).distinct().groupBy("repo_id").agg(
        F.collect_list("regex").alias("_globs")
    )
    hit = F.exists("_globs", lambda g: F.rlike(F.concat("directory", F.lit("/")), g))
    return dirs.join(globs, "repo_id").where(hit).select("repo_id", "directory").distinct()
