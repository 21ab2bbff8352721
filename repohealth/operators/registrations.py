"""Repository registrations: what is new, what to purge, which configuration applies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repohealth.operators.ordered import first_per_key


def discover(found: DataFrame, registered: DataFrame) -> DataFrame:
    """Discovered repositories by path, marked as new or registered."""
    known = registered.select("path").distinct().withColumn("_known", F.lit(True))
    return found.join(known, "path", "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


def register_new(repos: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates to insert: one row per path (the smallest name), paths that exist already left out."""
    one = first_per_key(candidates.select("path", "name", "parent_id"), ["path"], ["name", "parent_id"])
    return one.join(repos.select("path"), "path", "left_anti")


def purge(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of the ``gone`` repositories (repo_id); findings and results follow their scans."""
    dead_scans = tables["scans"].join(gone.select("repo_id"), "repo_id", "left_semi").select("scan_id")
    out = {}
    for name, df in tables.items():
        if "repo_id" in df.columns:
            out[name] = df.join(gone.select("repo_id"), "repo_id", "left_anti")
        else:
            out[name] = df.join(dead_scans, "scan_id", "left_anti")
    return out


def skip_scanned(requests: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Scan requests whose repository state was not scanned before."""
    return requests.join(done.select(*keys).distinct(), keys, "left_anti")


def effective_config(repos: DataFrame, configs: DataFrame) -> DataFrame:
    """Configuration of every repository: its own row, else the global one (NULL repo_id)."""
    fallback = configs.where(F.col("repo_id").isNull()).agg(F.max("budget")).scalar()
    own = configs.where(F.col("repo_id").isNotNull()).select("repo_id", F.col("budget").alias("_own"))
    return repos.join(own, "repo_id", "left").select("repo_id", F.coalesce("_own", fallback).alias("budget"), F.col("_own").isNotNull().alias("is_own"))
