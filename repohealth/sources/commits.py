"""Commit history facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repohealth.functions.paths import dirname, top_dir
from repohealth.functions.scalars import count_if, half_up
from repohealth.operators.ordered import top_per_key, with_position


def recent_commits(commits: DataFrame, n: int = 1000) -> DataFrame:
    """File rows of the newest ``n`` commits per repository; rows without a file name are dropped.

    The newest commits are found on one row per commit, so a commit that touches
    many files counts once, and the cut happens before the shuffle.
    """
    heads = commits.select("repo_id", "commit_id", "ts").distinct()
    newest = top_per_key(heads, ["repo_id"], [F.col("ts").desc(), F.col("commit_id")], n)
    kept = commits.where(F.coalesce(F.col("file"), F.lit("")) != "")
    return kept.join(newest.select("repo_id", "commit_id"), ["repo_id", "commit_id"], "left_semi")


def bus_factor(commits: DataFrame, minimum: int = 3) -> DataFrame:
    """Dominant author of every file with at least ``minimum`` commits; above 80 % the file is a silo."""
    by_author = commits.groupBy("repo_id", "file", "author").agg(F.count(F.lit(1)).alias("n"))
    out = by_author.groupBy("repo_id", "file").agg(
        F.sum("n").alias("commits"), F.max("n").alias("top_commits"),
        F.min_by("author", F.struct((-F.col("n")).alias("a"), F.col("author"))).alias("top_author"),
    ).where(F.col("commits") >= minimum)
    share = F.col("top_commits") / F.col("commits")
    return out.withColumn("dominance", share).withColumn("is_silo", share > 0.8).withColumn(
        "severity", F.when(share > 0.95, "medium").when(share > 0.8, "low")
    )


def author_diversity(files: DataFrame) -> DataFrame:
    """Share of files that are no silo, from ``bus_factor`` rows."""
    return files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files"), count_if(F.col("is_silo")).alias("silos")
    ).withColumn("diversity", (F.col("files") - F.col("silos")) / F.col("files"))


def churn(commits: DataFrame) -> DataFrame:
    """Commits per file with the rank in its repository; the top tenth (at least one file) are hotspots."""
    counts = commits.groupBy("repo_id", "file").agg(F.count(F.lit(1)).alias("commits"))
    sizes = counts.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_files"))
    placed = with_position(counts, ["repo_id"], [F.col("commits").desc(), F.col("file")], "place")
    cut = F.greatest(F.lit(1), F.floor(F.col("_files") / 10))
    out = placed.join(sizes, "repo_id").withColumn("is_hotspot", F.col("place") <= cut)
    return out.withColumn("severity", F.when(F.col("is_hotspot"), F.when(F.col("commits") > 50, "medium").otherwise("low"))).drop("_files")


def churn_health(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("repo_id").agg(
        (F.lit(1) - count_if(F.col("is_hotspot")) / F.count(F.lit(1))).alias("churn_health")
    )


def stale_areas(commits: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Top-level directories with their last commit and whether it is older than ``months`` before ``as_of``."""
    rows = commits.where(F.col("file").contains("/"))
    last = rows.groupBy("repo_id", top_dir(F.col("file")).alias("directory")).agg(F.max("ts").cast("date").alias("last_commit"))
    limit = F.add_months(F.lit(as_of).cast("date"), -months)
    return last.withColumn("is_stale", F.col("last_commit") < limit)


def freshness(areas: DataFrame) -> DataFrame:
    return areas.groupBy("repo_id").agg((count_if(~F.col("is_stale")) / F.count(F.lit(1))).alias("freshness"))


def git_health(parts: DataFrame) -> DataFrame:
    """40 points churn, 20 silos, 20 old TODOs, 20 freshness; a repository without facts of a kind gets that kind in full.

    ``parts`` carries churn_health, silo_findings, todo_score and freshness, NULL where there are no facts.
    """
    n = F.coalesce("silo_findings", F.lit(0))
    silo = F.greatest(F.lit(0.0), F.lit(1.0) - n / F.greatest(F.lit(5), n))
    one = F.lit(1.0)
    raw = (
        F.coalesce("churn_health", one) * 40 + silo * 20 + F.coalesce("todo_score", one) * 20
        + F.coalesce("freshness", one) * 20
    )
    return parts.withColumn("score", F.least(F.lit(100), F.greatest(F.lit(0), half_up(raw))).cast("int"))


def owner_heatmap(commits: DataFrame, directories: int = 15) -> DataFrame:
    """Commits per directory and author for the busiest directories of every repository."""
    cells = commits.groupBy("repo_id", dirname(F.col("file"), "(root)").alias("directory"), "author").agg(
        F.count(F.lit(1)).alias("commits")
    )
    totals = cells.groupBy("repo_id", "directory").agg(F.sum("commits").alias("_total"))
    busiest = top_per_key(totals, ["repo_id"], [F.col("_total").desc(), F.col("directory")], directories)
    return cells.join(busiest.select("repo_id", "directory"), ["repo_id", "directory"])


