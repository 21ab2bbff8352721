"""Dependencies against advisories and a package registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repohealth.functions.scalars import exact_sum, half_up, semver
from repohealth.functions.severity import lookup, tool_severity
from repohealth.sources.tool_reports import cargo_step

# Share of a full penalty an outdated package costs.
OUTDATED_WEIGHTS = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2, "info": 0.05}


def vulnerable_deps(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Installed versions inside an advisory's half-open range; an open lower end starts at zero.

    The join is on the package name; AQE splits a package that a large share of
    the repositories uses. Which side is small enough to broadcast is left to it.
    """
    ranged = advisories.withColumn("_lo", semver(F.coalesce("lo", F.lit("0")))).withColumn("_hi", semver(F.col("hi")))
    hits = deps.withColumn("_v", semver(F.col("current"))).join(ranged, "name").where(
        (F.col("_v") >= F.col("_lo")) & (F.col("_v") < F.col("_hi"))
    )
    linked = F.col("url") != ""
    return hits.select(
        "repo_id", "name", "current", "advisory_id", tool_severity("npm", F.col("severity")).alias("severity"),
        F.concat("title", F.lit(" ("), "name", F.lit(")"), F.when(linked, F.concat(F.lit(" — "), "url")).otherwise("")).alias("message"),
        F.when(F.col("fixed").isNotNull(), F.concat(F.lit("Update "), "name", F.lit(" to "), "fixed"))
        .otherwise("Review the advisory and update the affected package.").alias("suggestion"),
    )


def npm_severity(current: Column, latest: Column) -> Column:
    return npm_step(semver(current), semver(latest))


def npm_step(a: Column, b: Column) -> Column:
    """Severity of the step between two parsed versions."""
    majors, minors = b[0] - a[0], b[1] - a[1]
    return F.when(majors >= 2, "high").when(majors >= 1, "medium").when(minors > 0, "low").otherwise("info")


def outdated_deps(deps: DataFrame, registry: DataFrame) -> DataFrame:
    """Dependencies behind the registry, with the severity under three ecosystems' rules; '--' means unknown."""
    # every version is parsed once, below the join: parsing in the filter and again for each severity costs most of the time
    known = parsed(registry.where(F.col("latest") != "--"), "latest", "_b")
    rows = parsed(deps, "current", "_a").join(known, "name").where(F.col("_a") < F.col("_b"))
    return rows.select(
        "repo_id", "name", "current", "latest", npm_step(F.col("_a"), F.col("_b")).alias("severity"),
        cargo_step(F.col("_a"), F.col("_b")).alias("cargo_severity"), F.lit("low").alias("go_severity"),
    )


def parsed(df: DataFrame, version: str, name: str) -> DataFrame:
    """``df`` with the parts of a version, behind a generator so that no use of them parses it again."""
    return df.withColumn(name, F.explode(F.array(semver(F.col(version)))))


def dependency_score(deps: DataFrame, outdated: DataFrame) -> DataFrame:
    """Share of up-to-date packages, each outdated one weighted by its severity; 100 without packages."""
    declared = deps.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_declared"))
    behind = outdated.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("_n"), exact_sum(lookup(F.col("severity"), OUTDATED_WEIGHTS, 0.0)).alias("_penalty")
    )
    n = F.coalesce("_n", F.lit(0))
    total = F.greatest("_declared", n)
    score = half_up(F.lit(100) * (F.lit(1) - F.coalesce("_penalty", F.lit(0.0)) / (total * F.lit(0.8))))
    return declared.join(behind, "repo_id", "left").select(
        "repo_id", F.col("_declared").alias("declared"), n.alias("outdated"), F.greatest(F.lit(0), score).cast("int").alias("score")
    )
