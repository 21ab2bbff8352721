"""Operators over findings: filters, dedupe, file health, priorities and work lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repohealth.functions.scalars import backticked, clamp, count_if, exact_sum
from repohealth.functions.severity import (
    FILE_HEALTH_POINTS, PRIORITY_WEIGHTS, health_color, is_blocking, lookup, severity_rank,
)
from repohealth.operators.ordered import first_per_key, top_per_key

# Categories whose fixes follow a recipe.
RECIPE_CATEGORIES = (
    "security", "dependencies", "dead-code", "dead-dependency", "type-assertion", "any-usage", "ts-directive",
)
# Fixed value: how older messages name an author.
AUTHOR_PATTERN = r"(?i)(?:author|contributor|committer)[:\s]+[\x27\x22]?([A-Za-z0-9_\s.@-]+?)[\x27\x22]?(?:\s|,|;|\)|$)"
# Template family of a finding category.
TEMPLATE_FAMILIES = {
    "complexity": "complexity", "security": "security", "dependency": "dependency", "dependencies": "dependency",
    "git-health": "git-health", "git_health": "git-health", "bus-factor": "git-health", "bus_factor": "git-health",
    "churn": "git-health", "todo-age": "git-health", "staleness": "git-health", "dead-code": "dead-code",
    "dead-dependency": "dead-code", "dead-file": "dead-code",
}


def ignore_paths(findings: DataFrame, patterns: list[str], mode: str = "prefix") -> DataFrame:
    """Drop findings under an ignored pattern; rows without a path stay.

    As a prefix, a trailing * or ** is left out and a leading ** is literal, so it never matches. As a glob, * stands for
    any text inside a segment, ? for one character and ** for any depth; a pattern without a slash names a file or
    folder anywhere, and what lies inside a matched folder is ignored too.
    """
    if mode not in ("prefix", "glob"):
        raise ValueError(f"unknown mode {mode}")
    hit = F.lit(False)
    for pattern in patterns:
        if mode == "glob":
            hit = hit | F.rlike("file_path", F.lit(ignore_regex(pattern)))
        else:
            prefix = pattern[:-2] if pattern.endswith("**") else pattern[:-1] if pattern.endswith("*") else pattern
            hit = hit | F.col("file_path").startswith(prefix)
    return findings.where(~F.coalesce(hit, F.lit(False)))


def ignore_regex(glob: str) -> str:
    """Regular expression, for Java and RE2 alike, of the paths that an ignore glob covers."""
    body = glob.strip("/")
    anywhere = "/" not in body and not glob.startswith("/")
    out = ""
    for piece in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|[^*?]", body):
        out += {"**/": "(?:[^/]+/)*", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece, re.escape(piece))
    return ("^(?:.*/)?" if anywhere else "^") + out + "(?:/.*)?$"


def query_findings(
    findings: DataFrame, severity: str | None = None, module: str | None = None, status: str | None = None,
    scan_id=None, limit: int = 50,
) -> DataFrame:
    """Filtered findings, worst first, at most 200, with the number of matches before the limit."""
    rows = findings
    if scan_id is not None:
        rows = rows.where(F.col("scan_id") == scan_id)
    if severity:
        rows = rows.where(F.lower("severity") == severity)
    if module:
        rows = rows.where(F.col("module_id") == module)
    if status:
        rows = rows.where(F.col("status") == status)
    head = rows.orderBy(severity_rank(F.col("severity")), "finding_id", "message").limit(min(limit, 200))
    return head.withColumn("total", rows.agg(F.count(F.lit(1))).scalar())


def dedupe(findings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per fingerprint under an explicit order."""
    return first_per_key(findings, keys, order)


def file_health(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Health of every file of a scan: 100 minus severity points, counts, and the module with most findings."""
    rows = findings.where(F.coalesce(F.col("file_path"), F.lit("")) != "")
    severity = F.lower(F.col("severity"))
    per_module = rows.groupBy(*keys, "file_path", "module_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(lookup(severity, FILE_HEALTH_POINTS, 0)).alias("_points"),
        *[count_if(severity == s).alias(s) for s in FILE_HEALTH_POINTS],
    )
    # Most findings first, then the smaller module name: the greatest count with the smallest name.
    most = F.min_by("module_id", F.struct((-F.col("_n")).alias("a"), F.col("module_id")))
    out = per_module.groupBy(*keys, "file_path").agg(
        clamp(F.lit(100) - F.sum("_points")).cast("int").alias("health"),
        F.sum("_n").alias("findings"),
        *[F.sum(s).alias(s) for s in FILE_HEALTH_POINTS],
        most.alias("dominant_module"),
    )
    return out.withColumn("color", health_color(F.col("health")))


def priority(severity: Column, confidence: Column, churn: Column) -> Column:
    """Severity weight times confidence times 1 + churn; critical findings count at least half."""
    weight = lookup(severity, PRIORITY_WEIGHTS, 1)
    trusted = F.when(severity == "critical", F.greatest(confidence, F.lit(0.5))).otherwise(confidence)
    return weight * trusted * (F.lit(1) + F.coalesce(churn, F.lit(0.0)))


def prioritize(findings: DataFrame, churn: DataFrame | None = None) -> DataFrame:
    """Open findings with their priority; ``churn`` is (file_path, churn_rate)."""
    rows = findings.where(F.coalesce(F.col("status") != "fixed", F.lit(True)))
    rate = F.lit(0.0)
    if churn is not None:
        rows, rate = rows.join(churn, "file_path", "left"), F.col("churn_rate")
    scored = rows.withColumn("priority", priority(F.lower("severity"), F.col("confidence"), rate))
    return scored.drop("churn_rate") if churn is not None else scored


def file_priorities(prioritized: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of priorities per file; findings without a path share '(unknown)'."""
    path = F.when(F.coalesce(F.col("file_path"), F.lit("")) == "", "(unknown)").otherwise(F.col("file_path"))
    return prioritized.withColumn("file_path", path).groupBy(*keys, "file_path").agg(
        exact_sum(F.col("priority")).alias("group_score"), F.count(F.lit(1)).alias("findings")
    )


def top_files(prioritized: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    order = [F.col("group_score").desc(), F.col("file_path")]
    return top_per_key(file_priorities(prioritized, keys), keys, order, n, rank="position")


def effort(critical: Column, high: Column, n: Column) -> Column:
    return F.when(critical | (n > 5), "high").when(high | (n > 2), "medium").otherwise("low")


def action_bundles(prioritized: DataFrame, keys: list[str]) -> DataFrame:
    """What to do about a file: modules, severities, commands, task type, effort and blocking flag.

    Only sets bounded by the catalogue (modules, severities) and distinct
    commands are gathered; the finding ids stay rows, see ``action_items``.
    """
    path = F.when(F.coalesce(F.col("file_path"), F.lit("")) == "", "(unknown)").otherwise(F.col("file_path"))
    rows = prioritized.withColumn("file_path", path)
    severity = F.lower("severity")
    facts = rows.groupBy(*keys, "file_path").agg(
        F.array_join(F.array_sort(F.collect_set("module_id")), ",").alias("modules"),
        F.array_join(F.array_sort(F.collect_set(severity)), ",").alias("severities"),
        F.count(F.lit(1)).alias("findings"),
        F.coalesce(F.bool_or(severity == "critical"), F.lit(False)).alias("_critical"),
        F.coalesce(F.bool_or(severity == "high"), F.lit(False)).alias("_high"),
        F.coalesce(F.bool_or(is_blocking(severity, F.col("category"))), F.lit(False)).alias("blocking"),
        F.coalesce(F.bool_or(F.coalesce(F.col("suggestion"), F.lit("")) != ""), F.lit(False)).alias("_suggests"),
        F.bool_and(F.col("category").isin(*RECIPE_CATEGORIES)).alias("_recipe"),
    )
    commands = (
        rows.select(*keys, "file_path", F.explode(backticked(F.col("suggestion"))).alias("command")).distinct()
        .groupBy(*keys, "file_path").agg(F.count(F.lit(1)).alias("commands"))
    )
    out = facts.join(commands, [*keys, "file_path"], "left").withColumn("commands", F.coalesce("commands", F.lit(0)))
    fixed = (F.col("commands") > 0) | F.col("_suggests") | F.col("_recipe")
    return out.select(
        *keys, "file_path", "modules", "severities", "findings", "commands", "blocking",
        F.when(fixed, "deterministic").otherwise("exploratory").alias("task_type"),
        effort(F.col("_critical"), F.col("_high"), F.col("findings")).alias("effort"),
    )


def action_items(prioritized: DataFrame) -> DataFrame:
    """The commands of every finding, one row each."""
    return prioritized.select("scan_id", "file_path", "finding_id", F.explode(backticked(F.col("suggestion"))).alias("command"))


def dominant_category(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent category of a group (ties to the smaller name) and its template family."""
    counts = findings.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*keys).agg(
        F.min_by("category", F.struct((-F.col("_n")).alias("a"), F.col("category"))).alias("category")
    )
    return best.withColumn("family", lookup(F.col("category"), TEMPLATE_FAMILIES, "generic"))


def message_facts(message: Column) -> Column:
    """Numbers and names that older findings only carry inside their message."""
    def number(pattern: str) -> Column:
        return F.regexp_extract(message, pattern, 1).try_cast("int")

    return F.struct(
        number(r"([0-9]+)\s+commits").alias("commits"),
        number(r"(?i)([0-9]+)\s*(?:lines?|LOC)").alias("loc"),
        number(r"(?i)complexity[:\s]+([0-9]+)").alias("complexity"),
        F.nullif(
            F.regexp_extract(message, AUTHOR_PATTERN, 1), F.lit("")
        ).alias("author"),
    )


def message_edges(findings: DataFrame) -> DataFrame:
    """Dependency edges named in messages: the steps of a cycle chain, else 'depends on / imports / requires X'."""
    chain = r"(?i)(?:cycle|circular)[^:]*:\s*([A-Za-z0-9_./@-]+(?:\s*(?:->|→|=>)\s*[A-Za-z0-9_./@-]+)+)"
    target = r"(?i)(?:depends on|imports|requires)\s+[\x27\x22]?([A-Za-z0-9_./@-]+)"
    rows = findings.where(F.coalesce(F.col("file_path"), F.lit("")) != "").withColumn(
        "_chain", F.nullif(F.regexp_extract("message", chain, 1), F.lit(""))
    )
    nodes = F.split("_chain", r"\s*(?:->|→|=>)\s*")
    steps = F.transform(
        F.sequence(F.lit(0), F.size(nodes) - 2),
        lambda i: F.struct(F.get(nodes, i).alias("src"), F.get(nodes, i + 1).alias("dst")),
    )
    chained = rows.where(F.col("_chain").isNotNull()).select(F.explode(steps).alias("e")).select(
        "e.src", "e.dst", F.lit(True).alias("in_cycle")
    )
    words = F.lower("message")
    cyclic = F.lower("severity").isin("critical", "high") | words.contains("circular") | words.contains("cycle")
    plain = rows.where(F.col("_chain").isNull()).select(
        F.col("file_path").alias("src"), F.nullif(F.regexp_extract("message", target, 1), F.lit("")).alias("dst"),
        cyclic.alias("in_cycle"),
    ).where(F.col("dst").isNotNull())
    # A pair seen more than once is one edge; it is marked when any mention was cyclic.
    return chained.unionByName(plain).groupBy("src", "dst").agg(F.bool_or("in_cycle").alias("in_cycle"))


