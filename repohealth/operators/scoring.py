"""Module results to scores: weighted means, summaries, deductions and metric-based scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repohealth.functions.scalars import clamp, count_if, exact_sum, half_up
from repohealth.functions.severity import DEDUCTIONS, lookup

# Module weights of every repository archetype; False marks a module that does not apply.
PROFILE_WEIGHTS: dict[str, dict[str, float]] = {
    "web-app": {
        "api-health": 1.4, "telemetry-observability": 1.2, "dead-code": 1.15, "complexity": 1.05,
        "test-coverage": 1.1, "test-quality": 1.05, "type-safety": 1.05, "config-quality": 1.05,
        "arch-smells": 1.1, "doc-staleness": 0.85, "context-conflicts": 0.9, "error-handling": 1.0,
    },
    "api-service": {
        "api-health": 1.5, "security": 1.2, "dependencies": 1.15, "test-coverage": 1.2, "test-quality": 1.1,
        "telemetry-observability": 1.3, "config-quality": 1.1, "secrets-scan": 1.2, "type-safety": 1.05,
        "arch-smells": 1.1, "build": 1.05, "lint": 1.05, "typecheck": 1.1, "test": 1.1,
    },
    "library": {
        "dead-code": 1.5, "dependencies": 1.25, "type-safety": 1.2, "circular-deps": 1.1, "test-coverage": 1.15,
        "test-quality": 1.05, "security": 1.1, "config-quality": 1.0, "doc-accuracy": 1.1, "doc-staleness": 1.1,
        "api-health": 0.4, "telemetry-observability": 0.4,
    },
    "cli": {
        "git-health": 1.3, "config-quality": 0.9, "security": 1.05, "dependencies": 1.05, "dead-code": 1.0,
        "test-coverage": 1.05, "type-safety": 1.1, "doc-staleness": 1.0, "api-health": 0.2,
        "telemetry-observability": 0.2,
    },
    "agent-tooling": {
        "context-conflicts": 1.4, "doc-accuracy": 1.3, "arch-smells": 1.2, "error-handling": 1.2,
        "test-quality": 1.1, "doc-staleness": 1.1, "config-quality": 1.1, "naming-quality": 1.1,
        "telemetry-observability": 1.0, "api-health": 0.8,
    },
    "prototype": {
        "dead-code": 0.7, "git-health": 0.75, "config-quality": 0.8, "complexity": 0.8, "test-quality": 0.9,
        "doc-staleness": 0.8, "api-health": 0.5, "compliance-hipaa": 0.5, "telemetry-observability": 0.6,
    },
    "compliance-sensitive": {
        "compliance-hipaa": 1.6, "security": 1.3, "secrets-scan": 1.4, "dependencies": 1.2, "config-quality": 1.2,
        "type-safety": 1.1, "test-coverage": 1.15, "telemetry-observability": 1.1, "doc-staleness": 0.9,
        "context-conflicts": 1.0, "error-handling": 1.1,
    },
}
PROFILE_INAPPLICABLE: dict[str, tuple[str, ...]] = {
    "library": ("api-health", "telemetry-observability"),
    "cli": ("api-health", "telemetry-observability"),
    "prototype": ("dead-code", "api-health", "compliance-hipaa", "telemetry-observability"),
}
# Names of earlier profiles that still appear in configs.
PROFILE_ALIASES = {"solo": "prototype", "team": "web-app", "enterprise": "compliance-sensitive"}
# Weights of the adoption evaluation.
EVALUATION_WEIGHTS = {
    "dependencies": 2.0, "dependency": 2.0, "security": 1.5, "git-health": 1.5, "git_health": 1.5,
    "bus-factor": 1.5, "bus_factor": 1.5, "complexity": 1.0, "code-quality": 1.0, "code_quality": 1.0,
}


def score_eligible(score: Column = None, state: Column = None) -> Column:
    """A result counts when it completed (or has no state) and carries a score; -1 means no score."""
    score = F.col("score") if score is None else score
    state = F.col("state") if state is None else state
    return F.coalesce((state.isNull() | (state == "completed")) & (score >= 0), F.lit(False))


def profile_weight(module: Column, profile: str | None) -> Column:
    return lookup(module, PROFILE_WEIGHTS.get(profile or "", {}) or {"": 1.0}, 1.0)


def overall_score(results: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Confidence-weighted mean of the eligible module scores per key, rounded half up; 0 without weight."""
    w = (F.lit(1.0) if weight is None else weight) * F.col("confidence")
    ok = score_eligible()
    weighted = exact_sum(F.when(ok, F.col("score") * w))
    total = exact_sum(F.when(ok, w))
    return results.groupBy(*keys).agg(
        F.coalesce(half_up(weighted / F.nullif(total, F.lit(0.0))), F.lit(0)).cast("int").alias("overall_score")
    )


def score_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    ok = score_eligible()
    state = F.coalesce(F.col("state"), F.lit(""))
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        count_if(ok).alias("scored"),
        count_if(ok & (F.col("score") > 60)).alias("passing"),
        count_if(~ok & (state == "not_applicable")).alias("not_applicable"),
        count_if(~ok & (state == "unavailable")).alias("unavailable"),
        count_if(~ok & ~state.isin("not_applicable", "unavailable")).alias("neutral"),
    )


def severity_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    severity = F.lower(F.col("severity"))
    return findings.groupBy(*keys).agg(
        *[count_if(severity == s).alias(s) for s in ("critical", "high", "medium", "low", "info")],
        F.count(F.lit(1)).alias("total"),
    )


def deduction_points(family: str, severity: Column, unknown: int = 0) -> Column:
    return lookup(severity, DEDUCTIONS[family], unknown)


def deduction_score(findings: DataFrame, keys: list[str], points: Column) -> DataFrame:
    """100 minus the points of all findings, not below 0."""
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("findings"),
        F.greatest(F.lit(0), F.lit(100) - F.sum(points)).cast("int").alias("score"),
    )


def count_penalty(base: Column, per_item: int) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - base * per_item).cast("int")


def dead_code_score(files: Column, exports: Column, deps: Column) -> Column:
    lost = files * 5 + F.least(exports * F.lit(0.5), F.lit(30.0)) + deps * 5
    return F.greatest(F.lit(0), half_up(F.lit(100) - lost)).cast("int")


def maintainability(avg_loc: Column, avg_complexity: Column) -> Column:
    """Maintainability index from mean size and mean decision count, scaled to 0..100."""
    volume = F.ln(F.greatest(avg_loc * 2, F.lit(1.0)))
    size = F.ln(F.greatest(avg_loc, F.lit(1.0)))
    raw = F.lit(171) - F.lit(5.2) * volume - F.lit(0.23) * avg_complexity - F.lit(16.2) * size
    return clamp(half_up(raw * (F.lit(100.0) / F.lit(171.0)))).cast("int")


def adoption_risk(modules: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Risk of adopting a repository: 100 on any critical security finding, else 100 minus weighted health plus surcharges.

    A module result is counted only when it is score-eligible.
    """
    w = lookup(F.col("module_id"), EVALUATION_WEIGHTS, 1.0) * F.col("confidence")
    ok = score_eligible()
    low_git = ok & F.col("module_id").isin("git-health", "git_health", "bus-factor", "bus_factor") & (F.col("score") < 40)
    health = modules.groupBy(*keys).agg(
        F.coalesce(
            exact_sum(F.when(ok, F.col("score") * w)) / F.nullif(exact_sum(F.when(ok, w)), F.lit(0.0)), F.lit(50.0)
        ).alias("_health"),
        count_if(low_git).alias("_low_git"),
    )
    sec = (F.col("category") == "security") | (F.col("module_id") == "security")
    dep = F.col("module_id").isin("dependencies", "dependency") & F.col("severity").isin("high", "critical")
    # Each module adds its surcharge once, so the flags are collected per module first.
    per_module = findings.groupBy(*keys, "module_id").agg(
        count_if((F.col("severity") == "critical") & sec).alias("_crit"),
        count_if((F.col("severity") == "high") & sec).alias("_high"),
        F.max(dep.cast("int")).alias("_dep"),
    )
    flags = per_module.groupBy(*keys).agg(
        F.sum("_crit").alias("critical_security"), F.sum("_high").alias("high_security"), F.sum("_dep").alias("_dep"),
    )
    zero = F.lit(0)
    crit, high = F.coalesce("critical_security", zero), F.coalesce("high_security", zero)
    risk = F.lit(100) - F.col("_health") + high * 3 + F.coalesce("_dep", zero) * 5 + F.col("_low_git") * 8
    out = health.join(flags, keys, "left")
    final = F.when(crit > 0, zero + 100).otherwise(half_up(clamp(risk))).cast("int")
    out = out.select(
        *keys, crit.alias("critical_security"), high.alias("high_security"),
        final.alias("adoption_risk"),
        F.array_join(F.array_compact(F.array(
            F.when(crit > 0, "critical-security"),
            F.when((crit == 0) & (high > 0), "high-security"),
            F.when((crit == 0) & (F.coalesce("_dep", zero) > 0), "outdated-dependencies"),
            F.when((crit == 0) & (F.col("_low_git") > 0), "low-git-health"),
        )), ",").alias("reasons"),
    )
    verdict = (
        F.when(F.col("critical_security") > 0, "avoid").when(F.col("adoption_risk") < 30, "low-risk")
        .when(F.col("adoption_risk") < 60, "moderate-risk").when(F.col("adoption_risk") < 80, "high-risk").otherwise("avoid")
    )
    return out.withColumn("verdict", verdict)
