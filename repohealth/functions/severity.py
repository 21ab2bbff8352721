"""Severity ranks, bands, tool severity maps and other small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repohealth.functions.scalars import matches
from repohealth.schemas import SEVERITIES, STATUS_SORT_ORDER, UNKNOWN_RANK

# Points taken off a score per severity, by check family.
DEDUCTIONS = {
    "security": {"critical": 20, "high": 10, "medium": 5, "low": 2, "info": 0},
    "secrets-scan": {"critical": 15, "high": 10, "medium": 5, "low": 2, "info": 0},
    "compliance": {"critical": 25, "high": 15, "medium": 5, "low": 2, "info": 0},
    "config-quality": {"critical": 15, "high": 8, "medium": 5, "low": 2, "info": 1},
    "api-health": {"critical": 20, "high": 15, "medium": 8, "low": 3, "info": 0},
    "naming-quality": {"critical": 8, "high": 8, "medium": 4, "low": 2, "info": 0},
    "error-handling": {"critical": 8, "high": 6, "medium": 4, "low": 2, "info": 0},
}
FILE_HEALTH_POINTS = {"critical": 30, "high": 20, "medium": 10, "low": 5, "info": 0}
PRIORITY_WEIGHTS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}

# Severity words of external tools.
TOOL_SEVERITIES = {
    "npm": {"critical": "critical", "high": "high", "moderate": "medium", "low": "low"},
    "golint": {"error": "high", "warning": "medium", "info": "low", "suggestion": "low"},
    "clippy": {"error": "high", "warning": "medium"},
    "osv": {"critical": "critical", "high": "high", "medium": "medium", "moderate": "medium", "low": "low"},
}
TOOL_DEFAULTS = {"npm": "info", "golint": "medium", "clippy": "info", "osv": "medium"}

# Business wording per severity.
RISK_LABELS = {
    "critical": ("Critical Risk — Immediate action required", "Immediate"),
    "high": ("Significant Risk — Address within current sprint", "High"),
    "medium": ("Moderate Risk — Plan for remediation", "Medium"),
    "low": ("Low Risk — Track and monitor", "Low"),
    "info": ("Informational — No action required", "None"),
}


def lookup(key: Column, table: dict, default) -> Column:
    """CASE ladder over a small fixed table; stays inside generated code."""
    out = None
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)) if out is None else out.when(key == name, F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info; unknown words come last."""
    return lookup(F.lower(severity), {s: i for i, s in enumerate(SEVERITIES)}, UNKNOWN_RANK)


def status_rank(status: Column) -> Column:
    return lookup(status, {s: i for i, s in enumerate(STATUS_SORT_ORDER)}, UNKNOWN_RANK)


def tool_severity(tool: str, raw: Column, has_call_stack: Column | None = None) -> Column:
    default = F.lit(TOOL_DEFAULTS[tool])
    if tool == "osv" and has_call_stack is not None:
        default = F.when(has_call_stack, F.lit("high")).otherwise(default)
    return F.coalesce(lookup(F.lower(raw), TOOL_SEVERITIES[tool], default), default)


def soften(severity: Column, archetype: Column) -> Column:
    """One step milder for prototypes."""
    down = {worse: milder for worse, milder in zip(SEVERITIES, SEVERITIES[1:])}
    return F.when(F.coalesce(archetype == "prototype", F.lit(False)), lookup(severity, down, "info")).otherwise(severity)


def band(value: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """First label whose lower bound the value reaches."""
    out = None
    for low, label in cuts:
        out = F.when(value >= low, label) if out is None else out.when(value >= low, label)
    return out.otherwise(rest)


def health_color(health: Column) -> Column:
    return F.when(health <= 40, "red").when(health <= 70, "yellow").otherwise("green")


def score_color(score: Column) -> Column:
    return band(score, [(80, "green"), (60, "yellow"), (40, "orange")], "red")


def feedback_rating(score: Column) -> Column:
    return band(score, [(80, "high"), (50, "moderate"), (25, "low")], "minimal")


def risk_label(severity: Column) -> Column:
    unknown = F.concat(F.lit("Unknown Risk Level ("), severity, F.lit(")"))
    return lookup(F.lower(severity), {k: v[0] for k, v in RISK_LABELS.items()}, unknown)


def risk_urgency(severity: Column) -> Column:
    return lookup(F.lower(severity), {k: v[1] for k, v in RISK_LABELS.items()}, "Unknown")


def diagnostic_severity(message: Column) -> Column:
    """Severity of a compiler line by its words; high when it says nothing."""
    return (
        F.when(matches(message, r"(?i)\berror\b"), "high")
        .when(matches(message, r"(?i)\bwarn(ing)?\b"), "medium")
        .otherwise("high")
    )


def is_blocking(severity: Column, category: Column) -> Column:
    return (severity == "critical") | ((category == "security") & (severity == "high"))
