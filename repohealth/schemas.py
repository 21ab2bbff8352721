"""Explicit schemas of the fact and result tables, and the fixed value lists they use."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _L, _D, _B, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)

FINDING = _struct(
    ("id", _S), ("fingerprint", _S), ("severity", _S), ("file_path", _S), ("line", _I),
    ("message", _S), ("category", _S), ("suggestion", _S), ("status", _S),
)
MODULE_RESULT = _struct(
    ("id", _S), ("scan_id", _L), ("module_id", _S), ("score", _I), ("confidence", _D), ("state", _S),
    ("state_reason", _S), ("summary", _S), ("metrics", T.MapType(_S, _D)),
)
SNAPSHOT = _struct(
    ("commit", _S), ("timestamp", _S), ("scores", T.MapType(_S, _D)), ("overall", _D),
    ("delta", _D), ("moduleCount", _I),
)
AUDIT_FINDING = _struct(
    ("severity", _S), ("file", _S), ("line", _I), ("message", _S), ("category", _S),
)
REPO = _struct(
    ("id", _S), ("path", _S), ("name", _S), ("overall_score", _I), ("last_scan_at", _TS),
    ("metadata", _S), ("parent_repo_id", _S), ("active", _B),
)

# Severities from worst to mildest, module states, finding statuses.
SEVERITIES = ("critical", "high", "medium", "low", "info")
MODULE_STATES = ("completed", "not_applicable", "insufficient_evidence", "skipped", "unavailable")
STATUSES = ("new", "recurring", "fixed", "regressed")
STATUS_SORT_ORDER = ("new", "regressed", "recurring", "fixed")
UNKNOWN_RANK = 99
