"""Fragments of oracle SQL that mirror the column functions of the jobs."""

from __future__ import annotations


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def esum(x: str, scale: int = 6) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(20,{scale}))) AS DOUBLE)"


def half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def fp(module: str = "module_id", path: str = "file_path", category: str = "category", message: str = "message") -> str:
    parts = " || '::' || ".join(
        [f"coalesce({module}, '')", f"coalesce({path}, '')", f"coalesce({category}, '')",
         f"substring(coalesce({message}, ''), 1, 100)"]
    )
    return f"sha256({parts})"


def case(key: str, table: dict, default: str) -> str:
    """CASE over a fixed table; values are literals, ``default`` is SQL."""
    if not table:
        return default
    arms = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {key} {arms} ELSE {default} END"


SEV_RANK = "CASE lower(severity) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 99 END"

RANKED_SCANS = """ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, scan_id DESC) AS INT) AS scan_rank
  FROM v_scans WHERE status = 'completed')"""


def ranked_findings(view: str, n: int) -> str:
    return f"""{RANKED_SCANS}, rf AS (SELECT f.*, r.repo_id, r.scan_rank, {fp()} AS fingerprint
  FROM {view} f JOIN ranked r USING (scan_id) WHERE r.scan_rank <= {n})"""
