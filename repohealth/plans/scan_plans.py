"""Whole-scan queries: all checks in one plan, and the scores that follow."""

from __future__ import annotations

from repohealth import scan
from repohealth.functions.severity import DEDUCTIONS
from repohealth.operators import shape
from repohealth.operators.scoring import PROFILE_INAPPLICABLE, PROFILE_WEIGHTS
from repohealth.plans import file_plans, shape_plans, tool_plans  # noqa: F401  their queries are parts of the oracle
from repohealth.plans.registry import REGISTRY, query
from repohealth.plans.rule_plans import STRICT_SQL, TYPED_SQL, _todos
from repohealth.plans.sqltext import case, esum, half_up, q

MODULES = ("secrets-scan", "compliance-hipaa", "git-health", "complexity", "type-safety", "security", "api-health")


def _facts(t) -> scan.Facts:
    """No probes: api-health has no input here and is unavailable."""
    return scan.Facts(
        files=t["v_code_files"], lines=t["v_code_lines"], commits=t["v_commits"], dated_commits=t["v_dated_commits"], todos=_todos(t),
        deps=t["v_deps"], advisories=t["v_advisories"], as_of="2001-08-01")


def _archetypes(t):
    return shape.archetype(shape.repo_traits(t["v_sliced_files"]))


def _results(t):
    facts = _facts(t)
    return scan.module_results(scan.run_checks(facts, MODULES), facts.files, MODULES, facts, _archetypes(t))


def _part(sql: str, module: str, cols: str) -> str:
    return f"SELECT repo_id, '{module}' AS module_id, {cols} FROM ({sql}) q_{module.replace('-', '_')}"


FOUND_SQL = " UNION ALL ".join((
    _part(REGISTRY["secrets"].sql, "secrets-scan", "severity, path AS file_path, line_no AS line, category"),
    _part(REGISTRY["phi_rules"].sql, "compliance-hipaa", "severity, path, line_no, 'hipaa'"),
    _part(REGISTRY["external_silos"].sql, "git-health", "'medium', path, line_no, 'external-silo'"),
    _part(REGISTRY["complexity_findings"].sql, "complexity", "severity, path, NULL, category"),
    _part(f"WITH {TYPED_SQL} SELECT * FROM hits", "type-safety", "severity, path, line_no, category"),
    _part(REGISTRY["vulnerable_deps"].sql, "security", "severity, name, NULL, 'vulnerability'"),
))
POINTS_SQL = "CASE module_id " + " ".join(f"WHEN '{m}' THEN {case('severity', DEDUCTIONS[scan.CHECKS[m].family], '0')}" for m in MODULES) + " END"
TYPE_SCORE_SQL = f"""WITH {TYPED_SQL}, {STRICT_SQL}, f AS (SELECT DISTINCT repo_id FROM v_code_files WHERE regexp_matches(path, '(?i)\\.tsx?$') AND NOT contains(path, 'node_modules/')),
c AS (SELECT repo_id, count(CASE WHEN category = 'any-usage' THEN 1 END) AS a, count(CASE WHEN category = 'type-assertion' THEN 1 END) AS b, count(CASE WHEN category = 'ts-directive' THEN 1 END) AS d FROM hits GROUP BY repo_id),
m AS (SELECT repo_id, count(*) AS n FROM missing GROUP BY repo_id)
SELECT repo_id, 100 - (least(coalesce(a, 0) * 2, 40) + coalesce(n, 0) * 5 + least(coalesce(b, 0), 15) + least(coalesce(d, 0) * 2, 15)) AS score FROM f LEFT JOIN c USING (repo_id) LEFT JOIN m USING (repo_id)"""
OWN_SQL = " UNION ALL ".join((
    _part(REGISTRY["maintainability"].sql, "complexity", "maintainability AS own, CASE WHEN files >= 10 THEN 1.0 ELSE 0.7 END AS sure"),
    _part(REGISTRY["git_health"].sql, "git-health", "score, 0.9"),
    _part(TYPE_SCORE_SQL, "type-safety", "greatest(0, score), 1.0"),
))
UNFIT_SQL = " OR ".join(f"(archetype = '{a}' AND module_id IN ({', '.join(map(q, left_out))}))" for a, left_out in PROFILE_INAPPLICABLE.items())
RULED_SQL = ", ".join(q(m) for m in MODULES if m in scan.SCORES)
RESULTS_SQL = f"""found AS ({FOUND_SQL}), lost AS (SELECT repo_id, module_id, sum({POINTS_SQL}) AS lost, count(*) AS n FROM found GROUP BY 1, 2),
ev AS (SELECT repo_id, unnest([{', '.join(map(q, MODULES))}]) AS module_id FROM (SELECT DISTINCT repo_id FROM v_code_files) x), own AS ({OWN_SQL}),
arche AS (SELECT repo_id, archetype FROM ({REGISTRY["archetype"].sql}) y), declared AS (SELECT DISTINCT repo_id, 'security' AS module_id, true AS seen FROM v_deps),
st AS (SELECT ev.repo_id, ev.module_id, archetype, lost, n, own, sure, CASE WHEN coalesce({UNFIT_SQL}, false) THEN 'not_applicable' WHEN module_id = 'api-health' THEN 'unavailable'
  WHEN (module_id IN ({RULED_SQL}) AND own IS NULL) OR (module_id = 'security' AND seen IS NULL) THEN 'insufficient_evidence' ELSE 'completed' END AS state
  FROM ev LEFT JOIN lost USING (repo_id, module_id) LEFT JOIN own USING (repo_id, module_id) LEFT JOIN declared USING (repo_id, module_id) LEFT JOIN arche USING (repo_id)),
res AS (SELECT repo_id, module_id, archetype, state, CAST(CASE WHEN state <> 'completed' THEN -1 WHEN module_id IN ({RULED_SQL}) THEN own ELSE greatest(0, 100 - coalesce(lost, 0)) END AS INT) AS score,
  CAST(CASE WHEN state <> 'completed' THEN 0 ELSE coalesce(sure, 1) END AS DOUBLE) AS confidence, coalesce(n, 0) AS findings FROM st)"""
WEIGHT_SQL = "CASE archetype " + " ".join(f"WHEN '{a}' THEN {case('module_id', {m: w for m, w in weights.items() if m in MODULES}, '1.0')}" for a, weights in PROFILE_WEIGHTS.items()) + " ELSE 1.0 END"
EACH = f"CAST(({WEIGHT_SQL}) AS DOUBLE) * confidence"


@query("scan_findings", FOUND_SQL)
def _(t):
    return scan.run_checks(_facts(t), MODULES).select("repo_id", "module_id", "severity", "file_path", "line", "category")


@query("scan_results", f"WITH {RESULTS_SQL} SELECT repo_id, module_id, state, score, confidence, findings FROM res")
def _(t):
    return _results(t).select("repo_id", "module_id", "state", "score", "confidence", "findings")


@query("scan_scores", f"""WITH {RESULTS_SQL} SELECT repo_id, CAST(coalesce({half_up(esum(f"CASE WHEN state = 'completed' THEN score * ({EACH}) END") + " / nullif(" + esum(f"CASE WHEN state = 'completed' THEN {EACH} END") + ", 0)")}, 0) AS INT) AS overall_score
FROM res GROUP BY repo_id""")
def _(t):
    return scan.weighted_scores(_results(t), _archetypes(t))
