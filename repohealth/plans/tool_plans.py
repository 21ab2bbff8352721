"""Queries over tool output, dependencies and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from repohealth.functions.scalars import count_if, semver
from repohealth.operators import deps as DP
from repohealth.operators import scoring
from repohealth.operators.code import dead_deps, dead_exports, dead_files, import_edges
from repohealth.operators.shape import file_roles, manifest_deps, manifests
from repohealth.plans.registry import REGISTRY, query
from repohealth.plans.rule_plans import _resolved
from repohealth.plans.sqltext import case, half_up
from repohealth.session import cut_lineage
from repohealth.functions.severity import TOOL_SEVERITIES
from repohealth.sources import tool_reports as R

NPM = TOOL_SEVERITIES["npm"]


def js(doc: str, path: str) -> str:
    return f"json_extract_string({doc}, '{path}')"


@query("audit_json", f"""WITH d AS (SELECT doc_id, CAST(doc AS JSON) AS j FROM v_audit_docs WHERE json_valid(doc)),
n AS (SELECT doc_id, k AS package, json_extract(j, '$.vulnerabilities."' || k || '"') AS v FROM (SELECT doc_id, j, unnest(json_keys(j, '$.vulnerabilities')) AS k FROM d WHERE json_exists(j, '$.vulnerabilities')) x),
i AS (SELECT *, list_filter(json_extract(v, '$.via[*]'), lambda e: json_type(e) = 'OBJECT')[1] AS info FROM n),
o AS (SELECT doc_id, json_extract(j, '$.advisories."' || k || '"') AS v FROM (SELECT doc_id, j, unnest(json_keys(j, '$.advisories')) AS k FROM d WHERE NOT json_exists(j, '$.vulnerabilities')) x)
SELECT doc_id, package, {case("json_extract_string(v, '$.severity')", NPM, "'info'")} AS severity, coalesce(json_extract_string(info, '$.title'), concat('Vulnerability in ', package)) AS title,
  coalesce(json_extract_string(info, '$.url'), '') AS url, coalesce(json_extract_string(v, '$.fixAvailable') NOT IN ('false', 'null', ''), false) AS fixable FROM i
UNION ALL SELECT doc_id, coalesce(json_extract_string(v, '$.module_name'), 'unknown'), {case("json_extract_string(v, '$.severity')", NPM, "'info'")}, coalesce(json_extract_string(v, '$.title'), 'Vulnerability'), coalesce(json_extract_string(v, '$.url'), ''), false FROM o""")
def _(t):
    return R.parse_audit(t["v_audit_docs"])


@query("ndjson_diag", f"""WITH d AS (SELECT run_id, line_no, CAST(text AS JSON) AS j FROM v_ndjson WHERE json_valid(text))
SELECT run_id, line_no, CASE json_extract_string(j, '$.message.level') WHEN 'error' THEN 'high' ELSE 'medium' END AS severity, {js('j', '$.message.spans[0].file_name')} AS file,
  CAST({js('j', '$.message.spans[0].line_start')} AS INT) AS line, concat({js('j', '$.message.message')}, CASE WHEN {js('j', '$.message.code.code')} IS NOT NULL THEN concat(' [', {js('j', '$.message.code.code')}, ']') ELSE '' END) AS message
FROM d WHERE {js('j', '$.reason')} = 'compiler-message' AND {js('j', '$.message.level')} IN ('warning', 'error') AND json_array_length(j, '$.message.spans') > 0""")
def _(t):
    return R.parse_compiler_lines(t["v_ndjson"])


@query("concat_json", f"""WITH d AS (SELECT doc_id, unnest(json_extract(CAST('[' || regexp_replace(doc, '\\}}\\s*\\{{', '}},{{', 'g') || ']' AS JSON), '$[*]')) AS j FROM v_concat_docs)
SELECT doc_id, {js('j', '$.Path')} AS name, coalesce({js('j', '$.Version')}, 'unknown') AS current, {js('j', '$.Update.Version')} AS latest FROM d WHERE coalesce({js('j', '$.Main')}, 'false') <> 'true'""")
def _(t):
    return R.parse_module_list(t["v_concat_docs"])


@query("vuln_ndjson", f"""WITH s AS (SELECT doc_id, unnest(json_extract(CAST(doc AS JSON), '$.vulns[*]')) AS j FROM v_vuln_docs WHERE json_valid(doc)
  UNION ALL SELECT doc_id, CAST(l AS JSON) FROM (SELECT doc_id, trim(unnest(string_split(doc, chr(10)))) AS l FROM v_vuln_docs WHERE NOT json_valid(doc)) x WHERE l <> '' AND json_valid(l) AND json_exists(CAST(l AS JSON), '$.osv'))
SELECT doc_id, {js('j', '$.osv.id')} AS vuln_id, coalesce({case("lower(json_extract_string(j, '$.osv.database_specific.severity'))", TOOL_SEVERITIES['osv'], 'NULL')}, CASE WHEN json_array_length(j, '$.modules[0].packages[0].callstacks') > 0 THEN 'high' ELSE 'medium' END) AS severity,
  coalesce({js('j', '$.osv.summary')}, 'Go vulnerability') AS summary, coalesce({js('j', '$.modules[0].path')}, 'unknown') AS module, {js('j', '$.modules[0].fixed_version')} AS fixed_version FROM s""")
def _(t):
    return R.parse_vulnerability_lines(t["v_vuln_docs"])


@query("lint_json", f"""WITH f AS (SELECT run_id, unnest(json_extract(CAST(doc AS JSON), '$[*]')) AS j FROM v_lint_docs WHERE json_valid(doc)), m AS (SELECT run_id, {js('j', '$.filePath')} AS file, unnest(json_extract(j, '$.messages[*]')) AS m FROM f)
SELECT run_id, file, CAST({js('m', '$.line')} AS INT) AS line, CASE WHEN {js('m', '$.severity')} = '2' THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN {js('m', '$.ruleId')} IS NOT NULL THEN concat({js('m', '$.message')}, ' (', {js('m', '$.ruleId')}, ')') ELSE {js('m', '$.message')} END AS message FROM m""")
def _(t):
    return R.parse_lint(t["v_lint_docs"])


LCOV = """tag AS (SELECT *, trim(text) AS x, max(CASE WHEN starts_with(trim(text), 'SF:') THEN line_no END) OVER (PARTITION BY report_id ORDER BY line_no) AS record FROM v_lcov_lines),
rec AS (SELECT report_id, record, max(CASE WHEN starts_with(x, 'SF:') THEN substring(x, 4) END) AS file, coalesce(max(CASE WHEN starts_with(x, 'LF:') THEN coalesce(try_cast(substring(x, 4) AS INT), 0) END), 0) AS found,
  coalesce(max(CASE WHEN starts_with(x, 'LH:') THEN coalesce(try_cast(substring(x, 4) AS INT), 0) END), 0) AS hit FROM tag WHERE record IS NOT NULL GROUP BY 1, 2 HAVING bool_or(x = 'end_of_record')),
lcov AS (SELECT report_id, file, found, hit, CASE WHEN found > 0 THEN CAST(hit AS DOUBLE) / found * 100 ELSE CAST(0 AS DOUBLE) END AS pct FROM (SELECT *, row_number() OVER (PARTITION BY report_id, file ORDER BY record DESC) AS rn FROM rec) r WHERE rn = 1)"""


@query("lcov", f"WITH {LCOV} SELECT * FROM lcov")
def _(t):
    return R.parse_lcov(t["v_lcov_lines"])


@query("lcov_score", f"WITH {LCOV} SELECT report_id, count(*) AS files, count(CASE WHEN pct < 50 THEN 1 END) AS below_half, CAST({half_up('least(100, greatest(0, CAST(sum(CAST(pct AS DECIMAL(20,6))) AS DOUBLE) / count(pct)))')} AS INT) AS score FROM lcov GROUP BY report_id")
def _(t):
    return R.lcov_score(R.parse_lcov(t["v_lcov_lines"]))


COV = f"""cov AS (SELECT report_id, k AS file, CAST(json_extract_string(c, '$.lines.total') AS BIGINT) AS total, CAST(json_extract_string(c, '$.lines.covered') AS BIGINT) AS covered, CAST(json_extract_string(c, '$.lines.pct') AS DOUBLE) AS pct
  FROM (SELECT report_id, k, json_extract(j, '$."' || k || '"') AS c FROM (SELECT report_id, CAST(doc AS JSON) AS j, unnest(json_keys(CAST(doc AS JSON))) AS k FROM v_coverage_json) a) b)"""


@query("coverage_summary", f"WITH {COV} SELECT * FROM cov")
def _(t):
    return R.parse_coverage_summary(t["v_coverage_json"])


@query("coverage_findings", f"WITH {COV} SELECT report_id, file, pct, CASE WHEN pct = 0 THEN 'critical' WHEN pct < 20 THEN 'high' ELSE 'medium' END AS severity FROM cov WHERE file <> 'total' AND pct < 50")
def _(t):
    rows = R.parse_coverage_summary(t["v_coverage_json"]).where("file <> 'total' AND pct < 50")
    return rows.select("report_id", "file", "pct", R.coverage_severity(F.col("pct")).alias("severity"))


@query("coverage_score", f"""WITH {COV}, s AS (SELECT report_id, max(CASE WHEN file = 'total' THEN pct END) AS tot, sum(CASE WHEN file <> 'total' THEN covered END) AS c, sum(CASE WHEN file <> 'total' THEN total END) AS n,
  count(CASE WHEN file <> 'total' THEN 1 END) AS files, count(CASE WHEN file <> 'total' AND pct < 50 THEN 1 END) AS below_half FROM cov GROUP BY report_id)
SELECT report_id, files, below_half, CAST({half_up('least(100, greatest(0, coalesce(tot, CASE WHEN n > 0 THEN CAST(c AS DOUBLE) / CAST(n AS DOUBLE) * 100 ELSE 0 END)))')} AS INT) AS score FROM s""")
def _(t):
    return R.coverage_score(R.parse_coverage_summary(t["v_coverage_json"]))


@query("lock_count", "SELECT repo_id, CAST((length(content) - length(replace(content, '[[package]]', ''))) / 11 AS INT) AS packages FROM v_lock_files")
def _(t):
    return t["v_lock_files"].select("repo_id", F.regexp_count("content", F.lit(r"\[\[package\]\]")).alias("packages"))


WORDS = r"""CASE WHEN regexp_matches(m, '(?i)\berror\b') THEN 'high' WHEN regexp_matches(m, '(?i)\bwarn(ing)?\b') THEN 'medium' ELSE 'high' END"""
DIAG = r"""t AS (SELECT run_id, line_no, text, trim(text) AS x FROM v_log_lines),
st AS (SELECT run_id, CASE WHEN regexp_matches(x, 'P1') THEN regexp_extract(x, 'P1', 1) WHEN regexp_matches(x, 'P2') THEN regexp_extract(x, 'P2', 1) ELSE '(command output)' END AS file,
  CAST(CASE WHEN regexp_matches(x, 'P1') THEN regexp_extract(x, 'P1', 2) WHEN regexp_matches(x, 'P2') THEN regexp_extract(x, 'P2', 2) END AS INT) AS line,
  CASE WHEN regexp_matches(x, 'P1') THEN (SELECT WORDS FROM (SELECT regexp_extract(x, 'P1', 4) AS m) q) WHEN regexp_matches(x, 'P2') THEN 'high' WHEN regexp_matches(x, '(?i)^error') THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN regexp_matches(x, 'P1') THEN regexp_extract(x, 'P1', 4) WHEN regexp_matches(x, 'P2') THEN regexp_extract(x, 'P2', 4) ELSE x END AS message
  FROM t WHERE regexp_matches(x, 'P1') OR regexp_matches(x, 'P2') OR regexp_matches(x, 'P3')),
bad AS (SELECT run_id, exit_code FROM v_runs r WHERE exit_code <> 0 AND NOT EXISTS (SELECT 1 FROM st WHERE st.run_id = r.run_id)),
sl AS (SELECT t.*, min(CASE WHEN x <> '' THEN line_no END) OVER (PARTITION BY run_id) AS start FROM t JOIN bad USING (run_id)),
hd AS (SELECT run_id, trim(string_agg(text, ' ' ORDER BY line_no, text)) AS message FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no, text) AS rn FROM sl WHERE line_no >= start) y WHERE rn <= 8 GROUP BY run_id),
diag AS (SELECT * FROM st UNION ALL SELECT b.run_id, '(command output)', NULL, 'high', coalesce(h.message, concat('Command exited with code ', CAST(b.exit_code AS VARCHAR), ' (no output captured)')) FROM bad b LEFT JOIN hd h USING (run_id))""".replace(
    "WORDS", WORDS).replace("P1", R.PLACE).replace("P2", R.PAREN).replace("P3", R.HEADING)


@query("diagnostics", f"WITH {DIAG} SELECT * FROM diag")
def _(t):
    return R.parse_diagnostics(t["v_log_lines"], t["v_runs"].select("run_id", "exit_code"))


@query("count_penalty", f"WITH {DIAG} SELECT run_id, count(*) AS n, CAST(greatest(0, 100 - count(*) * 3) AS INT) AS lint_score, CAST(greatest(0, 100 - count(CASE WHEN severity = 'medium' THEN 1 END) * 3 - count(CASE WHEN severity = 'high' THEN 1 END) * 10) AS INT) AS compiler_score, CAST(greatest(0, 100 - count(*) * 15) AS INT) AS cycle_score FROM diag GROUP BY run_id")
def _(t):
    rows = R.parse_diagnostics(t["v_log_lines"], t["v_runs"].select("run_id", "exit_code"))
    n, medium, high = F.count(F.lit(1)), count_if(F.col("severity") == "medium"), count_if(F.col("severity") == "high")
    return rows.groupBy("run_id").agg(
        n.alias("n"), scoring.count_penalty(n, 3).alias("lint_score"),
        F.greatest(F.lit(0), F.lit(100) - medium * 3 - high * 10).cast("int").alias("compiler_score"),
        scoring.count_penalty(n, 15).alias("cycle_score"))


VET_SQL = f"regexp_matches(trim(text), '{R.VET}')"


@query("vet_lines", f"SELECT run_id, regexp_extract(trim(text), '{R.VET}', 1) AS file, CAST(regexp_extract(trim(text), '{R.VET}', 2) AS INT) AS line, regexp_extract(trim(text), '{R.VET}', 3) AS message FROM v_log_lines WHERE {VET_SQL}")
def _(t):
    return R.parse_vet(t["v_log_lines"])


@query("deadcode_lines", f"""SELECT run_id, CASE WHEN {VET_SQL} THEN regexp_extract(trim(text), '{R.VET}', 1) ELSE 'unknown' END AS file, CASE WHEN {VET_SQL} THEN CAST(regexp_extract(trim(text), '{R.VET}', 2) AS INT) END AS line,
  CASE WHEN {VET_SQL} THEN regexp_extract(trim(text), '{R.VET}', 3) ELSE concat('Unused function: ', trim(text)) END AS message FROM v_log_lines WHERE trim(text) <> ''""")
def _(t):
    return R.parse_vet(t["v_log_lines"], loose=True)


@query("update_log", f"""WITH u AS (SELECT run_id, text, regexp_matches(text, '{R.UNCHANGED}') AS pinned FROM v_log_lines WHERE regexp_matches(text, '{R.UNCHANGED}') OR regexp_matches(text, '{R.UPDATING}')),
p AS (SELECT run_id, pinned, CASE WHEN pinned THEN regexp_extract(text, '{R.UNCHANGED}', 1) ELSE regexp_extract(text, '{R.UPDATING}', 1) END AS name, CASE WHEN pinned THEN regexp_extract(text, '{R.UNCHANGED}', 2) ELSE regexp_extract(text, '{R.UPDATING}', 2) END AS current,
  CASE WHEN pinned THEN regexp_extract(text, '{R.UNCHANGED}', 3) ELSE regexp_extract(text, '{R.UPDATING}', 3) END AS latest FROM u)
SELECT *, CASE WHEN string_split(current, '.')[1] <> string_split(latest, '.')[1] THEN 'high' WHEN string_split(current, '.')[2] <> string_split(latest, '.')[2] THEN 'medium' ELSE 'low' END AS severity FROM p""")
def _(t):
    return R.parse_update_log(t["v_log_lines"])


TESTLOG = f"""tl AS (SELECT run_id, count(pct) AS packages, CAST(sum(CAST(pct AS DECIMAL(20,6))) AS DOUBLE) / nullif(count(pct), 0) AS coverage, count(CASE WHEN contains(text, '[no test files]') THEN 1 END) AS no_test_files,
  count(CASE WHEN starts_with(text, '--- FAIL:') THEN 1 END) AS failures, {', '.join(f"arg_min(try_cast(regexp_extract(text, '{R.RUST_RESULT}', {g}) AS INT), (line_no, text)) FILTER (regexp_matches(text, '{R.RUST_RESULT}')) AS {n}" for g, n in ((2, 'passed'), (3, 'failed'), (4, 'ignored')))}
  FROM (SELECT *, try_cast(nullif(regexp_extract(text, '{R.GO_COVERAGE}', 1), '') AS DOUBLE) AS pct FROM v_log_lines) x GROUP BY run_id)"""


@query("test_log", f"WITH {TESTLOG} SELECT * FROM tl")
def _(t):
    return R.parse_test_log(t["v_log_lines"])


@query("test_scores", f"WITH {TESTLOG} SELECT run_id, CAST(coalesce({half_up('least(100, greatest(0, coverage))').replace('CAST(floor', 'CAST(CASE WHEN coverage IS NULL THEN 0 ELSE floor').replace(' AS BIGINT)', ' END AS BIGINT)')}, 0) AS INT) AS go_score, CASE WHEN passed IS NULL THEN 0 WHEN failed > 0 THEN 50 ELSE 100 END AS rust_score FROM tl")
def _(t):
    return R.test_scores(R.parse_test_log(t["v_log_lines"]))


@query("exec_result", "SELECT run_id, module_id, CASE WHEN command IS NULL THEN -1 WHEN exit_code = 0 THEN 100 ELSE 0 END AS score, CAST(CASE WHEN command IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS confidence, CASE WHEN command IS NULL THEN 'not_applicable' ELSE 'completed' END AS state FROM v_runs")
def _(t):
    return R.execution_result(t["v_runs"])


def _sv(col: str) -> str:
    clean = f"string_split(regexp_replace({col}, '^[^0-9]*', ''), '.')"
    return "[" + ", ".join(f"coalesce(try_cast(nullif(regexp_extract(coalesce({clean}[{i}], ''), '^\\s*([0-9]+)', 1), '') AS INT), 0)" for i in (1, 2, 3)) + "]"


@query("semver", f"SELECT repo_id, name, current, v[1] AS major, v[2] AS minor, v[3] AS patch FROM (SELECT *, {_sv('current')} AS v FROM v_deps) x")
def _(t):
    v = semver(F.col("current"))
    return t["v_deps"].select("repo_id", "name", "current", v[0].alias("major"), v[1].alias("minor"), v[2].alias("patch"))


@query("vulnerable_deps", f"""SELECT d.repo_id, d.name, d.current, a.advisory_id, {case('lower(a.severity)', NPM, "'info'")} AS severity, concat(title, ' (', d.name, ')', CASE WHEN url <> '' THEN concat(' — ', url) ELSE '' END) AS message,
  CASE WHEN fixed IS NOT NULL THEN concat('Update ', d.name, ' to ', fixed) ELSE 'Review the advisory and update the affected package.' END AS suggestion
FROM v_deps d JOIN v_advisories a USING (name) WHERE {_sv('d.current')} >= {_sv("coalesce(a.lo, '0')")} AND {_sv('d.current')} < {_sv('a.hi')}""")
def _(t):
    return DP.vulnerable_deps(t["v_deps"], t["v_advisories"])


OUTDATED = f"""ov AS (SELECT d.repo_id, d.name, d.current, r.latest, {_sv('d.current')} AS a, {_sv('r.latest')} AS b FROM v_deps d JOIN v_registry r USING (name) WHERE r.latest <> '--'),
outd AS (SELECT repo_id, name, current, latest, CASE WHEN b[1] - a[1] >= 2 THEN 'high' WHEN b[1] - a[1] >= 1 THEN 'medium' WHEN b[2] - a[2] > 0 THEN 'low' ELSE 'info' END AS severity,
  CASE WHEN a[1] <> b[1] THEN 'high' WHEN a[2] <> b[2] THEN 'medium' ELSE 'low' END AS cargo_severity, 'low' AS go_severity FROM ov WHERE a < b)"""


@query("outdated_deps", f"WITH {OUTDATED} SELECT * FROM outd")
def _(t):
    return DP.outdated_deps(t["v_deps"], t["v_registry"])


@query("dependency_score", f"""WITH {OUTDATED}, de AS (SELECT repo_id, count(*) AS declared FROM v_deps GROUP BY 1), be AS (SELECT repo_id, count(*) AS n, CAST(sum(CAST(CASE severity WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.2 ELSE 0.05 END AS DECIMAL(20,6))) AS DOUBLE) AS p FROM outd GROUP BY 1)
SELECT repo_id, declared, coalesce(n, 0) AS outdated, CAST(greatest(0, floor(100 * (1 - coalesce(p, CAST(0 AS DOUBLE)) / (greatest(declared, coalesce(n, 0)) * CAST(0.8 AS DOUBLE))) + 0.5)) AS INT) AS score FROM de LEFT JOIN be USING (repo_id)""")
def _(t):
    return DP.dependency_score(t["v_deps"], DP.outdated_deps(t["v_deps"], t["v_registry"]))


def _dead_sql() -> str:
    """Oracle of the dead-code score, over the oracles of its three parts."""
    def part(name):
        return REGISTRY[name].sql

    return f"""WITH a AS (SELECT repo_id, count(*) AS n FROM ({part('dead_files')}) x GROUP BY 1), b AS (SELECT repo_id, count(*) AS n FROM ({part('dead_exports')}) y GROUP BY 1), c AS (SELECT repo_id, count(*) AS n FROM ({part('dead_deps')}) z GROUP BY 1)
SELECT a.repo_id, a.n AS files, coalesce(b.n, 0) AS exports, coalesce(c.n, 0) AS deps, CAST(greatest(0, floor(100 - (a.n * 5 + least(coalesce(b.n, 0) * 0.5, 30.0) + coalesce(c.n, 0) * 5) + 0.5)) AS INT) AS score FROM a LEFT JOIN b USING (repo_id) LEFT JOIN c USING (repo_id)"""


@query("dead_code_score", _dead_sql())
def _(t):
    scripts = t["v_code_files"].where(F.rlike("path", F.lit(r"\.(ts|tsx|js|jsx)$")))
    roles, resolved = file_roles(scripts), cut_lineage(_resolved(t))  # read three times

    def count(rows, name):
        return rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))

    files = count(dead_files(roles, import_edges(resolved)), "files")
    exports = count(dead_exports(scripts, resolved, roles), "_e")
    deps = count(dead_deps(manifest_deps(manifests(t["v_code_files"])).select("repo_id", "name"), t["v_code_files"]), "_d")
    out = files.join(exports, "repo_id", "left").join(deps, "repo_id", "left")
    e, d = F.coalesce("_e", F.lit(0)), F.coalesce("_d", F.lit(0))
    return out.select("repo_id", "files", e.alias("exports"), d.alias("deps"), scoring.dead_code_score(F.col("files"), e, d).alias("score"))
