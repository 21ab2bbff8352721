"""Queries over findings and module results."""

from __future__ import annotations

from pyspark.sql import functions as F

from repohealth.functions import severity as S
from repohealth.functions.paths import basename, dirname
from repohealth.functions.scalars import count_if, fingerprint, keep_found
from repohealth.operators import findings as O
from repohealth.operators import history as H
from repohealth.operators import scoring
from repohealth.operators.ordered import first_per_key, latest_per_key, top_per_key, with_position
from repohealth.operators.shape import classify_layer
from repohealth.plans.registry import query
from repohealth.plans.sqltext import RANKED_SCANS, SEV_RANK, case, esum, fp, half_up, q
from repohealth.sources.views import Tables

IGNORES = ["lib/db/**", "components*", "**/core"]
IGNORE_SQL = " AND ".join(f"NOT starts_with(file_path, {q(p)})" for p in ("lib/db/", "components", "**/core"))


def newest_findings(t: Tables, view: str = "v_rich_findings"):
    """Findings of the newest completed scan of every repository."""
    newest = latest_per_key(H.completed(t["v_scans"]), ["repo_id"], H.SCAN_ORDER).select("repo_id", "scan_id")
    return t[view].join(newest, "scan_id")


NEWEST = """newest AS (SELECT f.*, l.repo_id FROM v_rich_findings f JOIN (SELECT repo_id, scan_id,
  row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, scan_id DESC) AS rn FROM v_scans WHERE status = 'completed') l USING (scan_id) WHERE l.rn = 1)"""


@query("severity_counts", """SELECT module_id, count(CASE WHEN lower(severity) = 'critical' THEN 1 END) AS critical, count(CASE WHEN lower(severity) = 'high' THEN 1 END) AS high,
  count(CASE WHEN lower(severity) = 'medium' THEN 1 END) AS medium, count(CASE WHEN lower(severity) = 'low' THEN 1 END) AS low,
  count(CASE WHEN lower(severity) = 'info' THEN 1 END) AS info, count(*) AS total FROM v_rich_findings GROUP BY module_id""")
def _(t):
    return scoring.severity_counts(t["v_rich_findings"], ["module_id"])


OKSQL = "coalesce((state IS NULL OR state = 'completed') AND score >= 0, false)"


@query("score_summary", f"""SELECT scan_id, count(*) AS total, count(CASE WHEN {OKSQL} THEN 1 END) AS scored, count(CASE WHEN {OKSQL} AND score > 60 THEN 1 END) AS passing,
  count(CASE WHEN NOT {OKSQL} AND state = 'not_applicable' THEN 1 END) AS not_applicable, count(CASE WHEN NOT {OKSQL} AND state = 'unavailable' THEN 1 END) AS unavailable,
  count(CASE WHEN NOT {OKSQL} AND coalesce(state, '') NOT IN ('not_applicable', 'unavailable') THEN 1 END) AS neutral
FROM v_named_results GROUP BY scan_id""")
def _(t):
    return scoring.score_summary(t["v_named_results"], ["scan_id"])


FAMILY_OF = {"security": "security", "dependencies": "secrets-scan", "git-health": "api-health", "complexity": "error-handling"}


def _points():
    out = None
    for module, family in FAMILY_OF.items():
        pts = scoring.deduction_points(family, F.lower("severity"), unknown=2 if family == "error-handling" else 0)
        out = F.when(F.col("module_id") == module, pts) if out is None else out.when(F.col("module_id") == module, pts)
    return out


POINTS_SQL = "CASE module_id " + " ".join(
    f"WHEN '{m}' THEN {case('lower(severity)', S.DEDUCTIONS[f], '2' if f == 'error-handling' else '0')}" for m, f in FAMILY_OF.items()
) + " END"


@query("deduction_score", f"""SELECT scan_id, module_id, count(*) AS findings, CAST(greatest(0, 100 - sum({POINTS_SQL})) AS INT) AS score
FROM v_rich_findings GROUP BY scan_id, module_id""")
def _(t):
    return scoring.deduction_score(t["v_rich_findings"], ["scan_id", "module_id"], _points())


@query("dedupe", f"""SELECT scan_id, fingerprint, finding_id, severity, line FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, fingerprint ORDER BY line, finding_id, severity) AS rn
FROM (SELECT *, {fp()} AS fingerprint FROM v_findings) a) b WHERE rn = 1""")
def _(t):
    rows = H.with_fingerprint(t["v_findings"]).select("scan_id", "fingerprint", "finding_id", "severity", "line")
    return O.dedupe(rows, ["scan_id", "fingerprint"], ["line", "finding_id", "severity"])


@query("fingerprint", f"SELECT finding_id, {fp()} AS fingerprint FROM v_rich_findings")
def _(t):
    return t["v_rich_findings"].select("finding_id", fingerprint(
        F.col("module_id"), F.col("file_path"), F.col("category"), F.col("message")).alias("fingerprint"))


@query("ignore_prefix", f"SELECT finding_id, file_path FROM v_rich_findings WHERE file_path IS NULL OR ({IGNORE_SQL})")
def _(t):
    return O.ignore_paths(t["v_rich_findings"], IGNORES).select("finding_id", "file_path")


GLOBS = ["lib/**/*.ts", "components", "app/*/f1?.*", "/utils/**"]


@query("ignore_glob", f"SELECT finding_id, file_path FROM v_rich_findings WHERE file_path IS NULL OR NOT ({' OR '.join(f'regexp_matches(file_path, {q(O.ignore_regex(g))})' for g in GLOBS)})")
def _(t):
    return O.ignore_paths(t["v_rich_findings"], GLOBS, "glob").select("finding_id", "file_path")


@query("findings_query", f"""SELECT finding_id, scan_id, module_id, severity, message, (SELECT count(*) FROM v_rich_findings WHERE lower(severity) = 'high' AND module_id = 'security' AND status = 'regressed') AS total
FROM v_rich_findings WHERE lower(severity) = 'high' AND module_id = 'security' AND status = 'regressed' ORDER BY {SEV_RANK}, finding_id, message LIMIT 50""")
def _(t):
    return O.query_findings(t["v_rich_findings"], "high", "security", "regressed").select(
        "finding_id", "scan_id", "module_id", "severity", "message", "total")


@query("list_scans", """SELECT s.scan_id, s.status, s.created_at, s.overall_score, r.name FROM v_scans s LEFT JOIN v_repos r USING (repo_id)
WHERE s.status = 'completed' ORDER BY s.created_at DESC, s.scan_id DESC LIMIT 50""")
def _(t):
    newest = H.completed(t["v_scans"]).orderBy(F.col("created_at").desc(), F.col("scan_id").desc()).limit(50)
    return newest.join(t["v_repos"].select("repo_id", "name"), "repo_id", "left").select(
        "scan_id", "status", "created_at", "overall_score", "name")


@query("active_repos", "SELECT repo_id, name, CASE WHEN active THEN 'active' ELSE 'inactive' END AS tab FROM v_repos")
def _(t):
    return t["v_repos"].select("repo_id", "name", F.when(F.col("active"), "active").otherwise("inactive").alias("tab"))


@query("scan_bundle", """SELECT m.scan_id, m.module_id, m.score, m.confidence, m.state, f.finding_id, f.severity, f.file_path
FROM v_scans s JOIN v_named_results m USING (scan_id) LEFT JOIN v_rich_findings f ON f.scan_id = m.scan_id AND f.module_id = m.module_id WHERE s.status = 'completed'""")
def _(t):
    """Modules and findings of every completed scan, one row per finding."""
    scans = H.completed(t["v_scans"]).select("scan_id")
    return t["v_named_results"].join(scans, "scan_id").join(
        t["v_rich_findings"].select("scan_id", "module_id", "finding_id", "severity", "file_path"), ["scan_id", "module_id"], "left"
    ).select("scan_id", "module_id", "score", "confidence", "state", "finding_id", "severity", "file_path")


@query("finding_enriched", """SELECT f.finding_id, f.scan_id, f.module_id, m.confidence AS module_confidence, m.state AS module_state, m.state = 'completed' AS applicable
FROM v_rich_findings f JOIN v_named_results m ON f.scan_id = m.scan_id AND f.module_id = m.module_id""")
def _(t):
    modules = t["v_named_results"].select(
        "scan_id", "module_id", F.col("confidence").alias("module_confidence"), F.col("state").alias("module_state"))
    return t["v_rich_findings"].join(modules, ["scan_id", "module_id"]).select(
        "finding_id", "scan_id", "module_id", "module_confidence", "module_state",
        (F.col("module_state") == "completed").alias("applicable"))


@query("module_payload", """SELECT m.scan_id, m.module_id, count(f.finding_id) AS findings_count,
  count(CASE WHEN f.suggestion <> '' THEN 1 END) AS suggestion_count, coalesce(m.state, 'completed') = 'completed' AS applicable
FROM v_named_results m LEFT JOIN v_rich_findings f ON f.scan_id = m.scan_id AND f.module_id = m.module_id GROUP BY m.scan_id, m.module_id, m.state""")
def _(t):
    counts = t["v_rich_findings"].groupBy("scan_id", "module_id").agg(
        F.count(F.lit(1)).alias("_n"), count_if(F.col("suggestion") != "").alias("_s"))
    zero = F.lit(0)
    return t["v_named_results"].join(counts, ["scan_id", "module_id"], "left").select(
        "scan_id", "module_id", F.coalesce("_n", zero).cast("bigint").alias("findings_count"),
        F.coalesce("_s", zero).cast("bigint").alias("suggestion_count"),
        (F.coalesce("state", F.lit("completed")) == "completed").alias("applicable"))


@query("metrics_long", """SELECT scan_id, module_id, k AS key, CAST(json_extract_string(metrics, '$.' || k) AS DOUBLE) AS value
FROM (SELECT *, unnest(['total', 'high']) AS k FROM v_named_results WHERE metrics <> 'not json') x""")
def _(t):
    """Metrics JSON to rows; malformed documents give none."""
    rows = t["v_named_results"].select("scan_id", "module_id", F.from_json("metrics", "map<string,double>").alias("m"))
    return rows.select("scan_id", "module_id", F.explode("m").alias("key", "value"))


FILE_HEALTH_SQL = f"""WITH x AS (SELECT *, lower(severity) AS sev FROM v_rich_findings WHERE coalesce(file_path, '') <> ''),
g AS (SELECT scan_id, file_path, CAST(least(100, greatest(0, 100 - sum({case('sev', S.FILE_HEALTH_POINTS, '0')}))) AS INT) AS health, count(*) AS findings,
  count(CASE WHEN sev = 'critical' THEN 1 END) AS critical, count(CASE WHEN sev = 'high' THEN 1 END) AS high, count(CASE WHEN sev = 'medium' THEN 1 END) AS medium,
  count(CASE WHEN sev = 'low' THEN 1 END) AS low, count(CASE WHEN sev = 'info' THEN 1 END) AS info FROM x GROUP BY scan_id, file_path),
d AS (SELECT scan_id, file_path, module_id, row_number() OVER (PARTITION BY scan_id, file_path ORDER BY count(*) DESC, module_id) AS rn FROM x GROUP BY scan_id, file_path, module_id)
SELECT g.*, d.module_id AS dominant_module, CASE WHEN health <= 40 THEN 'red' WHEN health <= 70 THEN 'yellow' ELSE 'green' END AS color FROM g JOIN d USING (scan_id, file_path) WHERE rn = 1"""


@query("file_health", FILE_HEALTH_SQL)
def _(t):
    return O.file_health(t["v_rich_findings"], ["scan_id"])


@query("graph_filter", f"""SELECT * FROM (SELECT scan_id, file_path, color, CASE WHEN starts_with(file_path, 'app/api/') THEN 'API' WHEN starts_with(file_path, 'components/') THEN 'UI'
  WHEN starts_with(file_path, 'lib/db/') THEN 'Data' ELSE 'Unknown' END AS layer FROM ({FILE_HEALTH_SQL}) h) y
WHERE color IN ('red', 'yellow') AND layer IN ('API', 'Data') AND contains(lower(file_path), 'f1')""")
def _(t):
    """Nodes of a map by colour, layer and a case-insensitive piece of the path."""
    nodes = O.file_health(t["v_rich_findings"], ["scan_id"]).where(F.lower("file_path").contains("F1".lower()))
    layer = classify_layer(F.col("file_path"))
    wanted = F.when(layer.isin("API", "Data") & F.col("color").isin("red", "yellow"), layer)
    return keep_found(nodes, "layer", wanted).select("scan_id", "file_path", "color", "layer")


@query("blocking", """SELECT scan_id, coalesce(file_path, '') AS file_path, count(*) AS blocking FROM v_rich_findings
WHERE lower(severity) = 'critical' OR (category = 'security' AND lower(severity) = 'high') GROUP BY 1, 2""")
def _(t):
    rows = t["v_rich_findings"].where(S.is_blocking(F.lower("severity"), F.col("category")))
    return rows.groupBy("scan_id", F.coalesce("file_path", F.lit("")).alias("file_path")).agg(F.count(F.lit(1)).alias("blocking"))


@query("bands", """SELECT scan_id, module_id, score, CASE WHEN score <= 40 THEN 'red' WHEN score <= 70 THEN 'yellow' ELSE 'green' END AS bucket,
  CASE WHEN score >= 80 THEN 'green' WHEN score >= 60 THEN 'yellow' WHEN score >= 40 THEN 'orange' ELSE 'red' END AS color,
  CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'moderate' WHEN score >= 25 THEN 'low' ELSE 'minimal' END AS feedback FROM v_named_results""")
def _(t):
    s = F.col("score")
    return t["v_named_results"].select("scan_id", "module_id", "score", S.health_color(s).alias("bucket"),
                                       S.score_color(s).alias("color"), S.feedback_rating(s).alias("feedback"))


@query("risk_map", f"""SELECT finding_id, {case('lower(severity)', {k: v[0] for k, v in S.RISK_LABELS.items()}, "concat('Unknown Risk Level (', severity, ')')")} AS label,
  {case('lower(severity)', {k: v[1] for k, v in S.RISK_LABELS.items()}, "'Unknown'")} AS urgency FROM v_rich_findings""")
def _(t):
    s = F.col("severity")
    return t["v_rich_findings"].select("finding_id", S.risk_label(s).alias("label"), S.risk_urgency(s).alias("urgency"))


@query("severity_map", "SELECT finding_id, " + ", ".join(
    f"{case('lower(severity)', m, q(S.TOOL_DEFAULTS[tool]))} AS {tool}" for tool, m in S.TOOL_SEVERITIES.items()) + " FROM v_rich_findings")
def _(t):
    s = F.col("severity")
    return t["v_rich_findings"].select("finding_id", *[S.tool_severity(tool, s).alias(tool) for tool in S.TOOL_SEVERITIES])


@query("soften", """SELECT finding_id, CASE WHEN scan_id % 2 = 0 THEN CASE lower(severity) WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE 'info' END
  ELSE lower(severity) END AS severity FROM v_rich_findings""")
def _(t):
    archetype = F.when(F.col("scan_id") % 2 == 0, "prototype").otherwise("library")
    return t["v_rich_findings"].select("finding_id", S.soften(F.lower("severity"), archetype).alias("severity"))


@query("top_risks", f"""WITH {NEWEST} SELECT repo_id, finding_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {SEV_RANK}, finding_id, message) AS rn FROM newest) x WHERE rn <= 3""")
def _(t):
    order = [S.severity_rank(F.col("severity")), F.col("finding_id"), F.col("message")]
    return top_per_key(newest_findings(t), ["repo_id"], order, 3).select("repo_id", "finding_id", "severity")


@query("top_findings", f"""WITH {NEWEST} SELECT repo_id, finding_id, severity, CAST(rn AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {SEV_RANK}, finding_id, message) AS rn FROM newest) x WHERE rn <= 20""")
def _(t):
    order = [S.severity_rank(F.col("severity")), F.col("finding_id"), F.col("message")]
    return top_per_key(newest_findings(t), ["repo_id"], order, 20, rank="place").select("repo_id", "finding_id", "severity", "place")


@query("findings_sort", """SELECT finding_id, status, line, row_number() OVER (ORDER BY CASE status WHEN 'new' THEN 0 WHEN 'regressed' THEN 1 WHEN 'recurring' THEN 2 ELSE 3 END, coalesce(line, 0), finding_id, message, confidence) AS position FROM v_rich_findings""")
def _(t):
    """All findings by status rank, then line; the position comes from a range-partitioned sort."""
    order = [S.status_rank(F.col("status")), F.coalesce("line", F.lit(0)), F.col("finding_id"), F.col("message"), F.col("confidence")]
    rows = t["v_rich_findings"].select("finding_id", "status", "line", "message", "confidence")
    return with_position(rows, [], order).select("finding_id", "status", "line", "position")


PRIORITY_SQL = f"""({case('lower(severity)', S.PRIORITY_WEIGHTS, '1')} * CASE WHEN lower(severity) = 'critical' THEN greatest(confidence, CAST(0.5 AS DOUBLE)) ELSE confidence END * (1 + coalesce(churn_rate, CAST(0 AS DOUBLE))))"""
CHURN_SQL = "churn AS (SELECT file_path, count(*) / CAST(1000 AS DOUBLE) AS churn_rate FROM v_rich_findings WHERE category = 'churn' GROUP BY file_path)"
PRIO = f"""WITH {CHURN_SQL}, prio AS (SELECT f.*, {PRIORITY_SQL} AS priority FROM v_rich_findings f LEFT JOIN churn USING (file_path) WHERE coalesce(status <> 'fixed', true)),
grouped AS (SELECT scan_id, CASE WHEN coalesce(file_path, '') = '' THEN '(unknown)' ELSE file_path END AS path, * EXCLUDE (scan_id, file_path) FROM prio)"""


def _prioritized(t):
    rows = t["v_rich_findings"]
    churn = rows.where("category = 'churn'").groupBy("file_path").agg((F.count(F.lit(1)) / F.lit(1000.0)).alias("churn_rate"))
    return O.prioritize(rows, churn)


@query("priority", f"{PRIO} SELECT finding_id, round(priority, 6) AS priority FROM prio")
def _(t):
    return _prioritized(t).select("finding_id", F.round("priority", 6).alias("priority"))


TOP_FILES_SQL = f"""{PRIO}, gs AS (SELECT scan_id, path AS file_path, {esum('priority')} AS group_score, count(*) AS findings FROM grouped GROUP BY scan_id, path)
SELECT scan_id, file_path, group_score, findings, CAST(rn AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY group_score DESC, file_path) AS rn FROM gs) x"""


@query("file_priority", f"{TOP_FILES_SQL} WHERE rn <= 10")
def _(t):
    return O.top_files(_prioritized(t), ["scan_id"], 10)


BUNDLE_SQL = f"""{PRIO}, cmd AS (SELECT scan_id, path, count(DISTINCT c) AS commands FROM (SELECT scan_id, path, unnest(regexp_extract_all(coalesce(suggestion, ''), '`([^`]+)`', 1)) AS c FROM grouped) y GROUP BY scan_id, path),
b AS (SELECT scan_id, path AS file_path, string_agg(DISTINCT module_id, ',' ORDER BY module_id) AS modules, string_agg(DISTINCT lower(severity), ',' ORDER BY lower(severity)) AS severities, count(*) AS findings,
  bool_or(lower(severity) = 'critical' OR (category = 'security' AND lower(severity) = 'high')) AS blocking, bool_or(coalesce(suggestion, '') <> '') AS suggests,
  bool_and(category IN ({', '.join(map(q, O.RECIPE_CATEGORIES))})) AS recipe, bool_or(lower(severity) = 'critical') AS crit, bool_or(lower(severity) = 'high') AS hi
  FROM grouped GROUP BY scan_id, path)
SELECT b.scan_id, b.file_path, modules, severities, findings, coalesce(commands, 0) AS commands, blocking,
  CASE WHEN coalesce(commands, 0) > 0 OR suggests OR recipe THEN 'deterministic' ELSE 'exploratory' END AS task_type,
  CASE WHEN crit OR findings > 5 THEN 'high' WHEN hi OR findings > 2 THEN 'medium' ELSE 'low' END AS effort
FROM b LEFT JOIN cmd ON cmd.scan_id = b.scan_id AND cmd.path = b.file_path"""


@query("action_bundles", BUNDLE_SQL)
def _(t):
    return O.action_bundles(_prioritized(t), ["scan_id"])


@query("action_items", f"""{PRIO} SELECT scan_id, file_path, finding_id, unnest(list_distinct(regexp_extract_all(coalesce(suggestion, ''), '`([^`]+)`', 1))) AS command FROM prio""")
def _(t):
    return O.action_items(_prioritized(t))


@query("effort", f"""SELECT scan_id, file_path, effort FROM ({BUNDLE_SQL}) z""")
def _(t):
    return O.action_bundles(_prioritized(t), ["scan_id"]).select("scan_id", "file_path", "effort")


@query("next_actions", f"""WITH top AS ({TOP_FILES_SQL} WHERE rn <= 5), bun AS ({BUNDLE_SQL})
SELECT top.scan_id, top.file_path, top.position, bun.task_type, bun.effort, bun.modules FROM top JOIN bun USING (scan_id, file_path)""")
def _(t):
    rows = _prioritized(t)
    keys = ["scan_id", "file_path"]
    head = O.top_files(rows, ["scan_id"], 5).select(*keys, "position")
    return head.join(O.action_bundles(rows, ["scan_id"]), keys).select(*keys, "position", "task_type", "effort", "modules")


@query("dominant_category", f"""WITH c AS (SELECT scan_id, coalesce(file_path, '') AS file_path, category, count(*) AS n FROM v_rich_findings GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, file_path ORDER BY n DESC, category) AS rn FROM c)
SELECT scan_id, file_path, category, {case('category', O.TEMPLATE_FAMILIES, "'generic'")} AS family FROM r WHERE rn = 1""")
def _(t):
    rows = t["v_rich_findings"].withColumn("file_path", F.coalesce("file_path", F.lit("")))
    return O.dominant_category(rows, ["scan_id", "file_path"])


@query("message_facts", f"""SELECT finding_id, try_cast(nullif(regexp_extract(message, '([0-9]+)\\s+commits', 1), '') AS INT) AS commits,
  try_cast(nullif(regexp_extract(message, '(?i)([0-9]+)\\s*(?:lines?|LOC)', 1), '') AS INT) AS loc,
  try_cast(nullif(regexp_extract(message, '(?i)complexity[:\\s]+([0-9]+)', 1), '') AS INT) AS complexity,
  nullif(regexp_extract(message, {q(O.AUTHOR_PATTERN)}, 1), '') AS author FROM v_rich_findings""")
def _(t):
    return t["v_rich_findings"].select("finding_id", O.message_facts(F.col("message")).alias("m")).select("finding_id", "m.*")


@query("message_edges", r"""WITH x AS (SELECT *, nullif(regexp_extract(message, '(?i)(?:cycle|circular)[^:]*:\s*([A-Za-z0-9_./@-]+(?:\s*(?:->|→|=>)\s*[A-Za-z0-9_./@-]+)+)', 1), '') AS chain
  FROM v_rich_findings WHERE coalesce(file_path, '') <> ''),
n AS (SELECT DISTINCT chain, string_split_regex(chain, '\s*(?:->|→|=>)\s*') AS p FROM x WHERE chain IS NOT NULL),
e AS (SELECT p[i] AS src, p[i + 1] AS dst, true AS in_cycle FROM (SELECT p, unnest(range(1, len(p))) AS i FROM n) y
  UNION ALL SELECT file_path, nullif(regexp_extract(message, '(?i)(?:depends on|imports|requires)\s+[\x27\x22]?([A-Za-z0-9_./@-]+)', 1), ''),
    lower(severity) IN ('critical', 'high') OR contains(lower(message), 'circular') OR contains(lower(message), 'cycle') FROM x WHERE chain IS NULL)
SELECT src, dst, bool_or(in_cycle) AS in_cycle FROM e WHERE dst IS NOT NULL GROUP BY src, dst""")
def _(t):
    return O.message_edges(t["v_rich_findings"])


@query("treemap", """WITH f AS (SELECT scan_id, file_path, sum(coalesce(try_cast(nullif(regexp_extract(message, '(?i)([0-9]+)\\s*(?:lines?|LOC)', 1), '') AS INT), 50)) AS loc,
  max(coalesce(try_cast(nullif(regexp_extract(message, '(?i)complexity[:\\s]+([0-9]+)', 1), '') AS INT), CASE lower(severity) WHEN 'critical' THEN 20 WHEN 'high' THEN 15 WHEN 'medium' THEN 10 WHEN 'low' THEN 5 ELSE 3 END)) AS complexity
  FROM v_rich_findings WHERE coalesce(file_path, '') <> '' GROUP BY scan_id, file_path),
d AS (SELECT *, CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE '(root)' END AS dir FROM f),
n AS (SELECT scan_id, dir, count(*) AS files FROM d GROUP BY scan_id, dir)
SELECT d.scan_id, CASE WHEN n.files = 1 THEN NULL ELSE d.dir END AS parent, CASE WHEN n.files = 1 THEN concat(d.dir, '/', regexp_extract(file_path, '[^/]*$')) ELSE regexp_extract(file_path, '[^/]*$') END AS id,
  CAST(greatest(1, loc) AS BIGINT) AS value, complexity FROM d JOIN n USING (scan_id, dir)""")
def _(t):
    """Sized boxes per file; a directory with one file is shown as that file under its full path."""
    facts = O.message_facts(F.col("message"))
    default = S.lookup(F.lower("severity"), {"critical": 20, "high": 15, "medium": 10, "low": 5}, 3)
    rows = t["v_rich_findings"].where(F.coalesce("file_path", F.lit("")) != "").select(
        "scan_id", "file_path", F.coalesce(facts["loc"], F.lit(50)).alias("loc"), F.coalesce(facts["complexity"], default).alias("complexity"))
    files = rows.groupBy("scan_id", "file_path").agg(F.sum("loc").alias("loc"), F.max("complexity").alias("complexity"))
    files = files.withColumn("dir", dirname(F.col("file_path"), "(root)"))
    sizes = files.groupBy("scan_id", "dir").agg(F.count(F.lit(1)).alias("files"))
    single, name = F.col("files") == 1, basename(F.col("file_path"))
    return files.join(sizes, ["scan_id", "dir"]).select(
        "scan_id", F.when(~single, F.col("dir")).alias("parent"),
        F.when(single, F.concat("dir", F.lit("/"), name)).otherwise(name).alias("id"),
        F.greatest(F.lit(1), F.col("loc")).cast("bigint").alias("value"), "complexity")


@query("findings_union", """SELECT finding_id, scan_id, severity, 'plain' AS origin FROM v_findings UNION ALL SELECT finding_id, scan_id, lower(severity), 'rich' FROM v_rich_findings""")
def _(t):
    plain = t["v_findings"].select("finding_id", "scan_id", "severity", F.lit("plain").alias("origin"))
    rich = t["v_rich_findings"].select("finding_id", "scan_id", F.lower("severity").alias("severity"), F.lit("rich").alias("origin"))
    return plain.unionByName(rich)


@query("module_union", f"""WITH {RANKED_SCANS} SELECT DISTINCT r.repo_id, m.module_id FROM v_module_results m JOIN ranked r USING (scan_id) WHERE r.scan_rank <= 2""")
def _(t):
    ranks = H.latest_scans(t["v_scans"], 2).select("repo_id", "scan_id", "scan_rank")
    rows = t["v_module_results"].join(ranks, "scan_id").select("repo_id", "module_id", "scan_rank")
    one, two = rows.where("scan_rank = 1").drop("scan_rank"), rows.where("scan_rank = 2").drop("scan_rank")
    return one.union(two).distinct()


@query("distinct_paths", "SELECT path, min(repo_id) AS repo_id FROM (SELECT regexp_replace(path, '/[0-9]+$', '') AS path, repo_id FROM v_repos) x GROUP BY path")
def _(t):
    rows = t["v_repos"].select(F.regexp_replace("path", "/[0-9]+$", "").alias("path"), "repo_id")
    return first_per_key(rows, ["path"], ["repo_id"])


@query("scan_status", """SELECT scan_id, count(*) AS modules, count(CASE WHEN score < 0 OR state = 'unavailable' THEN 1 END) AS errors,
  CASE WHEN count(*) > 0 AND count(CASE WHEN score < 0 OR state = 'unavailable' THEN 1 END) = count(*) THEN 'failed' ELSE 'completed' END AS status FROM v_named_results GROUP BY scan_id""")
def _(t):
    """A scan fails only when every module failed."""
    bad = count_if((F.col("score") < 0) | (F.col("state") == "unavailable"))
    rows = t["v_named_results"].groupBy("scan_id").agg(F.count(F.lit(1)).alias("modules"), bad.alias("errors"))
    return rows.withColumn("status", F.when(F.col("errors") == F.col("modules"), "failed").otherwise("completed"))


ADOPT_W = case("module_id", {k: f"@{v}@" for k, v in scoring.EVALUATION_WEIGHTS.items()}, "1.0").replace("'@", "").replace("@'", "")


@query("adoption_risk", f"""WITH w AS (SELECT scan_id, module_id, score, CAST({ADOPT_W} AS DOUBLE) * confidence AS w, {OKSQL} AS ok FROM v_named_results),
h AS (SELECT scan_id, coalesce({esum('CASE WHEN ok THEN score * w END')} / nullif({esum('CASE WHEN ok THEN w END')}, 0), 50) AS health,
  count(CASE WHEN ok AND module_id = 'git-health' AND score < 40 THEN 1 END) AS low_git FROM w GROUP BY scan_id),
m AS (SELECT scan_id, module_id, count(CASE WHEN severity = 'critical' AND (category = 'security' OR module_id = 'security') THEN 1 END) AS crit,
  count(CASE WHEN severity = 'High' AND (category = 'security' OR module_id = 'security') THEN 1 END) AS high,
  max(CASE WHEN module_id = 'dependencies' AND severity IN ('High', 'critical') THEN 1 ELSE 0 END) AS dep FROM v_rich_findings GROUP BY scan_id, module_id),
f AS (SELECT scan_id, CAST(sum(crit) AS BIGINT) AS crit, CAST(sum(high) AS BIGINT) AS high, CAST(sum(dep) AS BIGINT) AS dep FROM m GROUP BY scan_id),
r AS (SELECT h.scan_id, coalesce(crit, 0) AS critical_security, coalesce(high, 0) AS high_security, coalesce(dep, 0) AS dep, low_git,
  CAST(CASE WHEN coalesce(crit, 0) > 0 THEN 100 ELSE floor(least(100, greatest(0, 100 - health + coalesce(high, 0) * 3 + coalesce(dep, 0) * 5 + low_git * 8)) + 0.5) END AS INT) AS adoption_risk
  FROM h LEFT JOIN f USING (scan_id))
SELECT scan_id, critical_security, high_security, adoption_risk,
  concat_ws(',', CASE WHEN critical_security > 0 THEN 'critical-security' END, CASE WHEN critical_security = 0 AND high_security > 0 THEN 'high-security' END,
    CASE WHEN critical_security = 0 AND dep > 0 THEN 'outdated-dependencies' END, CASE WHEN critical_security = 0 AND low_git > 0 THEN 'low-git-health' END) AS reasons,
  CASE WHEN critical_security > 0 THEN 'avoid' WHEN adoption_risk < 30 THEN 'low-risk' WHEN adoption_risk < 60 THEN 'moderate-risk' WHEN adoption_risk < 80 THEN 'high-risk' ELSE 'avoid' END AS verdict FROM r""")
def _(t):
    findings = t["v_rich_findings"].withColumn("severity", F.lower("severity"))
    return scoring.adoption_risk(t["v_named_results"], findings, ["scan_id"])


@query("scan_export", f"""SELECT m.scan_id, m.module_id, coalesce(n, 0) AS findings, sc.overall_score, sc.overall_score >= 60 AS pass
FROM v_module_results m LEFT JOIN (SELECT scan_id, module_id, count(*) AS n FROM v_findings GROUP BY 1, 2) f USING (scan_id, module_id)
JOIN (SELECT scan_id, CAST(coalesce({half_up(esum("CASE WHEN state = 'completed' THEN score * confidence END") + " / nullif(" + esum("CASE WHEN state = 'completed' THEN confidence END") + ", 0)")}, 0) AS INT) AS overall_score FROM v_module_results GROUP BY scan_id) sc USING (scan_id)""")
def _(t):
    """What a scan exports, one row per module; see sources.results.export_documents for the JSON documents."""
    counts = t["v_findings"].groupBy("scan_id", "module_id").agg(F.count(F.lit(1)).alias("n"))
    scored = scoring.overall_score(t["v_module_results"], ["scan_id"])
    return t["v_module_results"].select("scan_id", "module_id").join(counts, ["scan_id", "module_id"], "left").join(scored, "scan_id").select(
        "scan_id", "module_id", F.coalesce("n", F.lit(0)).alias("findings"), "overall_score", (F.col("overall_score") >= 60).alias("pass"))
