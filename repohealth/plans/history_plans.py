"""Queries over scan history."""

from __future__ import annotations

from pyspark.sql import functions as F

from repohealth.functions.scalars import count_if
from repohealth.functions.severity import severity_rank
from repohealth.operators import history as H
from repohealth.operators.ordered import latest_per_key, top_per_key
from repohealth.operators.scoring import PROFILE_WEIGHTS, overall_score, profile_weight
from repohealth.plans.registry import query
from repohealth.plans.sqltext import RANKED_SCANS, SEV_RANK, esum, half_up, ranked_findings
from repohealth.session import cut_lineage

OK = "((state IS NULL OR state = 'completed') AND score >= 0)"


def score_sql(weight: str, source: str, keys: str) -> str:
    """Oracle text of the weighted overall score."""
    w = f"({weight} * confidence)"
    top, total = esum(f"CASE WHEN {OK} THEN score * {w} END"), esum(f"CASE WHEN {OK} THEN {w} END")
    return f"""SELECT {keys}, CAST(coalesce({half_up(f'{top} / nullif({total}, 0)')}, 0) AS INT) AS overall_score
      FROM {source} GROUP BY {keys}"""


# Fixed rule of the fixture: which profile a repository is scored under.
REPO_PROFILES = ("web-app", "library", "cli")


def _repo_profile_weight():
    out = None
    for i, profile in enumerate(REPO_PROFILES):
        hit, weight = F.col("repo_id") % 3 == i, profile_weight(F.col("module_id"), profile)
        out = F.when(hit, weight) if out is None else out.when(hit, weight)
    return out




def _weights_sql(profile: str) -> str:
    arms = " ".join(f"WHEN '{module}' THEN {weight}" for module, weight in PROFILE_WEIGHTS[profile].items())
    return f"CAST(CASE module_id {arms} ELSE 1.0 END AS DOUBLE)"


REPO_WEIGHT_SQL = f"CASE repo_id % 3 {' '.join(f'WHEN {i} THEN {_weights_sql(p)}' for i, p in enumerate(REPO_PROFILES))} END"

SCORED = f"""WITH joined AS (SELECT s.repo_id, s.created_at, m.* FROM v_named_results m JOIN v_scans s USING (scan_id)),
scored AS ({score_sql(REPO_WEIGHT_SQL, 'joined', 'repo_id, scan_id, created_at')})"""


def _scored(t):
    joined = t["v_named_results"].join(t["v_scans"].select("scan_id", "repo_id", "created_at"), "scan_id")
    return overall_score(joined, ["repo_id", "scan_id", "created_at"], _repo_profile_weight())


@query("overall_score", f"{score_sql('CAST(1.0 AS DOUBLE)', 'v_module_results', 'scan_id')}")
def _(t):
    return overall_score(t["v_module_results"], ["scan_id"])


@query("overall_score_profile", f"{SCORED} SELECT repo_id, scan_id, overall_score FROM scored")
def _(t):
    return _scored(t).drop("created_at")


@query("scored_trend", f"""{SCORED}
SELECT repo_id, scan_id, overall_score, lag(overall_score) OVER w AS previous_score,
  CASE WHEN overall_score > lag(overall_score) OVER w THEN 'improving' WHEN overall_score < lag(overall_score) OVER w THEN 'declining' ELSE 'stable' END AS trend
FROM scored WINDOW w AS (PARTITION BY repo_id ORDER BY created_at, scan_id)""")
def _(t):
    deltas = H.score_deltas(_scored(t))
    return deltas.select(
        "repo_id", "scan_id", "overall_score", "previous_score",
        H.trend_word(F.col("overall_score"), F.col("previous_score")).alias("trend"),
    )


@query("fast_score", f"""{score_sql('CAST(1.0 AS DOUBLE)', "(SELECT * FROM v_named_results WHERE module_id <> 'git-health' AND score >= 0) x", 'scan_id')}""")
def _(t):
    """Score after a commit: only the quick static modules, failed ones left out."""
    quick = t["v_named_results"].where((F.col("module_id") != "git-health") & (F.col("score") >= 0))
    return overall_score(quick, ["scan_id"])


@query("latest_n", f"WITH {RANKED_SCANS} SELECT repo_id, scan_id, scan_rank FROM ranked WHERE scan_rank <= 3")
def _(t):
    return H.latest_scans(t["v_scans"], 3).select("repo_id", "scan_id", "scan_rank")


@query("latest_scan", """WITH last AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, scan_id DESC) AS rn FROM v_scans)
SELECT r.repo_id, r.name, l.scan_id, l.status, l.overall_score, coalesce(l.mode, 'maintaining') AS mode
FROM v_repos r LEFT JOIN last l ON l.repo_id = r.repo_id AND l.rn = 1""")
def _(t):
    last = latest_per_key(t["v_scans"], ["repo_id"], H.SCAN_ORDER)
    return t["v_repos"].select("repo_id", "name").join(last, "repo_id", "left").select(
        "repo_id", "name", "scan_id", "status", "overall_score", F.coalesce("mode", F.lit("maintaining")).alias("mode")
    )


def _diff(t, kind):
    ranked = H.ranked_findings(t["v_scans"], t["v_findings"], 2)
    base, head = ranked.where("scan_rank = 2"), ranked.where("scan_rank = 1")
    return H.diff_findings(base, head, kind).select("repo_id", "scan_id", "finding_id", "fingerprint", "severity")


def _diff_sql(side: int, other: int, word: str) -> str:
    return f"""WITH {ranked_findings('v_findings', 2)}
SELECT repo_id, scan_id, finding_id, fingerprint, severity FROM rf a WHERE scan_rank = {side} AND
  {word} (SELECT 1 FROM rf b WHERE b.scan_rank = {other} AND b.repo_id = a.repo_id AND b.fingerprint = a.fingerprint)"""


@query("diff_new", _diff_sql(1, 2, "NOT EXISTS"))
def _(t):
    return _diff(t, "new")


@query("diff_fixed", _diff_sql(2, 1, "NOT EXISTS"))
def _(t):
    return _diff(t, "fixed")


@query("diff_unchanged", _diff_sql(1, 2, "EXISTS"))
def _(t):
    return _diff(t, "unchanged")


def _deltas(t):
    ranks = H.latest_scans(t["v_scans"], 2).select("repo_id", "scan_id", "scan_rank")
    rows = t["v_named_results"].join(ranks, "scan_id")
    return H.module_deltas(rows.where("scan_rank = 2"), rows.where("scan_rank = 1"))


DELTAS_SQL = f"""WITH {RANKED_SCANS}, m AS (SELECT r.repo_id, r.scan_rank, x.* FROM v_named_results x JOIN ranked r USING (scan_id) WHERE scan_rank <= 2),
d AS (SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.module_id, b.module_id) AS module_id,
  b.score AS score_before, a.score AS score_after, CASE WHEN a.scan_id IS NOT NULL AND b.scan_id IS NOT NULL THEN a.score - b.score END AS delta,
  b.state AS state_before, a.state AS state_after,
  coalesce(b.state = 'completed' AND a.state = 'completed' AND b.score > a.score, false)
    OR coalesce(b.state IS DISTINCT FROM 'not_applicable' AND a.state = 'unavailable', false) AS regression
FROM (SELECT * FROM m WHERE scan_rank = 1) a FULL OUTER JOIN (SELECT * FROM m WHERE scan_rank = 2) b
  ON a.repo_id = b.repo_id AND a.module_id = b.module_id)"""


@query("module_deltas", f"{DELTAS_SQL} SELECT * FROM d")
def _(t):
    return _deltas(t)


@query("regressions", f"{DELTAS_SQL} SELECT * FROM d WHERE regression OR delta < 0")
def _(t):
    return H.regressions(_deltas(t))


@query("reconcile", f"""WITH {ranked_findings('v_rich_findings', 3)},
n AS (SELECT repo_id, count(*) AS n FROM ranked WHERE scan_rank <= 3 GROUP BY repo_id)
SELECT a.repo_id, a.finding_id, a.fingerprint,
  CASE WHEN n.n < 2 THEN 'new'
    WHEN n.n >= 3 AND ((EXISTS (SELECT 1 FROM rf b WHERE b.scan_rank = 3 AND b.repo_id = a.repo_id AND b.fingerprint = a.fingerprint)
        AND NOT EXISTS (SELECT 1 FROM rf b WHERE b.scan_rank = 2 AND b.repo_id = a.repo_id AND b.fingerprint = a.fingerprint))
      OR EXISTS (SELECT 1 FROM rf b WHERE b.scan_rank = 2 AND b.status = 'fixed' AND b.repo_id = a.repo_id AND b.fingerprint = a.fingerprint)) THEN 'regressed'
    WHEN EXISTS (SELECT 1 FROM rf b WHERE b.scan_rank = 2 AND b.repo_id = a.repo_id AND b.fingerprint = a.fingerprint) THEN 'recurring'
    ELSE 'new' END AS status
FROM rf a JOIN n USING (repo_id) WHERE a.scan_rank = 1""")
def _(t):
    # read twice, so the findings meet their scans once
    ranked = cut_lineage(H.ranked_findings(t["v_scans"], t["v_rich_findings"], 3).select("repo_id", "finding_id", "fingerprint", "scan_rank", "status"))
    counts = H.latest_scans(t["v_scans"], 3).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    return H.reconcile(ranked, counts).select("repo_id", "finding_id", "fingerprint", "status")


@query("tombstones", f"""WITH {ranked_findings('v_rich_findings', 2)}
SELECT a.repo_id, h.scan_id, a.finding_id, a.fingerprint, a.module_id, 'fixed' AS status FROM rf a
JOIN (SELECT repo_id, arg_max(scan_id, (created_at, scan_id)) AS scan_id FROM v_scans WHERE status = 'completed' GROUP BY repo_id) h USING (repo_id)
WHERE a.scan_rank = 2 AND a.status <> 'fixed' AND NOT EXISTS
  (SELECT 1 FROM rf b WHERE b.scan_rank = 1 AND b.repo_id = a.repo_id AND b.fingerprint = a.fingerprint)""")
def _(t):
    ranked = cut_lineage(H.ranked_findings(t["v_scans"], t["v_rich_findings"], 2).select(
        "repo_id", "scan_id", "finding_id", "fingerprint", "module_id", "scan_rank", "status"))
    return H.tombstones(ranked, H.latest_scans(t["v_scans"], 1)).select("repo_id", "scan_id", "finding_id", "fingerprint", "module_id", "status")


@query("score_delta", """SELECT repo_id, scan_id, overall_score, lag(overall_score) OVER w AS previous_score,
  overall_score - lag(overall_score) OVER w AS delta FROM v_scans WINDOW w AS (PARTITION BY repo_id ORDER BY created_at, scan_id)""")
def _(t):
    return H.score_deltas(t["v_scans"]).select("repo_id", "scan_id", "overall_score", "previous_score", "delta")


@query("module_delta_lag", """WITH x AS (SELECT s.repo_id, m.scan_id, m.module_id, m.score, lag(m.score) OVER (PARTITION BY s.repo_id, m.module_id ORDER BY s.created_at, m.scan_id) AS previous_score
  FROM v_module_results m JOIN v_scans s USING (scan_id))
SELECT *, score - previous_score AS diff FROM x WHERE score <> previous_score""")
def _(t):
    rows = t["v_module_results"].join(t["v_scans"].select("scan_id", "repo_id", "created_at"), "scan_id")
    return H.module_score_changes(rows).select("repo_id", "scan_id", "module_id", "score", "previous_score", "diff")


@query("trend", f"""WITH {RANKED_SCANS}, p AS (SELECT repo_id, max(CASE WHEN scan_rank = 1 THEN overall_score END) AS latest,
  max(CASE WHEN scan_rank = 2 THEN overall_score END) AS previous FROM ranked WHERE scan_rank <= 2 GROUP BY repo_id)
SELECT *, CASE WHEN latest > previous THEN 'improving' WHEN latest < previous THEN 'declining' ELSE 'stable' END AS trend FROM p""")
def _(t):
    return H.trends(t["v_scans"])


@query("snapshot_delta", """SELECT repo_id, snapshot_id, overall,
  coalesce(floor((overall - lag(overall) OVER (PARTITION BY repo_id ORDER BY ts, snapshot_id)) * 10 + 0.5) / 10, 0) AS delta FROM v_snapshots""")
def _(t):
    return H.snapshot_deltas(t["v_snapshots"]).select("repo_id", "snapshot_id", "overall", "delta")


@query("health_trend", """SELECT repo_id, snapshot_id, overall, CAST(rn AS INT) AS back FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, snapshot_id DESC) AS rn FROM v_snapshots) x WHERE rn <= 20""")
def _(t):
    newest = [F.col("ts").desc(), F.col("snapshot_id").desc()]
    return top_per_key(t["v_snapshots"], ["repo_id"], newest, 20, rank="back").select("repo_id", "snapshot_id", "overall", "back")


@query("status_counts", """SELECT f.scan_id, s.repo_id, count(CASE WHEN f.status = 'new' THEN 1 END) AS "new", count(CASE WHEN f.status = 'recurring' THEN 1 END) AS recurring,
  count(CASE WHEN f.status = 'fixed' THEN 1 END) AS fixed, count(CASE WHEN f.status = 'regressed' THEN 1 END) AS regressed
FROM v_rich_findings f JOIN v_scans s USING (scan_id) GROUP BY f.scan_id, s.repo_id""")
def _(t):
    counts = t["v_rich_findings"].groupBy("scan_id").agg(
        *[count_if(F.col("status") == s).alias(s) for s in ("new", "recurring", "fixed", "regressed")]
    )
    return counts.join(t["v_scans"].select("scan_id", "repo_id"), "scan_id")


@query("score_matrix", """SELECT scan_id, max(CASE WHEN module_id = 'mod0' THEN score END) AS mod0, max(CASE WHEN module_id = 'mod1' THEN score END) AS mod1,
  max(CASE WHEN module_id = 'mod2' THEN score END) AS mod2, max(CASE WHEN module_id = 'mod3' THEN score END) AS mod3 FROM v_module_results GROUP BY scan_id""")
def _(t):
    return t["v_module_results"].groupBy("scan_id").pivot("module_id", ["mod0", "mod1", "mod2", "mod3"]).agg(F.max("score"))


@query("score_stats", f"""SELECT repo_id, count(overall_score) AS scans, {half_up('CAST(sum(overall_score) AS DOUBLE) / count(overall_score)')} AS mean,
  max(overall_score) AS best, min(overall_score) AS worst FROM v_scans WHERE status = 'completed' AND overall_score IS NOT NULL GROUP BY repo_id""")
def _(t):
    rows = H.completed(t["v_scans"]).where(F.col("overall_score").isNotNull())
    return rows.groupBy("repo_id").agg(
        F.count("overall_score").alias("scans"),
        F.floor(F.sum("overall_score").cast("double") / F.count("overall_score") + 0.5).alias("mean"),
        F.max("overall_score").alias("best"), F.min("overall_score").alias("worst"),
    )


@query("highlights", """WITH ls AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, scan_id DESC) AS rn FROM v_scans WHERE status = 'completed'),
newest AS (SELECT l.repo_id, x.module_id, x.score FROM ls l JOIN v_module_results x USING (scan_id) WHERE l.rn = 1),
m AS (SELECT module_id, max(score) AS hi, min(score) AS lo, count(*) AS n FROM newest GROUP BY module_id)
SELECT l.repo_id, l.module_id, l.score, CASE WHEN l.score = m.hi THEN 'best' ELSE 'worst' END AS highlight
FROM newest l JOIN m USING (module_id) WHERE m.n >= 2 AND m.hi <> m.lo AND (l.score = m.hi OR l.score = m.lo)""")
def _(t):
    last = latest_per_key(H.completed(t["v_scans"]), ["repo_id"], H.SCAN_ORDER).select("repo_id", "scan_id")
    rows = t["v_module_results"].select("scan_id", "module_id", "score").join(last, "scan_id")
    span = rows.groupBy("module_id").agg(F.max("score").alias("hi"), F.min("score").alias("lo"), F.count(F.lit(1)).alias("n"))
    marked = rows.join(span, "module_id").where("n >= 2 AND hi <> lo AND (score = hi OR score = lo)")
    return marked.select("repo_id", "module_id", "score", F.when(F.col("score") == F.col("hi"), "best").otherwise("worst").alias("highlight"))


@query("report_history", """SELECT repo_id, scan_id, status, overall_score, CAST(rn AS INT) AS back FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, scan_id DESC) AS rn FROM v_scans) x WHERE rn <= 10""")
def _(t):
    newest = [F.col(c).desc() for c in H.SCAN_ORDER]
    return top_per_key(t["v_scans"], ["repo_id"], newest, 10, rank="back").select("repo_id", "scan_id", "status", "overall_score", "back")


@query("report_modules", f"""WITH {RANKED_SCANS}, m AS (SELECT r.repo_id, r.scan_rank, x.module_id, x.score, x.confidence, x.state FROM v_named_results x JOIN ranked r USING (scan_id) WHERE scan_rank <= 2),
f AS (SELECT r.repo_id, x.module_id, count(*) AS n, min({SEV_RANK}) AS worst FROM v_rich_findings x JOIN ranked r USING (scan_id) WHERE scan_rank = 1 GROUP BY 1, 2)
SELECT a.repo_id, a.module_id, a.score, a.confidence, coalesce(f.n, 0) AS findings, f.worst AS worst_severity_rank,
  CASE WHEN b.score IS NULL THEN 'stable' WHEN a.score > b.score THEN 'improving' WHEN a.score < b.score THEN 'declining' ELSE 'stable' END AS arrow
FROM (SELECT * FROM m WHERE scan_rank = 1) a LEFT JOIN (SELECT * FROM m WHERE scan_rank = 2) b USING (repo_id, module_id) LEFT JOIN f USING (repo_id, module_id)""")
def _(t):
    ranks = H.latest_scans(t["v_scans"], 2).select("repo_id", "scan_id", "scan_rank")
    rows = t["v_named_results"].join(ranks, "scan_id")
    keys = ["repo_id", "module_id"]
    before = rows.where("scan_rank = 2").select(*keys, F.col("score").alias("_before"))
    found = t["v_rich_findings"].join(ranks.where("scan_rank = 1"), "scan_id").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(severity_rank(F.col("severity"))).alias("worst_severity_rank")
    )
    table = rows.where("scan_rank = 1").join(before, keys, "left").join(found, keys, "left")
    return table.select(
        *keys, "score", "confidence", F.coalesce("_n", F.lit(0)).alias("findings"), "worst_severity_rank",
        H.trend_word(F.col("score"), F.col("_before")).alias("arrow"),
    )
