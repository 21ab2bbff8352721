"""Queries that compare reviewers and repository lists."""

from __future__ import annotations

from pyspark.sql import functions as F


from repohealth.functions.scalars import normalise_category, normalise_file, overlap_ratio, repo_ref, word_set
from repohealth.operators import compare as CM
from repohealth.operators import registrations as RG
from repohealth.operators.history import completed
from repohealth.operators.ordered import latest_per_key
from repohealth.plans.registry import query

WORDS = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '\\W+'), lambda w: length(w) > 2))"
BASE = lambda c: f"regexp_extract({c}, '[^/]*$')"


def _profile_sql(view: str, p: str) -> str:
    return f"""SELECT repo_id, lower(coalesce(file_path, '')) AS {p}_path, line AS {p}_line, message AS {p}_message, lower(severity) AS {p}_severity, count(*) AS {p}_n FROM {view} GROUP BY 1, 2, 3, 4, 5"""


SIM_SQL = f"""WITH s AS ({_profile_sql('v_scan_side', 's')}), a AS ({_profile_sql('v_audit_side', 'a')}),
j AS (SELECT s.repo_id, s.* EXCLUDE (repo_id), a.* EXCLUDE (repo_id), CASE WHEN s_path = a_path THEN CAST(0.5 AS DOUBLE) WHEN ends_with(s_path, a_path) OR ends_with(a_path, s_path) THEN CAST(0.35 AS DOUBLE)
  WHEN {BASE('s_path')} = {BASE('a_path')} THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS place FROM s JOIN a ON s.repo_id = a.repo_id AND s_path <> '' AND a_path <> ''),
w AS (SELECT *, {WORDS('s_message')} AS sw, {WORDS('a_message')} AS aw FROM j WHERE place > 0),
sim AS (SELECT *, least(place + CASE WHEN s_line IS NULL OR a_line IS NULL THEN CAST(0 AS DOUBLE) WHEN s_line = a_line THEN CAST(0.15 AS DOUBLE) WHEN abs(s_line - a_line) <= 5 THEN CAST(0.1 AS DOUBLE) WHEN abs(s_line - a_line) <= 20 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN least(len(sw), len(aw)) > 0 THEN CAST(len(list_intersect(sw, aw)) AS DOUBLE) / least(len(sw), len(aw)) ELSE CAST(0 AS DOUBLE) END * CAST(0.3 AS DOUBLE)
  + CASE WHEN s_severity = a_severity THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, CAST(1 AS DOUBLE)) AS similarity FROM w)
SELECT repo_id, s_path, s_line, s_message, s_severity, s_n, a_path, a_line, a_message, a_severity, a_n, round(similarity, 6) AS similarity FROM sim WHERE similarity >= CAST(0.4 AS DOUBLE)"""


@query("similarity", SIM_SQL)
def _(t):
    rows = CM.similar_pairs(t["v_scan_side"], t["v_audit_side"])
    return rows.drop("s_id", "a_id").withColumn("similarity", F.round("similarity", 6))


def _id_sql(p: str) -> str:
    return f"md5(concat_ws(chr(31), CAST(repo_id AS VARCHAR), {p}_path, coalesce(CAST({p}_line AS VARCHAR), '-'), {p}_message, {p}_severity))"


# One pair of every repository at a time, in the order of the matching; ids are dense numbers while it runs.
GREEDY_SQL = SIM_SQL.replace("WITH s AS", "WITH RECURSIVE s AS", 1).replace("SELECT repo_id, s_path, s_line, s_message", ", pr AS (SELECT repo_id, s_path, s_line, s_message", 1) + f"""),
pi AS (SELECT *, {_id_sql('s')} AS s_id, {_id_sql('a')} AS a_id FROM pr), pk AS (SELECT *, CAST('0x' || substr(md5(s_id || a_id), 1, 15) AS BIGINT) AS tie FROM pi),
po AS (SELECT *, dense_rank() OVER (ORDER BY s_id) AS si, dense_rank() OVER (ORDER BY a_id) AS ai, row_number() OVER (PARTITION BY repo_id ORDER BY similarity DESC, tie, s_id, a_id) AS rk FROM pk),
g AS (SELECT repo_id, rk, si, ai, s_n AS sn, a_n AS an, min(rk) OVER (PARTITION BY repo_id) AS top FROM po
  UNION ALL SELECT repo_id, rk, si, ai, sn, an, min(rk) OVER (PARTITION BY repo_id) AS top FROM (
    SELECT g.repo_id, g.rk, g.si, g.ai, g.sn - CASE WHEN g.si = t.si THEN t.m ELSE 0 END AS sn, g.an - CASE WHEN g.ai = t.ai THEN t.m ELSE 0 END AS an
    FROM g JOIN (SELECT repo_id, si, ai, least(sn, an) AS m FROM g WHERE rk = top) t ON t.repo_id = g.repo_id) x WHERE sn > 0 AND an > 0),
mt AS (SELECT po.repo_id, po.s_id, po.a_id, po.similarity, least(g.sn, g.an) AS matched FROM g JOIN po ON po.repo_id = g.repo_id AND po.rk = g.rk WHERE g.rk = g.top)"""


@query("greedy_match", f"{GREEDY_SQL} SELECT * FROM mt")
def _(t):
    return CM.match_findings(t["v_scan_side"], t["v_audit_side"])


def _remainder_sql(p: str, name: str) -> str:
    return f"""SELECT '{name}' AS side, x.repo_id, {', '.join(f'{p}_{c} AS {c}' for c in CM.FIELDS)}, CAST(coalesce(u, 0) AS BIGINT) AS matched, CAST({p}_n - coalesce(u, 0) AS BIGINT) AS only_here
FROM (SELECT *, {_id_sql(p)} AS k FROM {p}) x LEFT JOIN (SELECT {p}_id AS k, sum(matched) AS u FROM mt GROUP BY 1) y USING (k)"""


@query("match_remainders", f"{GREEDY_SQL} {_remainder_sql('s', 'scan')} UNION ALL {_remainder_sql('a', 'audit')}")
def _(t):
    return CM.match_remainders(t["v_scan_side"], t["v_audit_side"])


KEYS_SQL = """k AS (SELECT DISTINCT provider, module_id, concat(CASE WHEN coalesce(file, '') = '' THEN '__no_file__' ELSE regexp_replace(regexp_replace(lower(trim(file)), '^\\./', ''), '/+$', '') END, '::', regexp_replace(lower(trim(category)), '[\\s_-]+', '-', 'g')) AS key FROM v_audit_findings)"""
AGREE_SQL = f"""{KEYS_SQL}, g AS (SELECT module_id, key, bool_or(provider = 'A') AS a, bool_or(provider = 'N') AS b FROM k WHERE provider IN ('A', 'N') GROUP BY 1, 2),
agr AS (SELECT module_id, count(CASE WHEN a AND b THEN 1 END) AS agreed, count(CASE WHEN a AND NOT b THEN 1 END) AS only_first, count(CASE WHEN b AND NOT a THEN 1 END) AS only_second, count(*) AS union_size FROM g GROUP BY 1)"""


@query("agreement", f"WITH {AGREE_SQL} SELECT *, CAST(floor(CAST(agreed AS DOUBLE) / union_size * 100 + 0.5) AS INT) AS agreement FROM agr")
def _(t):
    return CM.agreement(t["v_audit_findings"], "A", "N")


@query("agreement_overall", f"WITH {AGREE_SQL} SELECT CAST(sum(agreed) AS BIGINT) AS agreed, CAST(sum(union_size) AS BIGINT) AS union_size, CAST(coalesce(floor(CAST(sum(agreed) AS DOUBLE) / nullif(CAST(sum(union_size) AS DOUBLE), 0) * 100 + 0.5), 100) AS INT) AS agreement FROM agr")
def _(t):
    total = CM.agreement(t["v_audit_findings"], "A", "N").agg(F.sum("agreed").alias("agreed"), F.sum("union_size").alias("union_size"))
    return total.withColumn("agreement", CM.agreement_score(F.col("agreed"), F.col("union_size")))


def _keys(t, provider):
    return CM.match_keys(t["v_audit_findings"].where(F.col("provider") == provider)).select("module_id", "key")


@query("agree_intersect", f"WITH {KEYS_SQL} SELECT module_id, key FROM k WHERE provider = 'A' INTERSECT SELECT module_id, key FROM k WHERE provider = 'N'")
def _(t):
    return _keys(t, "A").intersect(_keys(t, "N"))


@query("agree_except", f"WITH {KEYS_SQL} SELECT module_id, key, 'A' AS provider FROM (SELECT module_id, key FROM k WHERE provider = 'A' EXCEPT SELECT module_id, key FROM k WHERE provider = 'N') x UNION ALL SELECT module_id, key, 'N' FROM (SELECT module_id, key FROM k WHERE provider = 'N' EXCEPT SELECT module_id, key FROM k WHERE provider = 'A') y")
def _(t):
    a, n = _keys(t, "A"), _keys(t, "N")
    return a.subtract(n).withColumn("provider", F.lit("A")).unionByName(n.subtract(a).withColumn("provider", F.lit("N")))


@query("scan_vs_audit", """WITH s AS (SELECT repo_id, lower(file_path) AS file, count(*) AS n FROM v_scan_side GROUP BY 1, 2), a AS (SELECT repo_id, lower(file_path) AS file, count(*) AS n FROM v_audit_side GROUP BY 1, 2)
SELECT coalesce(s.repo_id, a.repo_id) AS repo_id, coalesce(s.file, a.file) AS file, s.n IS NOT NULL AS in_scan, a.n IS NOT NULL AS in_audit, coalesce(s.n, 0) AS scan_findings, coalesce(a.n, 0) AS audit_findings
FROM s FULL OUTER JOIN a ON s.repo_id = a.repo_id AND s.file = a.file""")
def _(t):
    file = F.lower("file_path").alias("file")
    return CM.presence(t["v_scan_side"].select("repo_id", file), t["v_audit_side"].select("repo_id", file), ["repo_id", "file"])


@query("latest_audit", """SELECT repo_id, provider, audit_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, provider ORDER BY created_at DESC, audit_id DESC) AS rn FROM v_audits WHERE status = 'completed') x WHERE rn = 1""")
def _(t):
    return latest_per_key(completed(t["v_audits"]), ["repo_id", "provider"], ["created_at", "audit_id"]).select("repo_id", "provider", "audit_id")


@query("enough_providers", """SELECT repo_id, count(DISTINCT provider) AS providers, count(DISTINCT provider) >= 2 AS comparable FROM v_audits WHERE status = 'completed' GROUP BY repo_id""")
def _(t):
    """Agreement needs two providers; repositories with fewer are marked."""
    rows = completed(t["v_audits"]).groupBy("repo_id").agg(F.countDistinct("provider").alias("providers"))
    return rows.withColumn("comparable", F.col("providers") >= 2)


@query("normalise_keys", """SELECT provider, module_id, file, category, regexp_replace(regexp_replace(lower(trim(file)), '^\\./', ''), '/+$', '') AS file_key, regexp_replace(lower(trim(category)), '[\\s_-]+', '-', 'g') AS category_key FROM v_audit_findings""")
def _(t):
    return t["v_audit_findings"].select("provider", "module_id", "file", "category", normalise_file(F.col("file")).alias("file_key"),
                                        normalise_category(F.col("category")).alias("category_key"))


@query("word_overlap", f"""WITH w AS (SELECT item_id, {WORDS('text')} AS ws FROM benchmark), d AS (SELECT doc_id, doc_id % 40 AS item_id, {WORDS('text')} AS wd FROM documents)
SELECT doc_id, item_id, CAST(len(list_intersect(ws, wd)) AS INT) AS shared, round(CASE WHEN least(len(ws), len(wd)) > 0 THEN CAST(len(list_intersect(ws, wd)) AS DOUBLE) / least(len(ws), len(wd)) ELSE 0 END, 9) AS ratio FROM d JOIN w USING (item_id)""")
def _(t):
    items = t["benchmark"].select("item_id", word_set(F.col("text")).alias("ws"))
    docs = t["documents"].select("doc_id", (F.col("doc_id") % 40).alias("item_id"), word_set(F.col("text")).alias("wd"))
    return docs.join(items, "item_id").select(
        "doc_id", "item_id", F.size(F.array_intersect("ws", "wd")).alias("shared"),
        F.round(overlap_ratio(F.col("ws"), F.col("wd")), 9).alias("ratio"))


@query("discover", "SELECT f.repo_id, f.path, r.path IS NULL AS is_new FROM v_repos f LEFT JOIN (SELECT DISTINCT path FROM v_repos WHERE repo_id % 3 <> 0) r ON r.path = f.path")
def _(t):
    return RG.discover(t["v_repos"].select("repo_id", "path"), t["v_repos"].where("repo_id % 3 <> 0"))


CAND_SQL = "cand AS (SELECT path, min(name) AS name FROM (SELECT regexp_replace(path, '[0-9]+$', CAST(repo_id % 700 AS VARCHAR)) AS path, name FROM v_repos) x GROUP BY path)"


@query("register_new", f"WITH {CAND_SQL} SELECT path, name FROM cand WHERE NOT EXISTS (SELECT 1 FROM v_repos r WHERE r.path = cand.path)")
def _(t):
    repos = t["v_repos"]
    cands = repos.select(F.concat(F.regexp_extract("path", "^(.*/)[^/]*$", 1), (F.col("repo_id") % 700).cast("string")).alias("path"), "name", F.col("repo_id").alias("parent_id"))
    return RG.register_new(repos, cands).select("path", "name")


@query("purge", """SELECT 'scans' AS tbl, scan_id, count(*) AS n FROM v_scans WHERE repo_id NOT IN (SELECT repo_id FROM v_repos WHERE NOT active) GROUP BY scan_id
UNION ALL SELECT 'findings', scan_id, count(*) FROM v_findings WHERE scan_id NOT IN (SELECT scan_id FROM v_scans WHERE repo_id IN (SELECT repo_id FROM v_repos WHERE NOT active)) GROUP BY scan_id""")
def _(t):
    left = RG.purge({"scans": t["v_scans"], "findings": t["v_findings"]}, t["v_repos"].where(~F.col("active")))
    counts = [df.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "scan_id", "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1])


@query("path_like", "SELECT repo_id, path FROM v_repos WHERE path LIKE '%machinery-1%'")
def _(t):
    return t["v_repos"].where(F.col("path").like("%machinery-1%")).select("repo_id", "path")


@query("skip_scanned", """SELECT o_custkey AS repo_id, o_orderkey AS sha FROM orders o WHERE NOT EXISTS (SELECT 1 FROM v_scans s WHERE s.status = 'completed' AND s.repo_id = o.o_custkey AND s.scan_id = o.o_orderkey)""")
def _(t):
    asked = t["orders"].select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("sha"))
    done = completed(t["v_scans"]).select("repo_id", F.col("scan_id").alias("sha"))
    return RG.skip_scanned(asked, done, ["repo_id", "sha"])


@query("config_fallback", """SELECT r.repo_id, coalesce(c.budget, 100000) AS budget, c.budget IS NOT NULL AS is_own FROM v_repos r LEFT JOIN (SELECT repo_id, CAST(json_extract_string(doc, '$.aiTokenBudget') AS BIGINT) AS budget FROM v_config_docs WHERE repo_id % 4 = 0) c USING (repo_id)""")
def _(t):
    own = t["v_config_docs"].where("repo_id % 4 = 0").select("repo_id", F.get_json_object("doc", "$.aiTokenBudget").cast("bigint").alias("budget"))
    everywhere = t["v_config_docs"].groupBy().agg(F.lit(None).cast("bigint").alias("repo_id"), F.lit(100000).cast("bigint").alias("budget"))
    return RG.effective_config(t["v_repos"], own.unionByName(everywhere))


@query("repo_ref", """SELECT c_custkey AS repo_id, ref, CASE WHEN regexp_matches(clean, '^(https?://)?github\\.com/[^/]+/[^/]+$') THEN regexp_extract(clean, '^(?:https?://)?github\\.com/([^/]+/[^/]+)$', 1)
  WHEN regexp_matches(clean, '^[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+$') THEN clean END AS repo FROM (SELECT c_custkey, ref, regexp_replace(regexp_replace(trim(ref), '\\.git$', ''), '/$', '') AS clean FROM (SELECT c_custkey,
  CASE c_custkey % 5 WHEN 0 THEN concat('https://github.com/org/', lower(c_mktsegment), '.git') WHEN 1 THEN concat('github.com/org/r', CAST(c_custkey AS VARCHAR), '/') WHEN 2 THEN concat(' team/', lower(c_mktsegment)) WHEN 3 THEN c_name ELSE 'https://example.com/a/b' END AS ref FROM customer) x) y""")
def _(t):
    seg, key = F.lower("c_mktsegment"), F.col("c_custkey")
    ref = (
        F.when(key % 5 == 0, F.concat(F.lit("https://github.com/org/"), seg, F.lit(".git")))
        .when(key % 5 == 1, F.concat(F.lit("github.com/org/r"), key.cast("string"), F.lit("/")))
        .when(key % 5 == 2, F.concat(F.lit(" team/"), seg)).when(key % 5 == 3, F.col("c_name")).otherwise("https://example.com/a/b")
    )
    return t["customer"].select(key.alias("repo_id"), ref.alias("ref")).withColumn("repo", repo_ref(F.col("ref")))
