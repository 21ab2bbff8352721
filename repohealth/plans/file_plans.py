"""Queries over files, lines and commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from repohealth.functions import paths
from repohealth.functions.scalars import clamp, count_if, half_up
from repohealth.operators.ordered import percent_rank_over, top_per_key
from repohealth.operators.rules import decision_count, external_silos
from repohealth.plans.registry import query
from repohealth.plans.rule_plans import SILO_SQL, DECISION_SQL, TODO_SQL, _todos
from repohealth.plans.sqltext import q
from repohealth.plans.sqltext import half_up as half_up_sql
from repohealth.session import cut_lineage
from repohealth.sources import commits as C
from repohealth.sources import files as FS

SKIP_SQL = f"""len(list_filter(string_split(path, '/')[1:-2], lambda d: d IN ({', '.join(map(q, FS.SKIP_DIRS))}) OR starts_with(d, '.'))) > 0"""
EXT_SQL = "lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1))"
NAME_SQL = "regexp_extract(path, '[^/]*$')"


@query("files_filter", f"""SELECT repo_id, path FROM v_code_files WHERE NOT ({SKIP_SQL}) AND {NAME_SQL} NOT IN ({', '.join(map(q, FS.LOCK_FILES))}) AND {EXT_SQL} IN ({', '.join(map(q, FS.SOURCE_EXTENSIONS))})""")
def _(t):
    return t["v_code_files"].where(FS.scannable(F.col("path"))).select("repo_id", "path")


@query("lines", "SELECT repo_id, path, CAST(i AS INT) AS line_no, l[i] AS text FROM (SELECT repo_id, path, string_split(content, chr(10)) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM v_files) x")
def _(t):
    return FS.explode_lines(t["v_files"])


@query("line_count", "SELECT repo_id, path, CAST(CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END AS INT) AS lines, CAST(len(string_split(content, chr(10))) AS INT) AS pieces FROM v_files")
def _(t):
    c = F.col("content")
    return t["v_files"].select("repo_id", "path", FS.line_count(c).alias("lines"), FS.split_count(c).alias("pieces"))


@query("binary_sniff", "SELECT page_id, contains(substring(html, 1, 8192), chr(0)) AS is_binary FROM pages")
def _(t):
    return t["pages"].select("page_id", FS.is_binary(F.col("html")).alias("is_binary"))


@query("path_parts", f"""SELECT repo_id, path, {NAME_SQL} AS name, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir, {EXT_SQL} AS ext,
  CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '.' END AS top, array_to_string(string_split(path, '/')[1:2], '/') AS prefix FROM v_code_files""")
def _(t):
    p = F.col("path")
    return t["v_code_files"].select("repo_id", "path", paths.basename(p).alias("name"), paths.dirname(p).alias("dir"),
                                    paths.extension(p).alias("ext"), paths.top_dir(p).alias("top"), paths.prefix2(p).alias("prefix"))


@query("largest_files", """SELECT repo_id, path, bytes, CAST(rn AS INT) AS place FROM (SELECT source AS repo_id, concat(source, '/', lang, '/', CAST(doc_id AS STRING), '.md') AS path, length(text) AS bytes,
  row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, concat(source, '/', lang, '/', CAST(doc_id AS STRING), '.md')) AS rn FROM documents) x WHERE rn <= 500""")
def _(t):
    rows = t["v_files"].select("repo_id", "path", F.length("content").cast("bigint").alias("bytes"))
    return FS.largest_per_repo(rows, 500)


@query("structure", f"""WITH p AS (SELECT repo_id, path, string_split(path, '/') AS s FROM v_code_files),
ok AS (SELECT * FROM p WHERE len(list_filter(s[1:2], lambda d: starts_with(d, '.') OR d IN ({', '.join(map(q, FS.SKIP_DIRS))}))) = 0),
e AS (SELECT DISTINCT repo_id, CASE WHEN len(s) > 1 THEN s[1] || '/' ELSE path END AS entry FROM ok UNION SELECT repo_id, CASE WHEN len(s) > 2 THEN s[1] || '/' || s[2] || '/' ELSE path END FROM ok WHERE len(s) >= 2)
SELECT repo_id, entry, regexp_matches(entry, '^(lib|src|app)/([^/]+/|[^/]+\\.(ts|tsx|js|jsx))$') AS public_surface FROM e""")
def _(t):
    return FS.structure(t["v_code_files"])


@query("recent_commits", """WITH h AS (SELECT repo_id, commit_id, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, commit_id) AS rn FROM (SELECT DISTINCT repo_id, commit_id, ts FROM v_commits) d)
SELECT c.repo_id, c.commit_id, c.file, c.author FROM v_commits c JOIN h ON h.repo_id = c.repo_id AND h.commit_id = c.commit_id WHERE h.rn <= 1000 AND coalesce(c.file, '') <> ''""")
def _(t):
    return C.recent_commits(t["v_commits"], 1000).select("repo_id", "commit_id", "file", "author")


BUS = """a AS (SELECT repo_id, file, author, count(*) AS n FROM v_commits GROUP BY 1, 2, 3),
b AS (SELECT repo_id, file, CAST(sum(n) AS BIGINT) AS commits, max(n) AS top_commits, arg_min(author, (-n, author)) AS top_author FROM a GROUP BY 1, 2 HAVING sum(n) >= 3),
bus AS (SELECT *, CAST(top_commits AS DOUBLE) / commits AS dominance, CAST(top_commits AS DOUBLE) / commits > 0.8 AS is_silo,
  CASE WHEN CAST(top_commits AS DOUBLE) / commits > 0.95 THEN 'medium' WHEN CAST(top_commits AS DOUBLE) / commits > 0.8 THEN 'low' END AS severity FROM b)"""


@query("bus_factor", f"WITH {BUS} SELECT * FROM bus")
def _(t):
    return C.bus_factor(t["v_commits"])


@query("author_diversity", f"WITH {BUS} SELECT repo_id, count(*) AS files, count(CASE WHEN is_silo THEN 1 END) AS silos, CAST(count(*) - count(CASE WHEN is_silo THEN 1 END) AS DOUBLE) / count(*) AS diversity FROM bus GROUP BY repo_id")
def _(t):
    return C.author_diversity(C.bus_factor(t["v_commits"]))


CHURN = """cc AS (SELECT repo_id, file, count(*) AS commits FROM v_commits GROUP BY 1, 2),
cr AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY commits DESC, file) AS place, count(*) OVER (PARTITION BY repo_id) AS n FROM cc),
churn AS (SELECT repo_id, file, commits, place, place <= greatest(1, n // 10) AS is_hotspot, CASE WHEN place <= greatest(1, n // 10) THEN CASE WHEN commits > 50 THEN 'medium' ELSE 'low' END END AS severity FROM cr)"""


@query("churn", f"WITH {CHURN} SELECT * FROM churn")
def _(t):
    return C.churn(t["v_commits"])


STALE = """st AS (SELECT repo_id, string_split(file, '/')[1] AS directory, CAST(max(ts) AS DATE) AS last_commit FROM v_dated_commits WHERE contains(file, '/') GROUP BY 1, 2),
stale AS (SELECT *, last_commit < CAST(DATE '2001-08-01' - INTERVAL 6 MONTH AS DATE) AS is_stale FROM st)"""


@query("stale_areas", f"WITH {STALE} SELECT * FROM stale")
def _(t):
    return C.stale_areas(t["v_dated_commits"], "2001-08-01")


@query("git_health", f"""WITH {CHURN}, {STALE}, ch AS (SELECT repo_id, 1 - CAST(count(CASE WHEN is_hotspot THEN 1 END) AS DOUBLE) / count(*) AS churn_health FROM churn GROUP BY 1),
si AS (SELECT repo_id, count(*) AS silo_findings FROM ({SILO_SQL}) x GROUP BY 1), fr AS (SELECT repo_id, CAST(count(CASE WHEN NOT is_stale THEN 1 END) AS DOUBLE) / count(*) AS freshness FROM stale GROUP BY 1),
td AS (SELECT repo_id, CAST(count(*) - count(severity) AS DOUBLE) / count(*) AS todo_score FROM ({TODO_SQL}) x GROUP BY 1)
SELECT repo_id, CAST(least(100, greatest(0, floor(coalesce(churn_health, 1) * 40 + greatest(0.0, 1.0 - CAST(coalesce(silo_findings, 0) AS DOUBLE) / greatest(5, coalesce(silo_findings, 0))) * 20
  + coalesce(todo_score, 1) * 20 + coalesce(freshness, 1) * 20 + 0.5))) AS INT) AS score FROM fr LEFT JOIN ch USING (repo_id) LEFT JOIN si USING (repo_id) LEFT JOIN td USING (repo_id)""")
def _(t):
    silos = external_silos(t["v_code_lines"]).groupBy("repo_id").agg(F.count(F.lit(1)).alias("silo_findings"))
    todos = _todos(t).groupBy("repo_id").agg(((F.count(F.lit(1)) - F.count("severity")) / F.count(F.lit(1))).alias("todo_score"))
    parts = C.freshness(C.stale_areas(t["v_dated_commits"], "2001-08-01"))
    parts = parts.join(C.churn_health(C.churn(t["v_commits"])), "repo_id", "left").join(silos, "repo_id", "left").join(todos, "repo_id", "left")
    return C.git_health(parts).select("repo_id", "score")


@query("contributors", """SELECT repo_id, count(DISTINCT author) AS contributors FROM v_commits WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY repo_id""")
def _(t):
    since = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return t["v_commits"].where(F.col("ts") >= since).groupBy("repo_id").agg(F.countDistinct("author").alias("contributors"))


@query("owner_heatmap", """WITH c AS (SELECT repo_id, CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) ELSE '(root)' END AS directory, author, count(*) AS commits FROM v_commits GROUP BY 1, 2, 3),
t AS (SELECT repo_id, directory, row_number() OVER (PARTITION BY repo_id ORDER BY sum(commits) DESC, directory) AS rn FROM c GROUP BY 1, 2)
SELECT c.* FROM c JOIN t USING (repo_id, directory) WHERE rn <= 15""")
def _(t):
    return C.owner_heatmap(t["v_commits"])


HOT = f"""x AS (SELECT repo_id, path AS file, CAST({DECISION_SQL} AS INT) AS complexity, CAST(length(content) % 17 AS BIGINT) AS commits FROM v_files),
r AS (SELECT *, percent_rank() OVER (PARTITION BY repo_id ORDER BY complexity) * 100 AS cx, percent_rank() OVER (PARTITION BY repo_id ORDER BY commits) * 100 AS ch FROM x),
hot AS (SELECT repo_id, file, round(cx, 6) AS complexity_rank, round(ch, 6) AS churn_rank, CASE WHEN cx > 50 AND ch > 50 THEN 'toxic' WHEN cx > 50 THEN 'frozen' WHEN ch > 50 THEN 'quick-win' ELSE 'healthy' END AS quadrant FROM r)"""


def _hotspots(t):
    c = F.col("content")
    rows = t["v_files"].select("repo_id", F.col("path").alias("file"), decision_count(c).cast("int").alias("complexity"),
                               (F.length(c) % 17).cast("bigint").alias("commits"))
    rows = cut_lineage(rows)  # the texts are read once; both rankings work on the numbers
    ranked = percent_rank_over(percent_rank_over(rows, ["repo_id"], "complexity", "_cx"), ["repo_id"], "commits", "_ch")
    cx, ch = F.col("_cx") * 100, F.col("_ch") * 100
    return ranked.select(
        "repo_id", "file", F.round(cx, 6).alias("complexity_rank"), F.round(ch, 6).alias("churn_rank"),
        F.when((cx > 50) & (ch > 50), "toxic").when(cx > 50, "frozen").when(ch > 50, "quick-win").otherwise("healthy").alias("quadrant"))


@query("hotspots", f"WITH {HOT} SELECT * FROM hot")
def _(t):
    return _hotspots(t)


@query("quadrant_counts", f"WITH {HOT} SELECT repo_id, quadrant, count(*) AS files FROM hot GROUP BY 1, 2")
def _(t):
    return _hotspots(t).groupBy("repo_id", "quadrant").agg(F.count(F.lit(1)).alias("files"))
