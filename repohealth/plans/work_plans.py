"""Queries that prepare reviews, read replies and follow progress."""

from __future__ import annotations

from pyspark.sql import functions as F


from repohealth.functions.scalars import (
    backticked, clamp, count_if, estimate_tokens, extract_json_text, half_up, install_hint, INSTALL_PATTERNS,
)
from repohealth.operators import work as W
from repohealth.operators.ordered import with_position
from repohealth.plans.registry import query
from repohealth.plans.sqltext import half_up as hu
from repohealth.plans.sqltext import q
from repohealth.sources import results, snapshots
from repohealth.streaming import jobs

BATCHES = "b AS (SELECT o_custkey AS repo_id, o_orderkey AS batch_no, CAST(floor(o_totalprice / 40) AS BIGINT) AS tokens FROM orders)"


def _batches(t):
    return t["orders"].select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("batch_no"), F.floor(F.col("o_totalprice") / 40).alias("tokens"))


@query("budget_pack", f"WITH {BATCHES} SELECT *, used < 25000 AS processed FROM (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY repo_id ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM b) x")
def _(t):
    return W.budget_pack(_batches(t), ["repo_id"], 25_000)


@query("budget_strict", f"WITH {BATCHES} SELECT *, used <= 25000 AS processed FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY repo_id ORDER BY batch_no) AS BIGINT) AS used FROM b) x")
def _(t):
    return W.budget_pack(_batches(t), ["repo_id"], 25_000, strict=True)


@query("batches", "SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS position, (row_number() OVER (PARTITION BY repo_id ORDER BY path) - 1) // 5 AS batch_no FROM v_files")
def _(t):
    return W.batches_of(t["v_files"].select("repo_id", "path"), 5)


@query("review_input", """WITH p AS (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS position, concat('### ', path, chr(10), content) AS text FROM v_files),
b AS (SELECT repo_id, (position - 1) // 5 AS batch_no, string_agg(text, chr(10) || chr(10) ORDER BY position) AS text, count(*) AS files FROM p GROUP BY 1, 2)
SELECT repo_id, batch_no, md5(text) AS text_md5, files, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM b""")
def _(t):
    return W.review_input(t["v_files"], 5).select("repo_id", "batch_no", F.md5("text").alias("text_md5"), "files", "tokens")


@query("token_cost", """SELECT doc_id, tokens, round(tokens / 1000000.0 * 0.25 + tokens * 2 / 1000000.0 * 1.25, 9) AS small, round(tokens / 1000000.0 * 3 + tokens * 2 / 1000000.0 * 15, 9) AS medium, round(tokens / 1000000.0 * 15 + tokens * 2 / 1000000.0 * 75, 9) AS large
FROM (SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents) x""".replace("1000000.0", "CAST(1000000 AS DOUBLE)"))
def _(t):
    tokens = estimate_tokens(F.col("text"))
    return t["documents"].select("doc_id", tokens.alias("tokens"), *[F.round(W.token_cost(tokens, tier), 9).alias(tier) for tier in W.PRICES])


@query("diverse_files", """WITH s AS (SELECT repo_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, CAST(length(content) AS INT) AS size, content FROM v_files),
d AS (SELECT *, row_number() OVER (PARTITION BY repo_id, dir ORDER BY size DESC, path) AS rd FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY size DESC, path) AS rn FROM d WHERE rd <= 3)
SELECT repo_id, path, size, CAST(rn AS INT) AS place, md5(CASE WHEN size > 50000 THEN substring(content, 1, 50000) || chr(10) || '... (truncated)' ELSE content END) AS content_md5 FROM r WHERE rn <= 15""")
def _(t):
    return W.diverse_files(t["v_files"]).select("repo_id", "path", "size", "place", F.md5("content").alias("content_md5"))


SAMPLE = """x AS (SELECT repo_id, path, CAST(length(content) % 23 AS INT) AS complexity, CAST(length(content) % 17 AS INT) AS churn, CAST(length(content) % 7 AS INT) AS imports FROM v_files),
m AS (SELECT *, coalesce(CAST(complexity AS DOUBLE) / nullif(max(complexity) OVER w, 0), 0) AS c, coalesce(CAST(churn AS DOUBLE) / nullif(max(churn) OVER w, 0), 0) AS h, coalesce(CAST(imports AS DOUBLE) / nullif(max(imports) OVER w, 0), 0) AS i FROM x WINDOW w AS (PARTITION BY repo_id)),
s AS (SELECT repo_id, path, floor((c * CAST(0.4 AS DOUBLE) + h * CAST(0.3 AS DOUBLE) + i * CAST(0.3 AS DOUBLE)) * 1000 + 0.5) / 1000 AS score,
  coalesce(nullif(concat_ws(', ', CASE WHEN c > 0 THEN concat('complexity: ', CAST(CAST(floor(c * 100 + 0.5) AS BIGINT) AS VARCHAR), '%') END, CASE WHEN h > 0 THEN concat('churn: ', CAST(CAST(floor(h * 100 + 0.5) AS BIGINT) AS VARCHAR), '%') END,
    CASE WHEN i > 0 THEN concat('imports: ', CAST(CAST(floor(i * 100 + 0.5) AS BIGINT) AS VARCHAR), '%') END), ''), 'baseline inclusion') AS reason FROM m)"""


@query("sample_files", f"WITH {SAMPLE} SELECT repo_id, path, score, reason, CAST(rn AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path) AS rn FROM s) z WHERE rn <= 20")
def _(t):
    n = F.length("content")
    rows = t["v_files"].select("repo_id", "path", (n % 23).alias("complexity"), (n % 17).alias("churn"), (n % 7).alias("imports"))
    return W.sample_files(rows, 20)


FENCE = r"```(?:json)?\s*\n?([\s\S]*?)```"
JSON_TEXT = f"""CASE WHEN regexp_matches(text, {q(FENCE)}) THEN regexp_replace(regexp_extract(text, {q(FENCE)}, 1), '^\\s+|\\s+$', '', 'g') WHEN starts_with(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '{{') THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g')
  WHEN strpos(text, '{{') > 0 AND strpos(text, '}}') > 0 AND length(text) - strpos(reverse(text), '}}') + 1 > strpos(text, '{{') THEN substring(text, strpos(text, '{{'), length(text) - strpos(reverse(text), '}}') + 1 - strpos(text, '{{') + 1) END"""


@query("extract_json", f"SELECT response_id, {JSON_TEXT} AS doc FROM v_reviews")
def _(t):
    return t["v_reviews"].select("response_id", extract_json_text(F.col("text")).alias("doc"))


REVIEW = f"""j AS (SELECT response_id, text, try_cast({JSON_TEXT} AS JSON) AS d FROM v_reviews)"""


@query("parse_review", f"""WITH {REVIEW} SELECT response_id, CASE WHEN d IS NOT NULL THEN coalesce(json_extract_string(d, '$.summary'), '') ELSE substring(text, 1, 1000) END AS summary,
  CAST(coalesce(len(list_filter(json_extract(d, '$.findings[*]'), lambda f: json_extract_string(f, '$.message') IS NOT NULL)), 0) AS INT) AS findings FROM j""")
def _(t):
    return W.parse_reviews(t["v_reviews"]).withColumn("findings", F.size("findings"))


@query("review_findings", f"""WITH {REVIEW}, f AS (SELECT response_id, unnest(json_extract(d, '$.findings[*]')) AS f FROM j WHERE d IS NOT NULL),
g AS (SELECT response_id, coalesce(json_extract_string(f, '$.severity'), 'medium') AS severity, coalesce(json_extract_string(f, '$.file'), '') AS file, try_cast(json_extract_string(f, '$.line') AS INT) AS line, json_extract_string(f, '$.message') AS message, coalesce(json_extract_string(f, '$.category'), 'general') AS category FROM f)
SELECT *, 'naming-quality' AS module_id, sha256('naming-quality::' || file || '::' || category || '::' || message) AS fingerprint FROM g WHERE message IS NOT NULL""")
def _(t):
    return W.review_findings(t["v_reviews"], "naming-quality")


@query("commands", f"""SELECT finding_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(suggestion, ''), '`([^`]+)`', 1))), '|') AS commands FROM v_rich_findings""")
def _(t):
    # Spans keep their order of appearance; the oracle's order is made the same by sorting both.
    spans = F.array_sort(backticked(F.col("suggestion")))
    return t["v_rich_findings"].select("finding_id", F.array_join(spans, "|").alias("commands"))


HINTS = "h AS (SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN concat('Tool missing. Install with: cargo install ', p_name) WHEN 1 THEN 'Install ripgrep for best results: brew install ripgrep' WHEN 2 THEN concat('run npm install -g ', replace(p_name, ' ', '-')) WHEN 3 THEN p_name ELSE 'go install example.org/tool@latest' END AS text FROM part)"


@query("install_hint", f"WITH {HINTS} SELECT id, coalesce({', '.join(f'nullif(trim(regexp_extract(text, {q(p)}, 1)), {q(str())})' for p in INSTALL_PATTERNS)}) AS command FROM h")
def _(t):
    name, k = F.col("p_name"), F.col("p_size") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("Tool missing. Install with: cargo install "), name)).when(k == 1, "Install ripgrep for best results: brew install ripgrep")
        .when(k == 2, F.concat(F.lit("run npm install -g "), F.replace(name, F.lit(" "), F.lit("-")))).when(k == 3, name).otherwise("go install example.org/tool@latest")
    )
    return t["part"].select(F.col("p_partkey").alias("id"), text.alias("text")).select("id", install_hint(F.col("text")).alias("command"))


@query("rounding", f"SELECT l_orderkey AS id, l_linenumber AS n, l_extendedprice AS x, {hu('(l_tax - l_discount) * 50')} AS rounded, CAST(least(100, greatest(0, floor(l_extendedprice / 900 - 5 + 0.5))) AS BIGINT) AS clamped FROM lineitem")
def _(t):
    x = F.col("l_extendedprice")
    return t["lineitem"].select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), x.alias("x"),
                                half_up((F.col("l_tax") - F.col("l_discount")) * 50).alias("rounded"), clamp(half_up(x / 900 - 5)).alias("clamped"))


@query("audit_totals", """SELECT audit_id, repo_id, provider, CAST(CASE WHEN json_valid(findings) THEN coalesce(json_array_length(findings), 0) ELSE 0 END AS BIGINT) AS findings FROM v_audits ORDER BY created_at DESC, audit_id DESC LIMIT 20""")
def _(t):
    newest = t["v_audits"].orderBy(F.col("created_at").desc(), F.col("audit_id").desc()).limit(20)
    parsed = F.from_json("findings", "array<struct<severity:string,file:string,line:int,message:string,category:string>>")
    size = F.coalesce(F.size(F.when(F.col("findings").startswith("["), parsed)), F.lit(0))
    return newest.select("audit_id", "repo_id", "provider", F.greatest(F.lit(0), size).cast("bigint").alias("findings"))


@query("token_usage", "SELECT provider, repo_id, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(tokens_in) + sum(tokens_out) AS BIGINT) AS used, CAST(greatest(0, 1000000 - (sum(tokens_in) + sum(tokens_out))) AS BIGINT) AS remaining, sum(tokens_in) + sum(tokens_out) >= 1000000 AS exhausted FROM v_audits GROUP BY provider, repo_id")
def _(t):
    return W.token_usage(t["v_audits"], ["provider", "repo_id"], 1_000_000)


@query("discovery_sort", """SELECT repo_id, name, days_since_commit, row_number() OVER (ORDER BY days_since_commit IS NULL, days_since_commit, name, repo_id) AS position FROM v_repos""")
def _(t):
    order = [F.col("days_since_commit").isNull(), F.col("days_since_commit"), F.col("name"), F.col("repo_id")]
    return with_position(t["v_repos"].select("repo_id", "name", "days_since_commit"), [], order)


TREND = "tr AS (SELECT c_custkey AS repo_id, c_custkey % 997 AS stars, CAST(DATE '2024-06-30' - CAST(c_custkey % 90 AS INT) AS DATE) AS created_at, CASE WHEN c_nationkey % 2 = 0 THEN ['cli', 'x'] ELSE ['framework'] END AS topics FROM customer)"


def _trending(t, category):
    key = F.col("c_custkey")
    repos = t["customer"].select(
        key.alias("repo_id"), (key % 997).alias("stars"), F.date_sub(F.lit("2024-06-30").cast("date"), (key % 90).cast("int")).alias("created_at"),
        F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("cli"), F.lit("x"))).otherwise(F.array(F.lit("framework"))).alias("topics"))
    return W.trending(repos, category, "2024-06-30").select("repo_id", "stars", F.lit(category).alias("category"))


@query("trending", f"""WITH {TREND} SELECT * FROM (SELECT repo_id, stars, 'trending' AS category FROM tr WHERE created_at > DATE '2024-05-31' AND stars > 100 ORDER BY stars DESC, repo_id LIMIT 12) a
UNION ALL SELECT * FROM (SELECT repo_id, stars, 'cli' FROM tr WHERE list_contains(topics, 'cli') AND stars > 500 ORDER BY stars DESC, repo_id LIMIT 12) b UNION ALL SELECT * FROM (SELECT repo_id, stars, 'framework' FROM tr WHERE list_contains(topics, 'framework') AND stars > 500 ORDER BY stars DESC, repo_id LIMIT 12) c""")
def _(t):
    return _trending(t, "trending").unionByName(_trending(t, "cli")).unionByName(_trending(t, "framework"))


@query("snapshots_jsonl", """SELECT repo_id, snapshot_id, overall FROM v_snapshots WHERE snapshot_id % 7 <> 3 AND snapshot_id % 11 <> 5""")
def _(t):
    """Snapshots read back from their JSON lines, of which some are broken or blank."""
    n = F.col("snapshot_id")
    good = F.to_json(F.struct(F.col("snapshot_id").cast("string").alias("commit"), F.col("overall")))
    text = F.when(n % 7 == 3, F.lit("")).when(n % 11 == 5, F.concat(good, F.lit(" {"))).otherwise(good)
    lines = t["v_snapshots"].select("repo_id", "snapshot_id", text.alias("text"))
    return snapshots.parse_snapshot_lines(lines).select("repo_id", "snapshot_id", "overall")


@query("export_documents", """SELECT scan_id, 'scan' AS kind, count(*) AS docs FROM v_scans GROUP BY scan_id UNION ALL SELECT scan_id, 'module', count(*) FROM v_module_results GROUP BY scan_id UNION ALL SELECT scan_id, 'finding', count(*) FROM v_findings GROUP BY scan_id""")
def _(t):
    docs = results.export_documents(t["v_scans"], t["v_module_results"], t["v_findings"])
    return docs.groupBy("scan_id", F.get_json_object("doc", "$.kind").alias("kind")).agg(F.count(F.lit(1)).alias("docs"))


PROGRESS = "lp AS (SELECT scan_id, module_id, arg_max(pct, (ts, seq)) AS pct, arg_max(status, (ts, seq)) AS status FROM v_progress GROUP BY 1, 2)"


@query("latest_progress", f"WITH {PROGRESS} SELECT * FROM lp")
def _(t):
    return jobs.latest_progress(t["v_progress"]).select("scan_id", "module_id", "pct", "status")


@query("batch_progress", f"WITH {PROGRESS} SELECT scan_id, count(*) AS total, count(CASE WHEN status IN ('completed', 'failed') THEN 1 END) AS completed, count(CASE WHEN status = 'failed' THEN 1 END) AS failed FROM lp GROUP BY scan_id")
def _(t):
    return jobs.batch_progress(jobs.latest_progress(t["v_progress"]))


@query("chunks", "SELECT conv_id AS audit_id, role AS module_id, md5(string_agg(text, '' ORDER BY turn, text)) AS text_md5, count(*) AS chunks FROM conversations GROUP BY 1, 2")
def _(t):
    rows = t["conversations"].select(F.col("conv_id").alias("audit_id"), F.col("role").alias("module_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"))
    return jobs.assemble_chunks(rows).select("audit_id", "module_id", F.md5("text").alias("text_md5"), "chunks")
