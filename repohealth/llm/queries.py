"""Queries of this subpackage: op<N>_<name> over whole tables, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repohealth.llm import decontam, jaccard, lm, negatives, packing, planes, quality, ranking, sharding, suffix, toxicity, urlfilter, warc
from repohealth.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(job):
        QUERIES[name] = job
        if sql:
            SQL[name] = sql
        return job

    return add


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


SQL_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT // CAST(pow(32, 3 - k % 4) AS BIGINT) % 32 AS BIGINT), 1)), '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""


@query("op1_warc_revisits", SQL_WARC)
def op1(spark, sf_dir):
    return warc.deduplicated(table(spark, sf_dir, "pages"))


@query("op2_concat_and_cut")
def op2(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


@query("op4_bounded_ring")
def op4(spark, sf_dir):
    placed = sharding.assign(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# Fixed values of the query: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

SQL_URLS = f"""
WITH r(r_host, r_path, r_verdict) AS (VALUES {", ".join(map(str, RULES))}),
a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
f AS (SELECT page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM p JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""


@query("op5_url_expressions", SQL_URLS)
def op5(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.verdicts(table(spark, sf_dir, "pages"), rules)


@query("op6_backoff_automaton")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.fold(docs["doc_id"]))


@query("op9_line_frequency")
def op9(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


@query("op8_template_windows")
def op8(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_compression_distance")
def op3(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL_JACCARD = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.c = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
"""


@query("op7_jaccard_join", SQL_JACCARD)
def op7(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


SQL_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, 200) AS g FROM d, LATERAL (SELECT unnest(range(0, n - 99)) AS s)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
e AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM e) GROUP BY doc_id, k),
j AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM i),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept
  FROM j JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


@query("op10_column_suffixes", SQL_REPEATS)
def op10(spark, sf_dir):
    found = suffix.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.col(f"__{a}").alias(b) for a, b in (("bytes", "n_bytes"), ("removed", "n_removed"), ("spans", "n_spans"), ("sha256", "kept_sha256"))])


@query("op13_bit_planes")
def op13(spark, sf_dir):
    return planes.round_trip(table(spark, sf_dir, "documents"), vocabulary())


SQL_RANKING = """
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
z AS (SELECT count(CASE WHEN len(w) > 0 THEN 1 END) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM t),
f AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), z),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term), z GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


@query("op11_shared_terms", SQL_RANKING)
def op11(spark, sf_dir):
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.*, other_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op12_vertical_negatives", SQL_NEGATIVES)
def op12(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", noisy.alias("label"), "embedding"))
