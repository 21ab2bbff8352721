"""URL filters: host-suffix and path-prefix expressions, joined with the rules on short hash prefixes.

A rule is a host, a path and a verdict. It fits its host and all subdomains when the path of the url starts with the
rule's path. Expressions are only written for suffix lengths (in labels) and path lengths that some rule has, so the
number of expressions of a url is bounded by the rules and no fitting rule is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repohealth.llm.common import cut, lower_az

PREFIX_DIGITS = 8  # hexadecimal digits of the digest in the join key


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as defined by the contract; both empty without ``://`` or for null."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_az(host), path


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules with digests; of equal (host, path) a block wins. Rules with a null host or path fit nothing."""
    r = rules.select(lower_az(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    r = r.where("r_host IS NOT NULL AND r_path IS NOT NULL AND r_verdict IS NOT NULL")
    r = r.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # 'block' > 'allow'
    full = _digest(F.concat("r_host", "r_path"))
    return r.withColumns({
        "r_digest": full, "r_prefix": F.substring(full, 1, PREFIX_DIGITS),
        "r_labels": _labels(F.col("r_host")), "r_length": F.length("r_path"),
    })


def verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    The longest fitting rule wins (characters of host and path together, then the longer host); without a fitting rule
    the verdict is ``default`` and rule is null. Null urls and urls without ``://`` have an empty host and path and fit
    nothing unless a rule is empty too. Repeated rows give repeated results; null page ids are kept; further columns
    are not read. An empty table gives no rows; no rules give the default everywhere.

    Urls are first folded to their distinct (host, path start), so that a host with a third of all rows is expanded
    once. The only broadcast is the planner's own, by size.
    """
    host, path = url_parts(F.col("url"))
    r = cut(prepared_rules(rules), "url-rules")
    # two small facts about the rules: bounded by the longest host and path, not by the number of rules
    shape = r.agg(F.collect_set("r_labels").alias("labels"), F.collect_set("r_length").alias("lengths"), F.max("r_length").alias("longest")).first()
    labels, lengths, longest = sorted(shape.labels), sorted(shape.lengths), shape.longest or 0

    p = pages.select(F.col("page_id").alias("page_id"), host.alias("host"), path.alias("path"))
    start = F.substring("path", 1, longest)
    if not labels:
        return p.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    sites = p.select("host", start.alias("start")).distinct()
    suffixes = sites.select("host", "start", F.explode(F.array(*[F.lit(k) for k in labels])).alias("k")).where(_labels(F.col("host")) >= F.col("k"))
    suffixes = suffixes.select("host", "start", F.expr("substring_index(host, '.', -k)").alias("e_host"))
    prefixes = suffixes.select("host", "start", "e_host", F.explode(F.array(*[F.lit(k) for k in lengths])).alias("k")).where(F.length("start") >= F.col("k"))
    full = _digest(F.concat("e_host", F.expr("substring(start, 1, k)")))
    expressions = prefixes.select("host", "start", full.alias("digest"), F.substring(full, 1, PREFIX_DIGITS).alias("prefix"))
    hits = expressions.join(r, (F.col("prefix") == F.col("r_prefix")) & (F.col("digest") == F.col("r_digest")))
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"),
        F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"),
    )
    best = hits.groupBy(F.col("host").alias("b_host"), F.col("start").alias("b_start")).agg(F.max(rank).alias("best"))
    best = cut(best.select("b_host", "b_start", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("b_verdict")), "url-sites")
    joined = p.join(best, (F.col("host") == F.col("b_host")) & (start == F.col("b_start")), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("b_verdict", F.lit(default)).alias("verdict"))
