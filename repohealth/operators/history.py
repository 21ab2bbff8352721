"""Scan history: scan order, comparison of scans, finding lifecycle and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repohealth.functions.scalars import fingerprint, half_up
from repohealth.operators.ordered import lag_over, top_per_key, week

SCAN_ORDER = ["created_at", "scan_id"]


def completed(scans: DataFrame) -> DataFrame:
    return scans.where(F.col("status") == "completed")


def latest_scans(scans: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` completed scans of every repository with their rank (1 = newest)."""
    newest = [F.col(c).desc() for c in SCAN_ORDER]
    return top_per_key(completed(scans), ["repo_id"], newest, n, rank="scan_rank")


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn(
        "fingerprint",
        fingerprint(F.col("module_id"), F.col("file_path"), F.col("category"), F.col("message")),
    )


def ranked_findings(scans: DataFrame, findings: DataFrame, n: int) -> DataFrame:
    """Findings of the newest ``n`` scans per repository with repo_id, scan_rank and fingerprint.

    Findings are wide and many, scans few and narrow: the scans of a partition are
    hashed, so the findings are not sorted and do not spill.
    """
    ranks = latest_scans(scans, n).select("repo_id", "scan_id", "scan_rank")
    return with_fingerprint(findings.join(ranks.hint("shuffle_hash"), "scan_id"))


def diff_findings(base: DataFrame, head: DataFrame, kind: str) -> DataFrame:
    """Rows of ``head`` that are new or unchanged, or rows of ``base`` that were fixed; duplicates are kept."""
    keys = ["repo_id", "fingerprint"]
    if kind == "new":
        return head.join(base.select(*keys).distinct(), keys, "left_anti")
    if kind == "fixed":
        return base.join(head.select(*keys).distinct(), keys, "left_anti")
    if kind == "unchanged":
        return head.join(base.select(*keys).distinct(), keys, "left_semi")
    raise ValueError(kind)


def module_deltas(base: DataFrame, head: DataFrame) -> DataFrame:
    """Score and state of every module on both sides; the delta needs both."""
    keys = ["repo_id", "module_id"]
    before = base.select(*keys, F.col("score").alias("score_before"), F.col("state").alias("state_before"), F.lit(True).alias("_b"))
    after = head.select(*keys, F.col("score").alias("score_after"), F.col("state").alias("state_after"), F.lit(True).alias("_a"))
    both = before.join(after, keys, "full_outer")
    worse = (F.col("state_before") == "completed") & (F.col("state_after") == "completed") & (F.col("score_before") > F.col("score_after"))
    gone = ~F.col("state_before").eqNullSafe("not_applicable") & (F.col("state_after") == "unavailable")
    return both.select(
        *keys, "score_before", "score_after",
        F.when(F.col("_a") & F.col("_b"), F.col("score_after") - F.col("score_before")).alias("delta"),
        "state_before", "state_after",
        (F.coalesce(worse, F.lit(False)) | F.coalesce(gone, F.lit(False))).alias("regression"),
    )


def regressions(deltas: DataFrame) -> DataFrame:
    return deltas.where(F.col("regression") | (F.col("delta") < 0))


def reconcile(ranked: DataFrame, scans_per_repo: DataFrame) -> DataFrame:
    """Status of every finding of the newest scan (rank 1) from the two scans before it.

    Presence in the older scans is folded to one row per fingerprint with a
    map-side combined aggregate, so copies of one finding never meet in a group.
    ``scans_per_repo`` holds (repo_id, n) with the number of scans seen.
    """
    head = ranked.where(F.col("scan_rank") == 1)
    older = ranked.where(F.col("scan_rank") > 1).groupBy("repo_id", "fingerprint").agg(
        F.max((F.col("scan_rank") == 2).cast("int")).alias("_prev"),
        F.max((F.col("scan_rank") == 3).cast("int")).alias("_prev2"),
        F.max(((F.col("scan_rank") == 2) & (F.col("status") == "fixed")).cast("int")).alias("_fixed"),
    )
    joined = head.join(older, ["repo_id", "fingerprint"], "left").join(scans_per_repo, "repo_id")
    prev, prev2, fixed = (F.coalesce(F.col(c), F.lit(0)) for c in ("_prev", "_prev2", "_fixed"))
    back = ((prev2 == 1) & (prev == 0)) | (fixed == 1)
    status = (
        F.when(F.col("n") < 2, F.lit("new"))
        .when((F.col("n") >= 3) & back, F.lit("regressed"))
        .when(prev == 1, F.lit("recurring"))
        .otherwise(F.lit("new"))
    )
    return joined.withColumn("status", status).select(*head.columns)


def tombstones(ranked: DataFrame, newest: DataFrame) -> DataFrame:
    """Findings of the previous scan that are gone now, as fixed rows of the newest scan; they keep their module.

    ``newest`` has the scans with their rank (``latest_scans``): a newest scan without any finding fixes all.
    """
    heads = ranked.where(F.col("scan_rank") == 1).select("repo_id", "fingerprint").distinct()
    current = newest.where(F.col("scan_rank") == 1).select("repo_id", F.col("scan_id").alias("_scan"))
    gone = ranked.where((F.col("scan_rank") == 2) & ~F.coalesce(F.col("status") == "fixed", F.lit(False)))
    return (
        gone.join(heads, ["repo_id", "fingerprint"], "left_anti").join(current, "repo_id")
        .withColumn("scan_id", F.col("_scan")).withColumn("status", F.lit("fixed")).drop("_scan")
    )


def score_deltas(scans: DataFrame) -> DataFrame:
    """Change of the overall score against the repository's previous scan."""
    lagged = lag_over(scans, ["repo_id"], SCAN_ORDER, week("created_at"), {"overall_score": "previous_score"})
    return lagged.withColumn("delta", F.col("overall_score") - F.col("previous_score"))


def module_score_changes(results: DataFrame) -> DataFrame:
    """Per module, the change against the previous scan of the repository that has the module; unchanged ones left out."""
    lagged = lag_over(
        results, ["repo_id", "module_id"], SCAN_ORDER, week("created_at"), {"score": "previous_score"}
    )
    return lagged.withColumn("diff", F.col("score") - F.col("previous_score")).where(F.col("diff") != 0)


def trend_word(current: Column, previous: Column) -> Column:
    return (
        F.when(current > previous, "improving").when(current < previous, "declining").otherwise("stable")
    )


def trends(scans: DataFrame) -> DataFrame:
    """Direction of the newest completed scan against the one before; stable without a previous score."""
    two = latest_scans(scans, 2)
    pair = two.groupBy("repo_id").agg(
        F.max(F.when(F.col("scan_rank") == 1, F.col("overall_score"))).alias("latest"),
        F.max(F.when(F.col("scan_rank") == 2, F.col("overall_score"))).alias("previous"),
    )
    return pair.withColumn("trend", trend_word(F.col("latest"), F.col("previous")))


def snapshot_deltas(snapshots: DataFrame) -> DataFrame:
    """Change of the overall value against the previous snapshot, one decimal, 0 for the first."""
    lagged = lag_over(snapshots, ["repo_id"], ["ts", "snapshot_id"], week("ts"), {"overall": "_prev_overall"})
    delta = F.coalesce(half_up((F.col("overall") - F.col("_prev_overall")) * 10) / F.lit(10), F.lit(0.0))
    return lagged.withColumn("delta", delta).drop("_prev_overall")
