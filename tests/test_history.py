import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from repohealth.operators import history as H
from repohealth.operators import ordered as R


def scans(spark, n):
    rows = [(i, 1, dt.datetime(2024, 1, i), "completed", 50) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "scan_id long, repo_id long, created_at timestamp_ntz, status string, overall_score int")


def reconcile(spark, history, n):
    """Statuses of the newest of ``n`` scans; ``history`` maps scan number to {message: status}."""
    found = [(s, "m", f"p", "c", msg, st) for s, msgs in history.items() for msg, st in msgs.items() if s <= n]
    df = spark.createDataFrame(found, "scan_id long, module_id string, file_path string, category string, message string, status string")
    sc = scans(spark, n)
    ranked = H.ranked_findings(sc, df, 3)
    counts = H.latest_scans(sc, 3).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    out = {r.message: r.status for r in H.reconcile(ranked, counts).collect()}
    gone = sorted(r.message for r in H.tombstones(ranked, H.latest_scans(sc, 3)).collect())
    return out, gone


def test_first_scan_is_new(spark):
    assert reconcile(spark, {1: {"x": "new"}}, 1) == ({"x": "new"}, [])


def test_a_newest_scan_without_findings_fixes_all(spark):
    assert reconcile(spark, {1: {"x": "new", "y": "new"}}, 2) == ({}, ["x", "y"])


def test_recurring_and_tombstone(spark):
    assert reconcile(spark, {1: {"x": "new", "y": "new"}, 2: {"x": "new"}}, 2) == ({"x": "recurring"}, ["y"])


def test_back_after_tombstone_is_regressed(spark):
    got, _ = reconcile(spark, {1: {"x": "new"}, 2: {"x": "fixed"}, 3: {"x": "new"}}, 3)
    assert got == {"x": "regressed"}


def test_absent_two_scans_is_regressed(spark):
    # S1 x; S2 writes the tombstone; S3 nothing; S4 x again: the tombstone of S2 is two scans back.
    got, _ = reconcile(spark, {1: {"x": "new"}, 2: {"x": "fixed"}, 3: {"z": "new"}, 4: {"x": "new"}}, 4)
    assert got == {"x": "regressed"}


def test_absent_three_scans_is_new(spark):
    got, _ = reconcile(spark, {1: {"x": "new"}, 2: {"x": "fixed"}, 3: {"z": "new"}, 4: {"z": "new"}, 5: {"x": "new"}}, 5)
    assert got == {"x": "new"}


def test_module_deltas_and_regressions(spark):
    schema = "repo_id int, module_id string, score int, state string"
    base = spark.createDataFrame([(1, "security", 85, "completed"), (1, "lint", 50, "completed"), (1, "old", 10, "completed")], schema)
    head = spark.createDataFrame([(1, "security", 60, "completed"), (1, "lint", 50, "completed"), (1, "new", 0, "unavailable")], schema)
    got = {r.module_id: (r.delta, r.regression) for r in H.module_deltas(base, head).collect()}
    assert got == {"security": (-25, True), "lint": (0, False), "old": (None, False), "new": (None, True)}
    assert {r.module_id for r in H.regressions(H.module_deltas(base, head)).collect()} == {"security", "new"}


def random_rows(spark, n=600):
    rng = random.Random(5)
    data = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randrange(50), rng.choice([None, rng.randrange(9)])) for i in range(n)]
    return spark.createDataFrame(data, "k int, i int, v int, x int")


def test_bucketed_operators_equal_plain_windows(spark, rows):
    df = random_rows(spark)
    w = Window.partitionBy("k").orderBy("i")
    bucket = R.block("i", 40)
    got = R.lag_over(df, ["k"], ["i"], bucket, {"v": "prev"})
    assert rows(got.select("k", "i", F.coalesce("prev", F.lit(-1)))) == rows(df.select("k", "i", F.coalesce(F.lag("v").over(w), F.lit(-1))))
    for inclusive, end in ((True, 0), (False, -1)):
        got = R.running_sum(df, ["k"], ["i"], bucket, F.col("v"), "s", inclusive)
        want = F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, end)), F.lit(0))
        assert rows(got.select("k", "i", "s")) == rows(df.select("k", "i", want))
    got = R.last_seen(df, ["k"], ["i"], bucket, F.col("x"), "y")
    want = F.last("x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    assert rows(got.select("k", "i", F.coalesce("y", F.lit(-1)))) == rows(df.select("k", "i", F.coalesce(want, F.lit(-1))))


def test_positions_and_ranks_equal_plain_windows(spark, rows):
    df = random_rows(spark)
    w = Window.partitionBy("k").orderBy(F.col("v").desc(), "i")
    got = R.with_position(df, ["k"], [F.col("v").desc(), F.col("i")])
    assert rows(got.select("k", "i", "position")) == rows(df.select("k", "i", F.row_number().over(w)))
    whole = R.with_position(df, [], [F.col("i").desc()])
    assert rows(whole.select("position", "i")) == [(n + 1, 599 - n) for n in range(600)]
    got = R.percent_rank_over(df, ["k"], "v", "p")
    assert rows(got.select("k", "i", F.round("p", 9))) == rows(df.select("k", "i", F.round(F.percent_rank().over(Window.partitionBy("k").orderBy("v")), 9)))


def test_top_cut_happens_before_the_shuffle(spark):
    df = random_rows(spark)
    plan = R.top_per_key(df, ["k"], [F.col("i")], 1000 - 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_snapshot_delta_first_is_zero(spark):
    df = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), 50.0), (1, 2, dt.datetime(2024, 3, 1), 47.25)],
                               "repo_id long, snapshot_id long, ts timestamp_ntz, overall double")
    assert {r.snapshot_id: r.delta for r in H.snapshot_deltas(df).collect()} == {1: 0.0, 2: -2.7}


def test_findings_meet_their_scans_once_and_unsorted(spark, monkeypatch):
    from repohealth.plans import REGISTRY, history_plans
    from repohealth.sources.views import Tables

    plans = []
    monkeypatch.setattr(history_plans, "cut_lineage", lambda df, cut=history_plans.cut_lineage: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or cut(df), raising=False)
    tables = Tables(spark, "/root/testdata/sf0.001")
    for name in ("reconcile", "tombstones"):
        assert REGISTRY[name].job(tables).count() > 0
    assert len(plans) == 2 and all("ShuffledHashJoin" in p and "SortMergeJoin" not in p for p in plans)
