from pyspark.sql import functions as F

from repohealth.operators import findings as O
from repohealth.operators import scoring

RESULTS = [
    ("security", 80, 1.0, "completed"), ("dependencies", 20, 0.5, "completed"), ("build", 0, 1.0, "not_applicable"),
    ("lint", 99, 1.0, "unavailable"), ("test", -1, 1.0, "completed"),
]
SCHEMA = "module_id string, score int, confidence double, state string"


def results(spark):
    return spark.createDataFrame(RESULTS, SCHEMA).withColumn("scan_id", F.lit(1))


def test_weighted_score(spark):
    assert scoring.overall_score(results(spark), ["scan_id"]).first()["overall_score"] == 60


def test_score_is_zero_without_eligible_rows(spark):
    none = results(spark).where("state = 'unavailable'")
    assert scoring.overall_score(none, ["scan_id"]).first()["overall_score"] == 0


def test_summary(spark):
    row = scoring.score_summary(results(spark), ["scan_id"]).first()
    assert (row.total, row.scored, row.passing, row.not_applicable, row.neutral, row.unavailable) == (5, 2, 1, 1, 1, 1)


def test_profile_weight(spark):
    row = spark.range(1).select(
        scoring.profile_weight(F.lit("dead-code"), "library").alias("a"), scoring.profile_weight(F.lit("x"), "library").alias("b"),
        scoring.profile_weight(F.lit("x"), None).alias("c")).first()
    assert tuple(row) == (1.5, 1.0, 1.0)


def test_deduction_floor_and_unknown(spark):
    rows = spark.createDataFrame([(1, "critical")] * 7 + [(2, "odd")], "k int, severity string")
    got = {r.k: r.score for r in scoring.deduction_score(rows, ["k"], scoring.deduction_points("security", F.col("severity"))).collect()}
    assert got == {1: 0, 2: 100}


def test_dead_code_score(spark):
    row = spark.range(1).select(scoring.dead_code_score(F.lit(2), F.lit(100), F.lit(1)).alias("s")).first()
    assert row.s == 55


def test_priority_critical_floor(spark):
    row = spark.range(1).select(
        O.priority(F.lit("critical"), F.lit(0.1), F.lit(0.0)).alias("a"), O.priority(F.lit("low"), F.lit(0.5), F.lit(1.0)).alias("b")).first()
    assert tuple(row) == (2.5, 2.0)


def test_adoption_risk_blocks_on_critical_security(spark):
    modules = spark.createDataFrame([(1, "security", 90, 1.0, "completed"), (2, "git-health", 30, 1.0, "completed")],
                                    "repo int, module_id string, score int, confidence double, state string")
    found = spark.createDataFrame([(1, "security", "critical", "x"), (2, "dependencies", "high", "y")],
                                  "repo int, module_id string, severity string, category string")
    got = {r.repo: (r.adoption_risk, r.verdict) for r in scoring.adoption_risk(modules, found, ["repo"]).collect()}
    assert got == {1: (100, "avoid"), 2: (83, "avoid")}


def test_ignore_paths_quirk(spark):
    df = spark.createDataFrame([("lib/a",), ("src/lib/a",), (None,)], "file_path string")
    left = [r.file_path for r in O.ignore_paths(df, ["lib/**", "**/a"]).collect()]
    assert left == ["src/lib/a", None]


def test_ignore_globs(spark):
    import fnmatch

    from repohealth.operators.findings import ignore_paths

    paths = ["lib/a.ts", "lib/x/y/a.ts", "lib/x/a.tsx", "components/a.ts", "src/components/b.ts", "components", "app/q/f1.ts", "app/q/f12.ts", "app/q/r/f12.ts", "utils/a", "x/utils/a", "a+b/c.ts", "axb/c.ts", None]
    df = spark.createDataFrame([(p,) for p in paths], "file_path string")
    kept = lambda *globs: {r.file_path for r in ignore_paths(df, list(globs), "glob").collect()}
    gone = lambda *globs: set(paths) - kept(*globs)
    assert gone("lib/**/*.ts") == {"lib/a.ts", "lib/x/y/a.ts"}
    assert gone("components") == {"components/a.ts", "src/components/b.ts", "components"}
    assert gone("app/*/f1?.*") == {"app/q/f12.ts"} and gone("/utils/**") == {"utils/a"} and gone("a+b/*") == {"a+b/c.ts"}
    assert gone("*.tsx") == {p for p in paths if p and fnmatch.fnmatch(p, "*.tsx")}
    assert kept("**") == {None}
