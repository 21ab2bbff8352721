import datetime as dt
import random

from pyspark.sql import functions as F

from repohealth import scan
from repohealth.operators import history as H
from repohealth.operators import shape
from repohealth.sources import documents, files, results, snapshots
from repohealth.sources.views import Tables
from repohealth.streaming import jobs


def test_read_files(spark, tmp_path):
    for name, text in (("src/a.ts", "x\ny"), ("node_modules/p/i.js", "z"), ("src/big.ts", "w" * 500), (".git/config", "")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    df = files.read_files(spark, str(tmp_path), "r", max_bytes=300)
    kept = df.where(files.scannable(F.col("path")))
    assert [(r.path, r.content) for r in kept.collect()] == [("src/a.ts", "x\ny")]
    assert [(r.line_no, r.text) for r in files.explode_lines(kept).collect()] == [(1, "x"), (2, "y")]


def test_line_counts(spark):
    df = spark.createDataFrame([("",), ("a",), ("a\n",)], "c string")
    got = df.select(files.line_count(F.col("c")), files.split_count(F.col("c")), files.is_binary(F.concat(F.col("c"), F.lit("\0")))).collect()
    assert [tuple(r) for r in got] == [(0, 1, True), (1, 1, True), (2, 2, True)]


def test_snapshot_files(spark, tmp_path):
    path = str(tmp_path / "snaps")
    row = spark.createDataFrame([("c1", "t", {"a": 1.0}, 80.0, 0.0, 1)], "commit string, timestamp string, scores map<string,double>, overall double, delta double, moduleCount int")
    snapshots.append_snapshot(row, path)
    snapshots.append_snapshot(row.withColumn("commit", F.lit("c2")), path)
    (tmp_path / "snaps" / "part-broken.json").write_text('{"commit": "c3", "overall":\n\nnot json\n')
    assert sorted(r.commit for r in snapshots.read_snapshots(spark, path).collect()) == ["c1", "c2"]


def test_result_tables(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "repo_id int, x string")
    results.write_results(df, path)
    results.write_results(df, path)
    assert spark.read.parquet(path).count() == 4
    assert spark.read.parquet(path).where("repo_id = 1").count() == 2


def test_workspaces(spark):
    data = [("r", "package.json", '{"workspaces":{"packages":["packages/*"]}}'), ("r", "pnpm-workspace.yaml", "packages:\n  - 'libs/**'\n  # note\n  - tools/pkg-*\nother: 1\n  - no"),
            ("r", "packages/a/package.json", "{}"), ("r", "packages/a/b/package.json", "{}"), ("r", "libs/x/y/package.json", "{}"),
            ("r", "tools/pkg-1/package.json", "{}"), ("r", "tools/other/package.json", "{}"), ("r", "libs/node_modules/z/package.json", "{}")]
    df = spark.createDataFrame(data, "repo_id string, path string, content string")
    patterns = documents.workspace_patterns(df)
    assert sorted(r.pattern for r in patterns.collect()) == ["libs/**", "packages/*", "tools/pkg-*"]
    assert sorted(r.directory for r in documents.match_workspaces(df, patterns).collect()) == ["libs/x/y", "packages/a", "tools/pkg-1"]


def test_role_overrides(spark):
    roles = spark.createDataFrame([("r", "lib/a.ts", ["x"]), ("s", "lib/a.ts", [])], "repo_id string, path string, roles array<string>")
    over = spark.createDataFrame([("r", "lib/**", ["g"]), ("r", "gone.ts", ["e"])], "repo_id string, pattern string, roles array<string>")
    got = sorted((r.repo_id, r.path, tuple(r.roles)) for r in shape.override_roles(roles, over).collect())
    assert got == [("r", "gone.ts", ("e",)), ("r", "lib/a.ts", ("g", "x")), ("s", "lib/a.ts", ())]


def test_custom_check_takes_part(spark):
    @scan.check("my-check", ("files",), "security")
    def mine(facts):
        return facts.files.select("repo_id", F.lit("high").alias("severity"), F.col("path").alias("file_path"),
                                  F.lit(None).cast("int").alias("line"), F.lit("c").alias("category"), F.lit("m").alias("message"))

    try:
        df = spark.createDataFrame([("r", "a.ts", "x")], "repo_id string, path string, content string")
        found = scan.run_checks(scan.Facts(files=df), only=("my-check",))
        assert [(r.module_id, len(r.fingerprint)) for r in found.collect()] == [("my-check", 64)]
        assert scan.module_results(found, df, ("my-check",)).first().score == 90
    finally:
        del scan.CHECKS["my-check"]


def test_states_and_scores_of_a_scan(spark):
    files = spark.createDataFrame([
        ("a", "src/x.ts", "const x: any = 1;\nconst password = 1;"), ("a", "tsconfig.json", '{"compilerOptions": {"strict": true}}'),
        ("b", "main.py", "x = 1"),
    ], "repo_id string, path string, content string")
    lines = spark.createDataFrame([("a", "src/x.ts", 1, "const x: any = 1;"), ("b", "main.py", 1, "x = 1")], "repo_id string, path string, line_no int, text string")
    deps = spark.createDataFrame([("a", "p", "1.2.0")], "repo_id string, name string, current string")
    known = spark.createDataFrame([("p", "ADV-1", "high", "t", "", "1.0.0", "2.0.0", None)], "name string, advisory_id string, severity string, title string, url string, lo string, hi string, fixed string")
    kinds = spark.createDataFrame([("a", "web-app"), ("b", "library")], "repo_id string, archetype string")
    facts = scan.Facts(files=files, lines=lines, deps=deps, advisories=known)
    modules = ("type-safety", "security", "complexity", "api-health", "git-health")
    found = scan.run_checks(facts, modules)
    rows = scan.module_results(found, files, modules, facts, kinds)
    got = {(r.repo_id, r.module_id): (r.state, r.score, r.confidence) for r in rows.collect()}
    flags = files.where("path = 'tsconfig.json'").select(F.size(shape.strict_flags(F.col("content")))).first()[0]
    assert got["a", "type-safety"] == ("completed", 100 - 2 - 5 * flags, 1.0)
    assert got["a", "security"] == ("completed", 90, 1.0)
    assert got["a", "complexity"][0] == "completed" and got["a", "complexity"][2] == 0.7
    for module in ("type-safety", "security", "complexity"):
        assert got["b", module] == ("insufficient_evidence", -1, 0.0)
    assert got["a", "api-health"] == ("unavailable", -1, 0.0) and got["b", "api-health"] == ("not_applicable", -1, 0.0)
    assert got["a", "git-health"] == got["b", "git-health"] == ("unavailable", -1, 0.0)
    parts = [(got["a", "type-safety"], 1.05), (got["a", "security"], 1.0), (got["a", "complexity"], 1.05)]
    mean = sum(score * sure * w for (_, score, sure), w in parts) / sum(sure * w for (_, _, sure), w in parts)
    scores = {r.repo_id: r.overall_score for r in scan.weighted_scores(rows, kinds).collect()}
    assert scores == {"a": int(mean + 0.5), "b": 0}
    assert rows.join(found.groupBy("repo_id", "module_id").count(), ["repo_id", "module_id"]).where("findings <> count").count() == 0
    empty = scan.module_results(found.limit(0), files.limit(0), modules, facts, kinds)
    assert empty.count() == 0


def test_compliance_check_reads_every_line(spark):
    """As the query phi_rules does: whatever a file's language, and inside skipped folders."""
    from repohealth.operators import rules

    paths = ["src/a.ts", "src/b.js", "lib/c.py", "docs/d.md", "node_modules/p/e.ts", "Makefile"]
    files = spark.createDataFrame([("r", p, "") for p in paths], "repo_id string, path string, content string")
    lines = spark.createDataFrame([("r", p, 1, "let ssn = 1") for p in paths] + [("r", "lib/c.py", 2, "plain")], "repo_id string, path string, line_no int, text string")
    found = scan.run_checks(scan.Facts(files=files, lines=lines), ("compliance-hipaa",))
    got = sorted((r.file_path, r.line, r.severity) for r in found.collect())
    assert got == sorted((r.path, r.line_no, r.severity) for r in rules.match_rules(lines, rules.phi_rules()).collect())
    assert got == sorted((p, 1, "high") for p in paths)


def test_results_count_compliance_findings_of_all_files(spark):
    files = spark.createDataFrame([("a", "src/a.ts", ""), ("b", "main.py", ""), ("c", "src/c.ts", "")], "repo_id string, path string, content string")
    lines = spark.createDataFrame([("a", "src/a.ts", 1, "let ssn = 1"), ("a", "docs/a.md", 1, "res.send(mrn)"), ("b", "main.py", 1, "throw new Error(phi)"), ("c", "src/c.ts", 1, "plain")],
                                  "repo_id string, path string, line_no int, text string")
    facts, modules = scan.Facts(files=files, lines=lines), ("compliance-hipaa",)
    rows = scan.module_results(scan.run_checks(facts, modules), files, modules, facts).collect()
    assert {r.repo_id: (r.state, r.score, r.findings) for r in rows} == {"a": ("completed", 70, 2), "b": ("completed", 95, 1), "c": ("completed", 100, 0)}


def stream_of(spark, df, folder, parts):
    """``df`` as a file stream of ``parts`` ordered files (column part)."""
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(writer, name, checkpoint):
    q = writer.queryName(name).option("checkpointLocation", str(checkpoint)).start()
    q.processAllAvailable()
    q.stop()


def test_snapshot_stream_equals_batch(spark, tmp_path, rows):
    """Shuffled, repeated and late micro-batches give the deltas of the whole table."""
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    data = [(r, r * 100 + i, start + dt.timedelta(hours=i // 2), rng.randrange(1000) / 10) for r in (1, 2) for i in range(24)]
    df = spark.createDataFrame(data, "repo_id long, snapshot_id long, ts timestamp_ntz, overall double")
    shuffled = sorted(data, key=lambda x: (x[2] - start).total_seconds() / 3600 + rng.random() * 4)
    sent = [(*x, k // 16) for k, x in enumerate(shuffled)]
    sent += [(*x[:4], min(x[4] + 1, 2)) for x in rng.sample(sent, 8)] + [(3, 999, start + dt.timedelta(days=9), 1.0, 3)]
    parts = spark.createDataFrame(sent, "repo_id long, snapshot_id long, ts timestamp_ntz, overall double, part int")
    out = jobs.snapshot_delta_stream(stream_of(spark, parts, tmp_path / "in", 4), "12 hours")
    drain(out.writeStream.format("memory").outputMode("append"), "deltas", tmp_path / "ck")
    want = H.snapshot_deltas(df).select("repo_id", "snapshot_id", "overall", "delta")
    assert rows(spark.table("deltas")) == rows(want)


def test_progress_stream_equals_batch(spark, tmp_path, rows):
    rng = random.Random(2)
    data = [(rng.randrange(3), rng.choice("ab"), dt.datetime(2024, 1, 1, 0, rng.randrange(60)), i, rng.randrange(100), "running", i % 2) for i in range(40)]
    df = spark.createDataFrame(data, "scan_id int, module_id string, ts timestamp_ntz, seq int, pct int, status string, part int")
    out = jobs.latest_progress(stream_of(spark, df, tmp_path / "in", 2))
    drain(out.writeStream.format("memory").outputMode("complete"), "progress", tmp_path / "ck")
    assert rows(spark.table("progress")) == rows(jobs.latest_progress(df))


def test_batch_counters_stream(spark, tmp_path):
    """Old and repeated events change nothing; a scan that is silent for long leaves no state."""
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    data = [(1, "a", at(1), 1, "running", 0), (1, "a", at(2), 5, "completed", 0), (1, "b", at(3), 9, "failed", 1), (1, "b", at(2), 4, "running", 1), (1, "a", at(2), 5, "completed", 1),
            (2, "a", dt.datetime(2024, 1, 3), 1, "running", 2), (2, "b", dt.datetime(2024, 1, 3), 1, "completed", 3), (1, "c", dt.datetime(2024, 1, 3), 1, "running", 4)]
    df = spark.createDataFrame(data, "scan_id long, module_id string, ts timestamp_ntz, seq int, status string, part int")
    out = jobs.batch_progress_stream(stream_of(spark, df, tmp_path / "in", 5), forget_ms=3_600_000)
    drain(out.writeStream.format("memory").outputMode("update"), "counters", tmp_path / "ck")
    got = [tuple(r) for r in spark.table("counters").collect()]
    assert got[:2] == [(1, 1, 1, 0), (1, 2, 2, 1)]
    # scan 1 has been forgotten when it comes back with a third module
    assert sorted(got[2:]) == [(1, 1, 0, 0), (2, 1, 0, 0), (2, 2, 1, 0)]


def test_incremental_reconcile_equals_batch(spark, tmp_path, rows):
    scans = spark.createDataFrame([(s, r, dt.datetime(2024, 1, s), "completed", 1) for r in (1, 2) for s in ((1, 3, 5) if r == 1 else (2, 4))],
                                  "scan_id long, repo_id long, created_at timestamp_ntz, status string, overall_score int")
    found = spark.createDataFrame([(s, "m", "p", "c", m, "new") for s, ms in ((1, "xy"), (3, "x"), (5, "yz"), (2, "q"), (4, "q")) for m in ms],
                                  "scan_id long, module_id string, file_path string, category string, message string, status string")
    done = spark.createDataFrame([(1, 5, 0), (2, 4, 1)], "repo_id long, scan_id long, part int")
    out = str(tmp_path / "out")
    handle = jobs.incremental_reconcile(lambda: scans, lambda: found, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    drain(stream_of(spark, done, tmp_path / "in", 2).writeStream.foreachBatch(handle), "reconcile", tmp_path / "ck")
    cols = ["repo_id", "scan_id", "message", "status"]
    ranked = H.ranked_findings(scans, found, 3)
    counts = H.latest_scans(scans, 3).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    want = H.reconcile(ranked, counts).unionByName(H.tombstones(ranked, H.latest_scans(scans, 3)))
    assert rows(spark.read.parquet(out).select(*cols)) == rows(want.select(*cols))
    assert ("y", "regressed") in {(r.message, r.status) for r in want.collect()}


def test_rows_of_narrow_tables_are_dealt_out_before_their_texts_are_made(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    for view in ("v_code_files", "v_sliced_files", "v_config_docs"):
        assert "REPARTITION_BY_COL" in tables[view]._jdf.queryExecution().executedPlan().toString()
