"""Parsers of external tools' reports and logs: JSON documents, JSON lines, diagnostics, coverage and test output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repohealth.functions.scalars import clamp, count_if, exact_avg, half_up, semver, strict_json, strip
from repohealth.functions.severity import diagnostic_severity, tool_severity
from repohealth.operators.ordered import block, first_per_key, last_seen, top_per_key
from repohealth.session import cut_lineage

AUDIT = (
    "vulnerabilities map<string,struct<severity:string,via:array<string>,fixAvailable:string>>, "
    "advisories map<string,struct<severity:string,title:string,module_name:string,url:string>>"
)


def _or_none(text: Column) -> Column:
    return F.when(text != "", text)


def parse_audit(docs: DataFrame) -> DataFrame:
    """Findings of package audit reports, of the current shape or, without it, the older advisory map."""
    parsed = docs.where(strict_json(F.col("doc")).isNotNull()).select("doc_id", F.from_json("doc", AUDIT).alias("a"))
    now = parsed.select("doc_id", F.explode("a.vulnerabilities").alias("package", "v"))
    # Entries of via are package names or advisory objects; an object arrives as its JSON text.
    info = F.from_json(F.get(F.filter("v.via", lambda x: x.startswith("{")), F.lit(0)), "title string, url string")
    new = now.select(
        "doc_id", "package", tool_severity("npm", F.col("v.severity")).alias("severity"),
        F.coalesce(info["title"], F.concat(F.lit("Vulnerability in "), "package")).alias("title"),
        F.coalesce(info["url"], F.lit("")).alias("url"),
        F.coalesce(~F.col("v.fixAvailable").isin("false", "null", ""), F.lit(False)).alias("fixable"),
    )
    old = parsed.where(F.col("a.vulnerabilities").isNull()).select("doc_id", F.explode("a.advisories").alias("id", "v")).select(
        "doc_id", F.coalesce("v.module_name", F.lit("unknown")).alias("package"),
        tool_severity("npm", F.col("v.severity")).alias("severity"),
        F.coalesce("v.title", F.lit("Vulnerability")).alias("title"), F.coalesce("v.url", F.lit("")).alias("url"),
        F.lit(False).alias("fixable"),
    )
    return new.unionByName(old)


COMPILER = (
    "reason string, message struct<level:string,message:string,code:struct<code:string>,rendered:string,"
    "spans:array<struct<file_name:string,line_start:int>>>"
)


def parse_compiler_lines(lines: DataFrame) -> DataFrame:
    """Warnings and errors of JSON compiler lines that point at a place; the first span is the place."""
    rows = lines.select("run_id", "line_no", F.from_json("text", COMPILER).alias("j"))
    level = F.col("j.message.level")
    kept = rows.where(
        (F.col("j.reason") == "compiler-message") & level.isin("warning", "error") & (F.size("j.message.spans") > 0)
    )
    code = F.col("j.message.code.code")
    span = F.get("j.message.spans", F.lit(0))
    return kept.select(
        "run_id", "line_no", tool_severity("clippy", level).alias("severity"), span["file_name"].alias("file"),
        span["line_start"].alias("line"),
        F.concat("j.message.message", F.when(code.isNotNull(), F.concat(F.lit(" ["), code, F.lit("]"))).otherwise("")).alias("message"),
    )


def parse_module_list(docs: DataFrame) -> DataFrame:
    """Modules of concatenated JSON objects (no array around them) with their available update."""
    text = F.concat(F.lit("["), F.regexp_replace("doc", r"\}\s*\{", "},{"), F.lit("]"))
    schema = "array<struct<Path:string,Version:string,Main:boolean,Update:struct<Version:string>>>"
    rows = docs.select("doc_id", F.inline(F.from_json(text, schema)))
    return rows.where(~F.coalesce(F.col("Main"), F.lit(False))).select(
        "doc_id", F.col("Path").alias("name"), F.coalesce("Version", F.lit("unknown")).alias("current"),
        F.col("Update.Version").alias("latest"),
    )


VULN = (
    "osv struct<id:string,summary:string,database_specific:struct<severity:string>>, "
    "modules array<struct<path:string,fixed_version:string,packages:array<struct<callstacks:array<string>>>>>"
)


def parse_vulnerability_lines(docs: DataFrame) -> DataFrame:
    """Vulnerabilities of a report that is one object, or lines of objects of which those with an osv count."""
    whole = strict_json(F.col("doc"))
    single = docs.where(whole.isNotNull()).select(
        "doc_id", F.explode(F.from_json("doc", f"vulns array<struct<{_inner(VULN)}>>")["vulns"]).alias("v")
    )
    lines = docs.where(whole.isNull()).select("doc_id", F.explode(F.split("doc", "\n")).alias("text"))
    listed = lines.select("doc_id", F.from_json(strip(F.col("text")), VULN).alias("v")).where(F.col("v.osv").isNotNull())
    both = single.unionByName(listed)
    calls = F.exists(
        F.coalesce("v.modules", F.array().cast(f"array<{_struct(VULN, 'modules')}>")),
        lambda m: F.exists(m["packages"], lambda p: F.size(p["callstacks"]) > 0),
    )
    module = F.get("v.modules", F.lit(0))
    return both.select(
        "doc_id", F.coalesce("v.osv.id", F.lit("unknown")).alias("vuln_id"),
        tool_severity("osv", F.col("v.osv.database_specific.severity"), F.coalesce(calls, F.lit(False))).alias("severity"),
        F.coalesce("v.osv.summary", F.lit("Go vulnerability")).alias("summary"),
        F.coalesce(module["path"], F.lit("unknown")).alias("module"), module["fixed_version"].alias("fixed_version"),
    )


def _inner(ddl: str) -> str:
    """Top-level fields of a DDL list as members of a struct type."""
    return ", ".join(part.strip().replace(" ", ":", 1) for part in ddl.split(", "))


def _struct(ddl: str, field: str) -> str:
    part = next(p.strip() for p in ddl.split(", ") if p.strip().startswith(field + " "))
    return part.split(" ", 1)[1][len("array<"):-1]


def parse_lint(docs: DataFrame) -> DataFrame:
    """Messages of a linter's JSON; a document that does not parse gives none."""
    schema = "array<struct<filePath:string,messages:array<struct<line:int,severity:int,message:string,ruleId:string>>>>"
    files = docs.where(strict_json(F.col("doc")).isNotNull()).select("run_id", F.inline(F.from_json("doc", schema)))
    rows = files.select("run_id", F.col("filePath").alias("file"), F.explode("messages").alias("m"))
    return rows.select(
        "run_id", "file", "m.line", F.when(F.col("m.severity") == 2, "medium").otherwise("low").alias("severity"),
        F.when(F.col("m.ruleId").isNotNull(), F.concat("m.message", F.lit(" ("), "m.ruleId", F.lit(")"))).otherwise(F.col("m.message")).alias("message"),
    )


def parse_lcov(lines: DataFrame) -> DataFrame:
    """Line coverage per file of LCOV reports; a record without its end is dropped, no lines found is 0 %.

    A line belongs to the last SF line before it. That look-back is bucketed by
    line number, so one huge report does not become one task.
    """
    text = strip(F.col("text"))
    start = F.when(text.startswith("SF:"), F.col("line_no"))
    tagged = last_seen(lines, ["report_id"], ["line_no"], block("line_no"), start, "record")

    def value(prefix: str) -> Column:
        number = F.regexp_extract(text, rf"^{prefix}:\s*([0-9]+)", 1)
        return F.when(text.startswith(f"{prefix}:"), F.coalesce(number.try_cast("int"), F.lit(0)))

    # A record ends at its first end_of_record; numbers after it belong to nothing.
    records = tagged.where(F.col("record").isNotNull()).groupBy("report_id", "record").agg(
        F.max(F.when(text.startswith("SF:"), F.substr(text, F.lit(4)))).alias("file"),
        F.max(value("LF")).alias("found"), F.max(value("LH")).alias("hit"),
        F.bool_or(text == "end_of_record").alias("_closed"),
    ).where("_closed AND file <> ''")
    found, hit = F.coalesce("found", F.lit(0)), F.coalesce("hit", F.lit(0))
    pct = F.when(found > 0, hit / found * 100).otherwise(F.lit(0.0))
    # A file reported twice counts once, with its last record.
    rows = records.select("report_id", "file", "record", found.alias("found"), hit.alias("hit"), pct.alias("pct"))
    return first_per_key(rows, ["report_id", "file"], [-F.col("record")]).drop("record")


def coverage_severity(pct: Column) -> Column:
    return F.when(pct == 0, "critical").when(pct < 20, "high").when(pct < 50, "medium").otherwise("low")


COVERAGE = "map<string,struct<lines:struct<total:bigint,covered:bigint,pct:double>>>"


def parse_coverage_summary(docs: DataFrame) -> DataFrame:
    """Line coverage per file of a coverage summary; the row 'total' is the report's own sum."""
    return docs.select("report_id", F.explode(F.from_json("doc", COVERAGE)).alias("file", "c")).select(
        "report_id", "file", "c.lines.total", "c.lines.covered", "c.lines.pct"
    )


def coverage_score(rows: DataFrame) -> DataFrame:
    """Score of a summary: its total row when present, else covered over all lines; and files below one half."""
    real = F.col("file") != "total"
    out = rows.groupBy("report_id").agg(
        F.max(F.when(~real, F.col("pct"))).alias("_total"),
        F.sum(F.when(real, F.col("covered"))).alias("_covered"), F.sum(F.when(real, F.col("total"))).alias("_lines"),
        count_if(real).alias("files"), count_if(real & (F.col("pct") < 50)).alias("below_half"),
    )
    computed = F.when(F.col("_lines") > 0, F.col("_covered") / F.col("_lines") * 100).otherwise(F.lit(0.0))
    return out.select("report_id", "files", "below_half", half_up(clamp(F.coalesce("_total", computed))).cast("int").alias("score"))


def lcov_score(files: DataFrame) -> DataFrame:
    """Mean of the files' percentages."""
    return files.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("files"), count_if(F.col("pct") < 50).alias("below_half"),
        half_up(clamp(exact_avg(F.col("pct")))).cast("int").alias("score"),
    )


PLACE = r"^(.+?):([0-9]+):([0-9]+):\s*(.+)$"
PAREN = r"^(.+)\(([0-9]+),([0-9]+)\):\s*(.+)$"
HEADING = r"(?i)^(error|warning)(\[E[0-9]+\])?:\s*(.+)$"
VET = r"^(.+?):([0-9]+):(?:[0-9]+:)?\s*(.+)$"


def parse_diagnostics(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings of command output; a failed run without any recognised line gives one finding of its first lines.

    ``runs`` is (run_id, exit_code). Only the first eight lines of unrecognised
    failed runs are brought together.
    """
    text = strip(F.col("text"))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    place, paren, heading = (F.rlike(text, F.lit(p)) for p in (PLACE, PAREN, HEADING))
    found = F.when(place, F.struct(
        part(PLACE, 1).alias("file"), part(PLACE, 2).cast("int").alias("line"),
        diagnostic_severity(part(PLACE, 4)).alias("severity"), part(PLACE, 4).alias("message"),
    )).when(paren, F.struct(
        part(PAREN, 1).alias("file"), part(PAREN, 2).cast("int").alias("line"), F.lit("high").alias("severity"),
        part(PAREN, 4).alias("message"),
    )).when(heading, F.struct(
        F.lit("(command output)").alias("file"), F.lit(None).cast("int").alias("line"),
        F.when(F.rlike(text, F.lit("(?i)^error")), "high").otherwise("medium").alias("severity"), text.alias("message"),
    ))
    structured = lines.select("run_id", F.explode(F.array_compact(F.array(found))).alias("f")).select("run_id", "f.*")
    known = F.coalesce(place, F.lit(False)) | F.coalesce(paren, F.lit(False)) | F.coalesce(heading, F.lit(False))
    facts = lines.groupBy("run_id").agg(F.bool_or(known).alias("_known"), F.min(F.when(text != "", F.col("line_no"))).alias("_start"))
    failed = cut_lineage(runs.where(F.col("exit_code") != 0).select("run_id", "exit_code").join(facts, "run_id", "left").where(
        ~F.coalesce("_known", F.lit(False))).select("run_id", "exit_code", "_start"))
    # one small row for each run is held in memory, lines pass by it unsorted
    starts = failed.where("_start IS NOT NULL").select("run_id", "_start").hint("shuffle_hash")
    mine = lines.select("run_id", "line_no", "text").join(starts, "run_id").where(F.col("line_no") >= F.col("_start"))
    said = top_per_key(mine, ["run_id"], [F.col("line_no"), F.col("text")], 8).groupBy("run_id").agg(strip(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), " ")).alias("message"))
    silent = F.concat(F.lit("Command exited with code "), F.col("exit_code").cast("string"), F.lit(" (no output captured)"))
    fallback = failed.join(said, "run_id", "left").select(
        "run_id", F.lit("(command output)").alias("file"), F.lit(None).cast("int").alias("line"),
        F.lit("high").alias("severity"), F.coalesce("message", silent).alias("message"),
    )
    return structured.unionByName(fallback)


def parse_vet(lines: DataFrame, loose: bool = False) -> DataFrame:
    """file:line[:col]: message lines; in loose mode every other non-blank line names an unused function."""
    text = strip(F.col("text"))
    hit = F.rlike(text, F.lit(VET))
    rows = lines.where(text != "") if loose else lines.where(hit)
    return rows.select(
        "run_id", F.when(hit, F.regexp_extract(text, VET, 1)).otherwise("unknown").alias("file"),
        F.when(hit, F.regexp_extract(text, VET, 2).cast("int")).alias("line"),
        F.when(hit, F.regexp_extract(text, VET, 3)).otherwise(F.concat(F.lit("Unused function: "), text)).alias("message"),
    )


UPDATING = r"Updating\s+(\S+)\s+v(\S+)\s+->\s+v(\S+)"
UNCHANGED = r"Unchanged\s+(\S+)\s+v(\S+)\s+\(available:\s+v([^\s)]+)\)"


def parse_update_log(lines: DataFrame) -> DataFrame:
    """Available updates of a dependency log, those held back marked as pinned."""
    text = F.col("text")
    pinned = F.rlike(text, F.lit(UNCHANGED))
    rows = lines.where(pinned | F.rlike(text, F.lit(UPDATING)))

    def part(group: int) -> Column:
        return F.when(pinned, F.regexp_extract(text, UNCHANGED, group)).otherwise(F.regexp_extract(text, UPDATING, group))

    out = rows.select("run_id", part(1).alias("name"), part(2).alias("current"), part(3).alias("latest"), pinned.alias("pinned"))
    return out.withColumn("severity", cargo_severity(F.col("current"), F.col("latest")))


def cargo_severity(current: Column, latest: Column) -> Column:
    return cargo_step(semver(current), semver(latest))


def cargo_step(a: Column, b: Column) -> Column:
    """Severity of the step between two parsed versions."""
    return F.when(a[0] != b[0], "high").when(a[1] != b[1], "medium").otherwise("low")


GO_COVERAGE = r"coverage:\s+([0-9.]+)%\s+of\s+statements"
RUST_RESULT = r"test result: (\w+)\.\s+([0-9]+)\s+passed;\s+([0-9]+)\s+failed;\s+([0-9]+)\s+ignored"


def parse_test_log(lines: DataFrame) -> DataFrame:
    """Coverage, missing tests and failures of a run, and the counts of its first result line."""
    text = F.col("text")
    pct = F.regexp_extract(text, GO_COVERAGE, 1).try_cast("double")
    result = F.rlike(text, F.lit(RUST_RESULT))

    def first(group: int) -> Column:
        return F.min_by(F.regexp_extract(text, RUST_RESULT, group).try_cast("int"), F.when(result, F.struct("line_no", "text")))

    return lines.groupBy("run_id").agg(
        F.count(pct).alias("packages"), exact_avg(pct).alias("coverage"),
        count_if(F.contains(text, F.lit("[no test files]"))).alias("no_test_files"),
        count_if(text.startswith("--- FAIL:")).alias("failures"),
        first(2).alias("passed"), first(3).alias("failed"), first(4).alias("ignored"),
    )


def test_scores(logs: DataFrame) -> DataFrame:
    """Score of Go coverage (0 without any) and of a Rust test result (0 without tests, 50 when some fail)."""
    go = F.coalesce(half_up(clamp(F.col("coverage"))), F.lit(0)).cast("int")
    rust = F.when(F.col("passed").isNull(), 0).when(F.col("failed") > 0, 50).otherwise(100)
    return logs.select("run_id", go.alias("go_score"), rust.alias("rust_score"))


def execution_result(runs: DataFrame) -> DataFrame:
    """Result of build, lint, typecheck and test runs; a NULL command means the check does not apply."""
    none = F.col("command").isNull()
    return runs.select(
        "run_id", "module_id",
        F.when(none, -1).when(F.col("exit_code") == 0, 100).otherwise(0).alias("score"),
        F.when(none, 0.0).otherwise(1.0).alias("confidence"),
        F.when(none, "not_applicable").otherwise("completed").alias("state"),
    )
