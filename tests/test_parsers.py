from pyspark.sql import functions as F

from repohealth.functions import scalars as S
from repohealth.operators import deps, rules, shape
from repohealth.operators.checks import validate_config
from repohealth.sources import tool_reports as R


def values(spark, data, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*cols).collect()]


def diag(spark, texts, code):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "run_id int, line_no int, text string")
    runs = spark.createDataFrame([(1, code)], "run_id int, exit_code int")
    return sorted(tuple(r)[1:] for r in R.parse_diagnostics(lines, runs).collect())


def test_diagnostics(spark):
    assert diag(spark, ["src/main.rs:42:5: error: mismatched types"], 1) == [("src/main.rs", 42, "high", "error: mismatched types")]
    assert diag(spark, ["a.c:1:2: warning: unused"], 1) == [("a.c", 1, "medium", "warning: unused")]
    assert diag(spark, ["src/b.ts(7,3): error TS1: bad"], 2) == [("src/b.ts", 7, "high", "error TS1: bad")]
    assert diag(spark, ["error[E0308]: mismatched"], 1) == [("(command output)", None, "high", "error[E0308]: mismatched")]
    assert diag(spark, ["", "boom", "again"], 1) == [("(command output)", None, "high", "boom again")]
    assert diag(spark, ["", " "], 137) == [("(command output)", None, "high", "Command exited with code 137 (no output captured)")]
    assert diag(spark, ["all fine"], 0) == []


def test_diagnostics_of_many_runs_join_lines_without_sorting_them(spark):
    lines = spark.createDataFrame(
        [(1, 0, "a.c:1:2: warning: unused"), (1, 1, "boom"), (2, 0, " "), (2, 1, "x"), (2, 2, ""), (3, 0, None), (3, 1, "quiet"), (5, 0, "fine"), (None, 0, "lost")], "run_id int, line_no long, text string")
    runs = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 9), (4, 7), (5, 0), (None, 2)], "run_id int, exit_code int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        found = R.parse_diagnostics(lines, runs)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.run_id or 0, r.message) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    twice = (2, "x x")
    silent = "Command exited with code {} (no output captured)".format
    assert got == [(0, silent(2)), (1, "warning: unused"), twice, twice, (3, "quiet"), (4, silent(7))]
    assert plan.count("ShuffledHashJoin") == 1 and plan.count("SortMergeJoin") == 1


def test_lcov(spark):
    text = ["SF:a.ts", "LF:10", "LH:5", "end_of_record", "SF:b.ts", "LF:0", "LH:0", "end_of_record", "SF:c.ts", "LF:4", "LH:4"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "report_id int, line_no long, text string")
    assert {(r.file, r.pct) for r in R.parse_lcov(lines).collect()} == {("a.ts", 50.0), ("b.ts", 0.0)}


def test_semver_severity(spark):
    data = [("1.2.3", "3.0.0"), ("1.2.3", "2.0.0"), ("1.2.3", "1.3.0"), ("1.2.3", "1.2.4"), ("^1.2", "1.2.0")]
    got = values(spark, data, "a string, b string", deps.npm_severity(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == ["high", "medium", "low", "info", "info"]


def test_rounding_and_tokens(spark):
    got = values(spark, [(-2.5,), (2.5,), (0.4,)], "x double", S.half_up(F.col("x")))
    assert [g[0] for g in got] == [-2, 3, 0]
    got = values(spark, [("",), ("a",), ("abcd",), ("abcde",)], "t string", S.estimate_tokens(F.col("t")))
    assert [g[0] for g in got] == [0, 1, 1, 2]


def test_strict_json(spark):
    data = [('{"a":1}',), ('{"a":1} oops',), ("1,2",), ("",), (None,)]
    assert [g[0] for g in values(spark, data, "t string", S.strict_json(F.col("t")).isNotNull())] == [True, False, False, False, False]


def test_word_edges_are_ascii(spark):
    data = [("éla la",), ("voilà",), ("lake",), ("a warning",), ("warnings",)]
    got = values(spark, data, "t string", S.matches(F.col("t"), r"\bla\b"), S.matches(F.col("t"), r"(?i)\bwarn(ing)?\b"))
    assert got == [(True, False), (False, False), (False, False), (False, True), (False, False)]


def test_secrets(spark):
    texts = ["-----BEGIN RSA PRIVATE" + " KEY-----", "AK" + "IA" + "A" * 16, "postgres://some:pw@h/db", "PASSWORD = 'abcdefgh'", "plain"]
    lines = spark.createDataFrame([("r", p, i, x) for p in ("src/a.ts", "src/__fixtures__/a.ts", "node_modules/x.js") for i, x in enumerate(texts)],
                                  "repo_id string, path string, line_no int, text string")
    got = sorted((r.path, r.line_no, r.severity) for r in rules.secrets_scan(lines).collect())
    assert got == [("src/a.ts", 0, "critical"), ("src/a.ts", 1, "high"), ("src/a.ts", 2, "high"), ("src/a.ts", 3, "medium")]


def test_literals_do_not_change_hits(spark):
    from dataclasses import replace

    phi = rules.phi_rules()
    texts = [f"{call}{name})" for _, call, _, _ in rules.PHI_TEMPLATES for name in ("ssn", "mrn", "xssn")] + ["let dob = 1", "x.find({ patient: 1 })"]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "n int, text string")
    fast = {(r.n, r.rule_id) for r in rules.match_rules(lines, phi).collect()}
    slow = {(r.n, r.rule_id) for r in rules.match_rules(lines, [replace(p, literals=()) for p in phi]).collect()}
    assert fast == slow and len(phi) == 102 and fast


def test_strict_flags(spark):
    docs = [('{"compilerOptions":{"strict":true}} // x',), ("nope",), ('{"compilerOptions":{"noImplicitAny":true}}',)]
    got = [g[0] for g in values(spark, docs, "t string", shape.strict_flags(F.col("t")))]
    assert got[0] == ["noImplicitReturns"] and len(got[1]) == 5 and "noImplicitAny" not in got[2]


def test_config_documents(spark):
    docs = [(1, '{"commands":{"typecheck":null,"test":"npm t"}}'), (2, '{"commands":{"test":42}}'), (3, "{"), (4, '{"aiTokenBudget":0.5,"tier":"gold"}'),
            (5, '{"modules":{"a":1},"ignore":["x",null],"classify":{"p":["r",2]},"auditPrompts":["t"]}'), (6, '{"modules":null,"ignore":"x","commands":[]}'),
            (7, '{"modules":{"a":true},"ignore":[],"classify":{"p":"r","q":["s"]},"auditPrompts":{"m":"t"},"commands":{"ci":null,"other":1}}')]
    df = spark.createDataFrame(docs, "repo_id int, doc string")
    got = sorted((r.repo_id, r.violation) for r in validate_config(df).collect())
    assert got == [(2, "command is neither text nor null"), (3, "invalid JSON"), (4, "budget not a positive integer"), (4, "unknown tier"),
                   (5, "ignore is not a list of texts"), (5, "module switch is not a boolean"), (5, "prompt is not a text"), (5, "role is neither text nor a list of texts"),
                   (6, "command is neither text nor null"), (6, "ignore is not a list of texts"), (6, "module switch is not a boolean")]


def test_repo_refs(spark):
    data = [("https://github.com/o/r.git",), ("github.com/o/r/",), ("o/r",), ("https://x.com/o/r",)]
    assert [g[0] for g in values(spark, data, "t string", S.repo_ref(F.col("t")))] == ["o/r", "o/r", "o/r", None]


def test_archetypes(spark):
    files = [
        ("lib", "package.json", '{"main":"x.js"}'), ("lib", "src/a.ts", ""), ("proto", "notes.txt", ""),
        ("web", "package.json", '{"dependencies":{"next":"1"}}'), ("web", "app/page.tsx", ""), ("rust", "Cargo.toml", "[[bin]]"),
        ("comp", "audit/a", ""), ("comp", "security/b", ""), ("agent", "prompts/a.md", ""),
    ]
    df = spark.createDataFrame(files, "repo_id string, path string, content string")
    got = {r.repo_id: r.archetype for r in shape.archetype(shape.repo_traits(df)).collect()}
    assert got == {"lib": "library", "proto": "prototype", "web": "web-app", "rust": "cli", "comp": "compliance-sensitive", "agent": "agent-tooling"}


def test_resolve_imports(spark):
    from repohealth.operators import code

    files = [("r", "a/x.ts", "import { q as z, w } from './y'\nimport '../b'\nimport x from '@/c'\nimport s from './x'\nimport up from '../../../out'"),
             ("r", "a/y.tsx", ""), ("r", "a/y/index.ts", ""), ("r", "b/index.js", ""), ("r", "c.mjs", ""), ("r", "c/index.ts", "")]
    df = spark.createDataFrame(files, "repo_id string, path string, content string")
    got = {(r.specifier, r.target, tuple(r.symbols)) for r in code.resolve_imports(code.extract_imports(df), df).collect()}
    assert got == {("./y", "a/y.tsx", ("q", "w")), ("../b", "b/index.js", ()), ("@/c", "c.mjs", ())}


def test_tabs_carriage_returns_and_lines_are_stripped(spark):
    from repohealth.operators import code, shape
    from repohealth.sources import tool_reports

    text = 'import {\n\taa,\r\n\tbb as cc,\n} from "./m"\nexport {\n  xx,\n\tyy\n}\n'
    files = spark.createDataFrame([("r", "a.ts", text), ("r", "m.ts", "export const aa = 1"), ("r", "lib/m.ts", 'import "./m"'), ("r", "lib/m/index.ts", "")], "repo_id string, path string, content string")
    imports = {(r.path, r.specifier): r.symbols for r in code.extract_imports(files).collect()}
    assert imports["a.ts", "./m"] == ["aa", "bb"]
    assert {r.symbol for r in code.extract_exports(files).where("path = 'a.ts'").collect()} == {"xx", "yy"}
    resolved = {(r.path, r.target) for r in code.resolve_imports(code.extract_imports(files), files).collect()}
    assert resolved == {("a.ts", "m.ts")}  # the import of lib/m.ts means itself
    lcov = ["SF:a.ts\r", "\tLF:4\r", "LH:2\r", "end_of_record\r"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(lcov)], "report_id long, line_no long, text string")
    assert tool_reports.parse_lcov(lines).count() == 1
    barrel = spark.createDataFrame([("lib/index.ts", '\texport * from "./a";\r\n\r\n')], "path string, content string")
    assert [r[0] for r in barrel.select(shape.is_barrel(F.col("path"), F.col("content"))).collect()] == [True]


def test_phi_rules_query_reads_every_line(spark):
    from repohealth.plans import REGISTRY

    data = [(k, 1, 17) for k in range(45)]
    part = spark.createDataFrame(data, "l_orderkey long, l_linenumber int, l_partkey long").selectExpr("*", "0L AS l_suppkey")
    from repohealth.sources.views import Tables

    tables = Tables(spark, "/none")
    tables._cache["lineitem"] = part
    got = {r.path for r in REGISTRY["phi_rules"].job(tables).collect()}
    assert len(got) == 45 and any("node_modules" in p for p in got) and {p.rsplit(".", 1)[1] for p in got} == {"ts", "tsx", "js", "md", "py"}


def test_outdated_versions_are_parsed_once_a_side(spark):
    installed = spark.createDataFrame([("r", "a", "^1.2.3"), ("r", "b", "1.2.3"), ("r", "c", "1.2.3"), ("r", "d", None)], "repo_id string, name string, current string")
    registry = spark.createDataFrame([("a", "3.0.0"), ("b", "1.3.0"), ("c", "--"), ("d", "0.0.1")], "name string, latest string")
    rows = deps.outdated_deps(installed, registry)
    assert sorted((r.name, r.severity, r.cargo_severity) for r in rows.collect()) == [("a", "high", "high"), ("b", "low", "medium"), ("d", "info", "low")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_replace(") <= 12  # three parts a side, each tested and then read


def test_config_document_is_parsed_once(spark):
    df = spark.createDataFrame([(1, "{}")], "repo_id int, doc string").where("length(doc) > 1")
    plan = validate_config(df)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") == 2  # the condition and the value of strict_json


def test_plain_words_do_not_change_silos(spark, monkeypatch):
    texts = ["See NOTION", "per slack discussion", "see wiki", "per Jira", "Documented in Wiki", "https://a.notion.so/x", "https://a.atlassian.net/browse/A-1",
             "https://a.Atlassian.net/wiki/x", "https://confluence.x.y", "https://jira.x.y", "notional slackline", "see you", "", None]
    lines = spark.createDataFrame([("r", f"d{i}.md", i, x) for i, x in enumerate(texts)], "repo_id string, path string, line_no int, text string")
    found = sorted(map(str, rules.external_silos(lines).collect()))
    assert len(found) == 10
    monkeypatch.setattr(rules, "SILO_WORDS", ("",))
    assert found == sorted(map(str, rules.external_silos(lines).collect()))


def test_keys_of_lines_are_runs_a_rule_can_need(spark):
    got = values(spark, [("a-bcd_1 é x😀yz9 bcd",), ("ab",), (None,), ("",)], "t string", rules._grams(F.lower("t")))
    assert [g[0] for g in got] == [["bcd", "cd_", "d_1", "yz9"], [], None, []]


def test_texts_before_patterns_do_not_change_hits(spark):
    from dataclasses import replace

    texts = ["Password = 'abcdefgh'", "API-KEY: \"12345678\"", "x_Token='" + "Q" * 44 + "'", "auth = '" + "a" * 40 + "'", "CREDENTIAL: '" + "b" * 41 + "='", "password",
             "let a: any", "b as any;", "<any>c", "many", "d as unknown as E", "user!.name", "// @ts-ignore", "// @ts-expect-error", "sk-" + "a" * 24, "", None]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "n int, text string")
    for table in (rules.SECRET_RULES, rules.TYPE_RULES):
        assert all(r.literals or r.any_of for r in table)
        fast = sorted((r.n, r.rule_id) for r in rules.match_rules(lines, table).collect())
        slow = sorted((r.n, r.rule_id) for r in rules.match_rules(lines, [replace(r, literals=(), any_of=()) for r in table]).collect())
        assert fast == slow and len(fast) >= 6
