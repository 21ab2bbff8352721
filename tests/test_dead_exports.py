from pyspark.sql import functions as F

from repohealth.operators import code

FILES = {
    "lib/a.ts": "export const one = 1\nexport const two = 2\nexport const gone = 3\nexport default function Main() {}",
    "lib/index.ts": "export { one, two as deux } from './a'\nexport * from './b'\nexport * as tools from './c'",
    "lib/b.ts": "export function bee() {}\nexport const unusedBee = 1\nexport default class Never {}",
    "lib/c.ts": "export const hammer = 1\nexport type Nail = 1",
    "index.ts": "export * from './lib'",
    "lib/d.ts": "export const whole = 1\nexport const also = 2",
    "lib/e.ts": "export const lazy = 1",
    "lib/f.ts": "export const req = 1",
    "lib/g.ts": "export default function Shown() {}\nexport const mixed = 1\nexport const alone = 1",
    "lib/loop1.ts": "export * from './loop2'\nexport const l1 = 1",
    "lib/loop2.ts": "export * from './loop1'\nexport const l2 = 1",
    "main.ts": "import { one } from './index'\nimport { deux, bee as b, tools } from './index'\nimport * as d from './lib/d'\nconst e = import('./lib/e')\nconst f = require('./lib/f')\n"
               "import Shown, { mixed } from './lib/g'\nimport { l2 } from './lib/loop1'",
}


def test_uses_through_reexports(spark):
    rows = [(r, p, c) for r, files in (("r", FILES), ("other", {k: v for k, v in FILES.items() if k != "main.ts"})) for p, c in files.items()]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    resolved = code.resolve_imports(code.extract_imports(files), files)
    roles = files.selectExpr("repo_id", "path", "CAST(array() AS array<string>) AS roles")
    dead = {}
    for x in code.dead_exports(files, resolved, roles).collect():
        dead.setdefault(x.repo_id, set()).add((x.path, x.symbol))
    assert dead["r"] == {("lib/a.ts", "gone"), ("lib/a.ts", "Main"), ("lib/b.ts", "unusedBee"), ("lib/b.ts", "Never"), ("lib/g.ts", "alone"), ("lib/loop1.ts", "l1")}
    assert ("lib/a.ts", "one") in dead["other"] and ("lib/d.ts", "whole") in dead["other"] and len(dead["other"]) > len(dead["r"])


def test_nothing_exported(spark):
    files = spark.createDataFrame([("r", "a.ts", "x")], "repo_id string, path string, content string")
    resolved = code.resolve_imports(code.extract_imports(files), files)
    assert code.dead_exports(files, resolved, files.selectExpr("repo_id", "path", "CAST(array() AS array<string>) AS roles")).count() == 0


def test_plain_searches_do_not_change_matches(spark, monkeypatch):
    texts = ["import { a as b } from './x'", "import x, { y } from \"./m\"", "export * as n from './n'\nexport { p, q as r } from './p'", "require('./r')\nimport('./d')",
             "export default function f() {}\nexport { g }", "import './side'", "import * as s from './s'", "export * from './t'", "importer from", "", None]
    files = spark.createDataFrame([("r", f"f{i}.ts", x) for i, x in enumerate(texts)], "repo_id string, path string, content string")
    patterns = (*code.IMPORT_PATTERNS, code.NAMED_IMPORT, code.EXPORT_NAME, code.EXPORT_LIST, code.NAMESPACE_IMPORT, code.DEFAULT_IMPORT, code.MIXED_IMPORT,
                code.EXPORT_FROM, code.EXPORT_ALL, code.EXPORT_ALL_AS, code.DEFAULT_EXPORT)

    def found():
        return files.select("path", *[code._all(F.col("content"), p) for p in patterns]).orderBy("path").collect()

    assert set(code.NEEDS) == set(patterns)
    guarded = found()
    monkeypatch.setattr(code, "NEEDS", {})
    assert guarded == found()


def test_import_names_are_worked_out_once(spark):
    files = spark.createDataFrame([("r", "a.ts", "import './b'"), ("r", "b.ts", "")], "repo_id string, path string, content string").where("length(path) > 1")
    plan = code.resolve_imports(code.extract_imports(files), files)._jdf.queryExecution().optimizedPlan().toString()
    # one fold of the path segments, which a filter on its result would repeat
    assert plan.count("aggregate(split(") <= 2 and [r.target for r in code.resolve_imports(code.extract_imports(files), files).collect()] == ["b.ts"]
