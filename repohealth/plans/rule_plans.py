"""Queries of line rules and whole-text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from repohealth.functions.scalars import count_if, keep_found
from repohealth.operators import checks, code, rules, shape
from repohealth.operators import graph
from repohealth.operators.graph import node_facts
from repohealth.operators.scoring import deduction_points, deduction_score
from repohealth.plans.registry import query
from repohealth.plans.sqltext import half_up, q
from repohealth.session import cut_lineage
from repohealth.sources.files import explode_lines, line_count

# Fixed rules of the fixture: words that are common in the supplied prose and code.
WORD_RULES = (
    rules.Rule("articles", r"\b(la|the|de)\b", "info", "words", "common word"),
    rules.Rule("ending", r"[.!?]\s*$", "low", "style", "sentence end"),
    rules.Rule("digits", r"[0-9]{3,}", "medium", "numbers", "long number"),
    rules.Rule("secretish", r"(password|secret|token)\s*[:=]", "high", "secret", "secret word", True),
)

CODE_LINES = "SELECT repo_id, path, line_no, text FROM v_code_lines"


def _re2(rule: rules.Rule) -> str:
    return f"(?i:{rule.pattern})" if rule.ignore_case else f"(?:{rule.pattern})"


def _hits_sql(rule_set, source: str, cols: str = "repo_id, path, line_no, text") -> str:
    return " UNION ALL ".join(
        f"SELECT {cols}, {q(r.id)} AS rule_id, {q(r.severity)} AS severity, {q(r.category)} AS category, {q(r.message)} AS rule_message FROM {source} WHERE regexp_matches(text, {q(_re2(r))})"
        for r in rule_set
    )


DOC_LINES = """doclines AS (SELECT repo_id, path, CAST(i AS INT) AS line_no, l[i] AS text FROM (SELECT repo_id, path, string_split(content, chr(10)) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM v_files) x)"""


@query("match_rules", f"WITH {DOC_LINES}, hits AS ({_hits_sql(WORD_RULES, 'doclines')}) SELECT repo_id, path, line_no, rule_id, severity, category FROM hits")
def _(t):
    return rules.match_rules(explode_lines(t["v_files"]), WORD_RULES).select("repo_id", "path", "line_no", "rule_id", "severity", "category")


FIXTURE_SQL = f"regexp_matches(path, {q('|'.join(f'(?:{p})' for p in rules.FIXTURE_PATTERNS))})"
SKIP_SECRET_SQL = f"list_contains(string_split(path, '/'), 'node_modules') OR list_contains(string_split(path, '/'), '.git') OR path LIKE '%.min.js' OR {FIXTURE_SQL}"


@query("secrets", f"""WITH src AS (SELECT repo_id, path, line_no, text FROM v_code_lines WHERE NOT ({SKIP_SECRET_SQL})), hits AS ({_hits_sql(rules.SECRET_RULES, 'src')})
SELECT repo_id, path, line_no, rule_id, severity, category, concat(rule_message, ': ', trim(CASE WHEN length(text) > 120 THEN concat(substring(text, 1, 120), '...') ELSE text END)) AS message FROM hits""")
def _(t):
    return rules.secrets_scan(t["v_code_lines"]).select("repo_id", "path", "line_no", "rule_id", "severity", "category", "message")


@query("secrets_score", f"""WITH src AS (SELECT repo_id, path, line_no, text FROM v_code_lines WHERE NOT ({SKIP_SECRET_SQL})), hits AS ({_hits_sql(rules.SECRET_RULES, 'src')})
SELECT repo_id, path, count(*) AS findings, CAST(greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END)) AS INT) AS score FROM hits GROUP BY repo_id, path""")
def _(t):
    hits = rules.secrets_scan(t["v_code_lines"])
    return deduction_score(hits, ["repo_id", "path"], deduction_points("secrets-scan", F.col("severity")))


TYPED_SQL = f"""src AS (SELECT repo_id, path, line_no, text FROM v_code_lines WHERE regexp_matches(path, '(?i)\\.tsx?$') AND NOT contains(path, 'node_modules/')),
hits AS (SELECT * FROM ({_hits_sql(rules.TYPE_RULES, 'src')}) h WHERE NOT (rule_id = 'ts-expect-error' AND contains(text, '@ts-ignore')))"""
TSDOC = r"regexp_replace(regexp_replace(content, '//[^\n]*', '', 'g'), '/\*[\s\S]*?\*/', '', 'g')"
STRICT_SQL = f"""ts AS (SELECT repo_id, try_cast({TSDOC} AS JSON) AS j FROM v_code_files WHERE path = 'tsconfig.json'),
flags AS (SELECT repo_id, unnest(['strict', 'noImplicitAny', 'strictNullChecks', 'noImplicitReturns', 'strictPropertyInitialization']) AS flag, j FROM ts),
missing AS (SELECT repo_id, flag FROM flags WHERE NOT (coalesce(json_extract_string(j, '$.compilerOptions.' || flag) = 'true', false)
  OR (flag NOT IN ('strict', 'noImplicitReturns') AND coalesce(json_extract_string(j, '$.compilerOptions.strict') = 'true', false))))"""


@query("type_safety", f"""WITH {TYPED_SQL}, {STRICT_SQL}, c AS (SELECT repo_id, count(CASE WHEN category = 'any-usage' THEN 1 END) AS any_usage, count(CASE WHEN category = 'type-assertion' THEN 1 END) AS casts,
  count(CASE WHEN category = 'ts-directive' THEN 1 END) AS directives FROM hits GROUP BY repo_id),
m AS (SELECT repo_id, count(*) AS n FROM missing GROUP BY repo_id)
SELECT c.repo_id, any_usage, casts, directives, coalesce(m.n, 0) AS missing_flags,
  CAST(greatest(0, 100 - (least(any_usage * 2, 40) + coalesce(m.n, 0) * 5 + least(casts, 15) + least(directives * 2, 15))) AS INT) AS score FROM c LEFT JOIN m USING (repo_id)""")
def _(t):
    hits = rules.type_safety_hits(t["v_code_lines"])
    counts = hits.groupBy("repo_id").agg(
        count_if(F.col("category") == "any-usage").alias("any_usage"), count_if(F.col("category") == "type-assertion").alias("casts"),
        count_if(F.col("category") == "ts-directive").alias("directives"))
    flags = t["v_code_files"].where("path = 'tsconfig.json'").select(
        "repo_id", F.size(shape.strict_flags(F.col("content"))).cast("bigint").alias("n"))
    missing = F.coalesce("n", F.lit(0)).cast("bigint")
    return counts.join(flags, "repo_id", "left").select(
        "repo_id", "any_usage", "casts", "directives", missing.alias("missing_flags"),
        rules.type_safety_score(F.col("any_usage"), F.col("casts"), F.col("directives"), missing).alias("score"))


@query("strict_flags", f"WITH {STRICT_SQL} SELECT ts.repo_id, coalesce(string_agg(flag, ',' ORDER BY CASE flag WHEN 'strict' THEN 0 WHEN 'noImplicitAny' THEN 1 WHEN 'strictNullChecks' THEN 2 WHEN 'noImplicitReturns' THEN 3 ELSE 4 END), '') AS missing FROM ts LEFT JOIN missing USING (repo_id) GROUP BY ts.repo_id")
def _(t):
    rows = t["v_code_files"].where("path = 'tsconfig.json'")
    return rows.select("repo_id", F.array_join(shape.strict_flags(F.col("content")), ",").alias("missing"))


def _silo_sql(source: str) -> str:
    isdoc = f"(regexp_extract(lower(path), '[^/]*$') IN ({', '.join(map(q, rules.DOC_NAMES))}) OR regexp_matches(lower(path), '\\.(md|mdx|txt|rst)$'))"
    iscode = f"regexp_matches(lower(path), '({'|'.join(e.replace('.', '[.]') for e in rules.COMMENT_EXTENSIONS)})$')"
    word = "regexp_extract(text, '(?i)documented\\s+in\\s+(notion|confluence|jira|wiki|slack)', 1)"
    arms = [f"WHEN regexp_matches(text, {q('(?i)' + p)}) THEN {q(n) if n else f'concat(upper(substring({word}, 1, 1)), substring({word}, 2))'}" for p, n in rules.SILO_REFERENCES]
    arms += [f"WHEN {isdoc} AND regexp_matches(text, {q('(?i)' + p)}) THEN {q(n)}" for p, n in rules.SILO_LINKS]
    return f"""SELECT repo_id, path, system, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, system ORDER BY line_no, text) AS rn FROM (
  SELECT repo_id, path, line_no, substring(trim(text), 1, 120) AS text, CASE {' '.join(arms)} END AS system FROM {source} WHERE {isdoc} OR {iscode}) x WHERE system IS NOT NULL) y WHERE rn = 1"""


SILO_SQL = _silo_sql("v_code_lines")


@query("external_silos", SILO_SQL)
def _(t):
    return rules.external_silos(t["v_code_lines"])


TODO_SQL = """SELECT l.repo_id, l.path, l.line_no, l.text, CAST(DATE '2001-08-01' - CAST(b.author_ts AS DATE) AS INT) AS age_days,
  CASE WHEN DATE '2001-08-01' - CAST(b.author_ts AS DATE) > 365 THEN 'medium' WHEN DATE '2001-08-01' - CAST(b.author_ts AS DATE) > 90 THEN 'low' END AS severity
FROM v_code_lines l JOIN v_blame b ON l.repo_id = b.repo_id AND l.file_no = b.file_no AND l.line_no = b.line_no WHERE regexp_matches(l.text, 'TODO|FIXME')"""


def _todos(t):
    return rules.todo_age(t["v_code_lines"], t["v_blame"], ["repo_id", "file_no", "line_no"], "2001-08-01")


@query("todo_age", TODO_SQL)
def _(t):
    return _todos(t).select("repo_id", "path", "line_no", "text", "age_days", "severity")


@query("todo_score", f"""SELECT repo_id, count(*) AS todos, count(severity) AS stale, CAST(count(*) - count(severity) AS DOUBLE) / count(*) AS score FROM ({TODO_SQL}) t GROUP BY repo_id""")
def _(t):
    rows = _todos(t).groupBy("repo_id").agg(F.count(F.lit(1)).alias("todos"), F.count("severity").alias("stale"))
    return rows.withColumn("score", (F.col("todos") - F.col("stale")) / F.col("todos"))


FILE_LANGUAGE_SQL = f"""CASE WHEN len(list_filter(string_split(path, '/')[:-2], lambda d: d IN ({', '.join(map(q, rules.RULE_SKIP_DIRS))}))) = 0 THEN CASE {' '.join(f"WHEN ends_with(path, {q(e)}) THEN {q(n)}" for e, n in rules.FILE_LANGUAGES.items())} END END"""


@query("phi_rules", f"WITH hits AS ({_hits_sql(rules.phi_rules(), 'v_code_lines')}) SELECT repo_id, path, line_no, rule_id, severity FROM hits")
def _(t):
    return rules.match_rules(t["v_code_lines"], rules.phi_rules()).select("repo_id", "path", "line_no", "rule_id", "severity")


@query("user_rules", f"""WITH src AS (SELECT repo_id, path, line_no, text, {FILE_LANGUAGE_SQL} AS lang FROM v_code_lines)
SELECT s.repo_id, s.path, s.line_no, r.id AS rule_id, r.severity, r.category, r.message AS rule_message, r.suggestion, r.language FROM src s JOIN v_user_rules r
ON CASE lower(r.language) {' '.join(f"WHEN {q(k)} THEN s.lang IN ({', '.join(map(q, v))})" for k, v in rules.RULE_COVERS.items())} ELSE false END AND regexp_matches(s.text, r.pattern)""")
def _(t):
    good = rules.validate_rules(t["v_user_rules"]).where("reject_reason IS NULL")
    return rules.match_rule_table(t["v_code_lines"], good).drop("text", "file_no")


@query("validate_rules", f"""SELECT rule_no, coalesce({', '.join(f"CASE WHEN trim(coalesce({f}, '')) = '' THEN {q('missing or empty required field ' + f)} END" for f in rules.RULE_FIELDS)},
  CASE WHEN severity NOT IN ('critical', 'high', 'medium', 'low', 'info') THEN concat('invalid severity ', severity) END,
  CASE WHEN lower(language) NOT IN ('typescript', 'javascript', 'tsx', 'jsx', 'python') THEN concat('unsupported language ', language) END) AS reject_reason FROM v_rules_raw""")
def _(t):
    return rules.validate_rules(t["v_rules_raw"]).select("rule_no", "reject_reason")


@query("fixture_paths", f"SELECT repo_id, path FROM v_code_files WHERE NOT {FIXTURE_SQL}")
def _(t):
    return t["v_code_files"].where(~rules.is_fixture(F.col("path"))).select("repo_id", "path")


@query("test_files", r"""SELECT repo_id, path FROM v_code_files WHERE regexp_matches(path, '(\.test|\.spec|_test)\.[jt]sx?$') OR (contains(path, '__tests__/') AND regexp_matches(path, '\.[jt]sx?$'))""")
def _(t):
    named = F.rlike("path", F.lit(r"(\.test|\.spec|_test)\.[jt]sx?$"))
    inside = F.contains("path", F.lit("__tests__/")) & F.rlike("path", F.lit(r"\.[jt]sx?$"))
    return t["v_code_files"].where(named | inside).select("repo_id", "path")


DOC_ROOTS = ("README.md", "CLAUDE.md", "AGENTS.md", "PLAN.md", "CONTRIBUTING.md", "CHANGELOG.md", "ARCHITECTURE.md")


@query("doc_inventory", f"""SELECT * FROM (SELECT repo_id, path, CASE WHEN path IN ({', '.join(map(q, DOC_ROOTS))}) THEN 'root' WHEN regexp_matches(path, '^docs/[^/]+\\.md$') THEN 'docs'
  WHEN regexp_matches(path, '^([^/]+/)([^/]+/)?(CLAUDE|AGENTS)\\.md$') AND NOT regexp_matches(path, '^(node_modules|\\.git|docs)/') THEN 'agent'
  WHEN path IN ('src/index.ts', 'src/main.ts', 'index.ts', 'main.ts', 'app/layout.tsx', 'app/page.tsx', 'lib/index.ts') OR regexp_matches(path, '^bin/[^/]+\\.(ts|mjs)$') THEN 'entry' END AS kind FROM v_code_files) x WHERE kind IS NOT NULL""")
def _(t):
    path = F.col("path")
    kind = (
        F.when(path.isin(*DOC_ROOTS), "root").when(F.rlike(path, F.lit(r"^docs/[^/]+\.md$")), "docs")
        .when(F.rlike(path, F.lit(r"^([^/]+/)([^/]+/)?(CLAUDE|AGENTS)\.md$")) & ~F.rlike(path, F.lit(r"^(node_modules|\.git|docs)/")), "agent")
        .when(path.isin("src/index.ts", "src/main.ts", "index.ts", "main.ts", "app/layout.tsx", "app/page.tsx", "lib/index.ts")
              | F.rlike(path, F.lit(r"^bin/[^/]+\.(ts|mjs)$")), "entry")
    )
    return keep_found(t["v_code_files"].select("repo_id", "path"), "kind", kind)


DECISION_SQL = f"1 + len(regexp_extract_all(content, {q(rules.DECISION_PATTERN)}))"
LOC_SQL = "CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END"


@query("decision_count", f"SELECT repo_id, path, CAST({DECISION_SQL} AS INT) AS decisions FROM v_files")
def _(t):
    return t["v_files"].select("repo_id", "path", rules.decision_count(F.col("content")).cast("int").alias("decisions"))


RELAXED_SQL = f"regexp_matches(path, {q('|'.join(f'(?:{p})' for p in rules.RELAXED_PATTERNS))})"


@query("file_size", f"""SELECT * FROM (SELECT repo_id, path, lines, relaxed, CASE WHEN lines >= 2000 * f THEN 'high' WHEN lines >= 1000 * f THEN 'medium' WHEN lines >= 500 * f THEN 'low' WHEN lines >= 300 * f THEN 'info' END AS severity
FROM (SELECT repo_id, path, CAST({LOC_SQL} AS INT) AS lines, {RELAXED_SQL} AS relaxed, CASE WHEN {RELAXED_SQL} THEN 2 ELSE 1 END AS f FROM v_code_files) x) y WHERE severity IS NOT NULL""")
def _(t):
    rows = t["v_code_files"].select("repo_id", "path", line_count(F.col("content")).alias("lines"), rules.is_relaxed(F.col("path")).alias("relaxed"))
    return keep_found(rows, "severity", rules.size_severity(F.col("lines"), F.col("relaxed")))


@query("file_size_score", f"""SELECT repo_id, count(*) AS files, max(lines) AS max_lines, arg_min(path, (-lines, path)) AS max_file, CAST({half_up('CAST(count(CASE WHEN lines < 500 * f THEN 1 END) AS DOUBLE) / count(*) * 100')} AS INT) AS score
FROM (SELECT repo_id, path, CAST({LOC_SQL} AS INT) AS lines, CASE WHEN {RELAXED_SQL} THEN 2 ELSE 1 END AS f FROM v_code_files) x GROUP BY repo_id""")
def _(t):
    rows = t["v_code_files"].select("repo_id", "path", line_count(F.col("content")).alias("lines"),
                                    F.when(rules.is_relaxed(F.col("path")), 2).otherwise(1).alias("f"))
    healthy = count_if(F.col("lines") < F.col("f") * 500)
    return rows.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files"), F.max("lines").alias("max_lines"),
        F.min_by("path", F.struct((-F.col("lines")).alias("a"), F.col("path"))).alias("max_file"),
        F.floor(healthy / F.count(F.lit(1)) * 100 + 0.5).cast("int").alias("score"))


CX = f"cx AS (SELECT repo_id, path, CAST({LOC_SQL} AS INT) AS loc, CAST({DECISION_SQL} AS INT) AS complexity FROM v_code_files WHERE regexp_matches(lower(path), '\\.(ts|tsx|js|jsx)$'))"


@query("maintainability", f"""WITH {CX}, g AS (SELECT repo_id, count(*) AS files, CAST(sum(loc) AS BIGINT) AS total_loc, max(complexity) AS max_complexity, count(CASE WHEN complexity > 10 THEN 1 END) AS complex_files,
  count(CASE WHEN loc > 500 THEN 1 END) AS long_files, CAST(sum(complexity) AS DOUBLE) / count(*) AS cx, CAST(sum(loc) AS DOUBLE) / count(*) AS l FROM cx GROUP BY repo_id)
SELECT repo_id, files, total_loc, max_complexity, complex_files, long_files, {half_up('cx * 100')} / CAST(100 AS DOUBLE) AS avg_complexity,
  CAST(least(100, greatest(0, floor((171 - 5.2 * ln(greatest(l * 2, 1.0)) - 0.23 * cx - 16.2 * ln(greatest(l, 1.0))) * (100.0 / 171.0) + 0.5))) AS INT) AS maintainability FROM g""")
def _(t):
    return checks.complexity_metrics(checks.complexity_facts(t["v_code_files"]))


@query("complexity_findings", f"""WITH {CX}, r AS (SELECT *, CASE WHEN starts_with(path, 'app/api/') THEN 800 ELSE 500 END AS lim, starts_with(path, 'components/ui/') AS kit FROM cx)
SELECT repo_id, path, loc, complexity, CASE WHEN complexity > 25 THEN 'high' WHEN complexity > 15 THEN 'medium' ELSE 'low' END AS severity, 'high-complexity' AS category FROM r WHERE complexity > 10
UNION ALL SELECT repo_id, path, loc, complexity, CASE WHEN loc > lim * 2 THEN 'high' ELSE 'medium' END, 'long-file' FROM r WHERE NOT kit AND loc > lim""")
def _(t):
    facts = checks.complexity_facts(t["v_code_files"]).withColumn("roles", shape.path_roles(F.col("path")))
    return checks.complexity_findings(facts)


def _imports_sql(cond: str) -> str:
    every = ", ".join(f"regexp_extract_all(content, {q(p)}, 1)" for p in code.IMPORT_PATTERNS)
    return f"""SELECT repo_id, path, content, unnest(list_distinct(flatten([{every}]))) AS specifier FROM v_code_files{cond}"""


NAMES_SQL = lambda text: f"list_filter(list_transform(string_split({text}, ','), lambda s: trim(string_split_regex(trim(s), '\\s+as\\s+')[1])), lambda s: s <> '')"
IMPORTS_SQL = f"""imp AS (SELECT repo_id, path, specifier, list_contains(regexp_extract_all(content, {q(code.DYNAMIC_IMPORT)}, 1), specifier) AS is_dynamic,
  flatten(list_transform(list_filter(list_zip(regexp_extract_all(content, {q(code.NAMED_IMPORT)}, 1), regexp_extract_all(content, {q(code.NAMED_IMPORT)}, 2)), lambda z: z[2] = specifier), lambda z: {NAMES_SQL('z[1]')})) AS symbols
  FROM ({_imports_sql('')}) i WHERE starts_with(specifier, '.') OR starts_with(specifier, '@/'))"""


@query("imports", f"WITH {IMPORTS_SQL} SELECT repo_id, path, specifier, is_dynamic, array_to_string(symbols, ',') AS symbols FROM imp")
def _(t):
    return code.extract_imports(t["v_code_files"]).withColumn("symbols", F.array_join("symbols", ","))


EXPORTS_SQL = f"""exp AS (SELECT repo_id, path, unnest(list_distinct(list_concat(regexp_extract_all(content, {q(code.EXPORT_NAME)}, 1),
  flatten(list_transform(regexp_extract_all(content, {q(code.EXPORT_LIST)}, 1), lambda x: {NAMES_SQL('x')}))))) AS symbol FROM v_code_files)"""


@query("exports", f"WITH {EXPORTS_SQL} SELECT * FROM exp")
def _(t):
    return code.extract_exports(t["v_code_files"])


_EXT = ", ".join(f"base || {q(e)}" for e in code.RESOLVE_EXTENSIONS)
_IDX = ", ".join(f"base || {q('/index' + e)}" for e in code.RESOLVE_EXTENSIONS)
# The oracle collapses 'dir/../' by repeated replacement: three levels cover the fixture's relative imports.
_UP = r"'(^|/)[^/.][^/]*/\.\./'"
RESOLVED_SQL = f"""{IMPORTS_SQL}, raw AS (SELECT *, CASE WHEN starts_with(specifier, '@/') THEN substring(specifier, 3)
  ELSE regexp_replace(CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || specifier ELSE specifier END, '(^|/)\\./', '\\1', 'g') END AS p FROM imp),
col AS (SELECT *, ltrim(regexp_replace(regexp_replace(regexp_replace(p, {_UP}, '\\1'), {_UP}, '\\1'), {_UP}, '\\1'), '/') AS base FROM raw),
cand AS (SELECT *, unnest(range(1, 14)) AS rk FROM (SELECT *, [base, {_EXT}, {_IDX}] AS names FROM col) c),
res AS (SELECT repo_id, path, specifier, target, is_dynamic, symbols FROM (SELECT c.*, c.names[c.rk] AS target, row_number() OVER (PARTITION BY c.repo_id, c.path, c.specifier ORDER BY c.rk) AS rn
  FROM cand c JOIN (SELECT DISTINCT repo_id, path FROM v_code_files) f ON f.repo_id = c.repo_id AND f.path = c.names[c.rk]) z WHERE rn = 1 AND target <> path)"""


def _resolved(t):
    return code.resolve_imports(code.extract_imports(t["v_code_files"]), t["v_code_files"])


@query("resolve_imports", f"WITH {RESOLVED_SQL} SELECT repo_id, path, specifier, target FROM res")
def _(t):
    return _resolved(t).select("repo_id", "path", "specifier", "target")


@query("import_counts", f"WITH {RESOLVED_SQL}, n AS (SELECT repo_id, target, count(DISTINCT path) AS n FROM res GROUP BY 1, 2) SELECT f.repo_id, f.path, coalesce(n.n, 0) AS imports FROM v_code_files f LEFT JOIN n ON n.repo_id = f.repo_id AND n.target = f.path")
def _(t):
    edges = code.import_edges(_resolved(t))
    counts = edges.groupBy("repo_id", F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return t["v_code_files"].select("repo_id", "path").join(counts, ["repo_id", "path"], "left").select(
        "repo_id", "path", F.coalesce("n", F.lit(0)).alias("imports"))


@query("fan_counts", f"""WITH {RESOLVED_SQL}, e AS (SELECT DISTINCT repo_id, path AS src, target AS dst FROM res), o AS (SELECT repo_id, src, count(*) AS n FROM e GROUP BY 1, 2), i AS (SELECT repo_id, dst, count(*) AS n FROM e GROUP BY 1, 2)
SELECT f.repo_id, f.path, len(string_split(f.content, chr(10))) AS loc, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, starts_with(f.path, 'app/') OR starts_with(f.path, 'pages/') AS is_entry,
  coalesce(i.n, 0) = 0 AND NOT (starts_with(f.path, 'app/') OR starts_with(f.path, 'pages/')) AS is_island
FROM v_code_files f LEFT JOIN i ON i.repo_id = f.repo_id AND i.dst = f.path LEFT JOIN o ON o.repo_id = f.repo_id AND o.src = f.path""")
def _(t):
    return node_facts(t["v_code_files"], code.import_edges(_resolved(t)))


@query("islands", f"""WITH {RESOLVED_SQL} SELECT repo_id, path FROM v_code_files f WHERE NOT (starts_with(path, 'app/') OR starts_with(path, 'pages/')) AND NOT EXISTS (SELECT 1 FROM res WHERE res.repo_id = f.repo_id AND res.target = f.path)""")
def _(t):
    return node_facts(t["v_code_files"], code.import_edges(_resolved(t))).where("is_island").select("repo_id", "path")


IMPORT_CLOSURE = f"""WITH RECURSIVE {RESOLVED_SQL}, e AS (SELECT DISTINCT repo_id, path AS src, target AS dst FROM res),
c AS (SELECT repo_id, src, dst FROM e UNION SELECT c.repo_id, c.src, e.dst FROM c JOIN e ON c.repo_id = e.repo_id AND c.dst = e.src)"""


@query("repo_blast_radius", f"""{IMPORT_CLOSURE}, n AS (SELECT repo_id, src AS node FROM e UNION SELECT repo_id, dst FROM e), d AS (SELECT repo_id, dst AS node, count(*) AS k FROM e GROUP BY 1, 2),
t AS (SELECT repo_id, dst AS node, count(CASE WHEN src <> dst THEN 1 END) AS k FROM c GROUP BY 1, 2)
SELECT n.repo_id, n.node, coalesce(d.k, 0) AS direct, coalesce(t.k, 0) AS transitive FROM n LEFT JOIN t USING (repo_id, node) LEFT JOIN d USING (repo_id, node)""")
def _(t):
    return graph.blast_radius(code.import_edges(_resolved(t)))


@query("repo_cycles", f"{IMPORT_CLOSURE} SELECT a.repo_id, a.src AS node, min(a.dst) AS component FROM c a JOIN c b ON a.repo_id = b.repo_id AND a.src = b.dst AND a.dst = b.src GROUP BY 1, 2")
def _(t):
    return graph.strong_components(code.import_edges(_resolved(t)))


SCRIPT = r"regexp_matches(path, '\.(ts|tsx|js|jsx)$')"


@query("dead_files", f"""WITH {RESOLVED_SQL} SELECT repo_id, path FROM v_code_files f WHERE {SCRIPT} AND NOT (starts_with(path, 'app/') OR starts_with(path, 'pages/') OR starts_with(path, 'bin/') OR starts_with(path, 'mcp-server/') OR starts_with(path, 'lib/ai/providers/'))
  AND NOT (path LIKE '%/page.tsx') AND NOT EXISTS (SELECT 1 FROM res WHERE res.repo_id = f.repo_id AND res.target = f.path)""")
def _(t):
    scripts = t["v_code_files"].where(F.rlike("path", F.lit(r"\.(ts|tsx|js|jsx)$")))
    roles = shape.file_roles(scripts)
    return code.dead_files(roles, code.import_edges(_resolved(t))).select("repo_id", "path")


BARREL_SQL = f"""(regexp_matches(path, '(^|/)index\\.tsx?$') AND len(list_filter(string_split(content, chr(10)), lambda s: NOT regexp_matches(trim(s), {q(shape.IGNORABLE)}))) > 0
  AND len(list_filter(string_split(content, chr(10)), lambda s: NOT regexp_matches(trim(s), {q(shape.IGNORABLE)}) AND NOT regexp_matches(trim(s), {q(shape.REEXPORT)}))) = 0)"""


def _listed_sql(pattern: str) -> str:
    """(spec, source, symbol) of the comma lists that a pattern finds."""
    names = "list_filter(list_transform(string_split(z[1], ','), lambda n: trim(n)), lambda n: n <> '')"
    item = "{'spec': z[2], 'source': trim(string_split_regex(n, '\\s+as\\s+')[1]), 'symbol': trim(string_split_regex(n, '\\s+as\\s+')[-1])}"
    return f"flatten(list_transform(list_zip(regexp_extract_all(content, {q(pattern)}, 1), regexp_extract_all(content, {q(pattern)}, 2)), lambda z: list_transform({names}, lambda n: {item})))"


def _spec_sql(pattern: str, name: str) -> str:
    return f"list_transform(regexp_extract_all(content, {q(pattern)}, 1), lambda x: {{'spec': x, 'source': '{name}', 'symbol': '{name}'}})"


_AS_SQL = f"list_transform(list_zip(regexp_extract_all(content, {q(code.EXPORT_ALL_AS)}, 1), regexp_extract_all(content, {q(code.EXPORT_ALL_AS)}, 2)), lambda z: {{'spec': z[2], 'source': '*', 'symbol': z[1]}})"
_LIST_SQL = _listed_sql(code.EXPORT_LIST).replace(f"regexp_extract_all(content, {q(code.EXPORT_LIST)}, 2)", f"regexp_extract_all(content, {q(code.EXPORT_LIST)}, 1)")
LIVE_SQL = f"""scr AS (SELECT repo_id, path, content FROM v_code_files WHERE {SCRIPT}),
us AS (SELECT repo_id, path, unnest(flatten([{', '.join([*map(_listed_sql, (code.NAMED_IMPORT, code.MIXED_IMPORT)), *(_spec_sql(p, '*') for p in (code.NAMESPACE_IMPORT, code.REQUIRE, code.DYNAMIC_IMPORT)), _spec_sql(code.DEFAULT_IMPORT, 'default')])}])) AS u FROM scr),
rx AS (SELECT repo_id, path, unnest(flatten([{', '.join([_listed_sql(code.EXPORT_FROM), _AS_SQL, _spec_sql(code.EXPORT_ALL, '*')])}])) AS u FROM scr),
pas AS (SELECT DISTINCT rx.repo_id, rx.path, u.symbol AS sym, res.target, u.source AS source FROM rx JOIN res ON res.repo_id = rx.repo_id AND res.path = rx.path AND res.specifier = u.spec),
live AS (SELECT DISTINCT us.repo_id, res.target AS path, u.source AS symbol FROM us JOIN res ON res.repo_id = us.repo_id AND res.path = us.path AND res.specifier = u.spec
  UNION SELECT live.repo_id, pas.target, CASE WHEN pas.sym = '*' AND live.symbol <> '*' THEN live.symbol ELSE pas.source END FROM live JOIN pas ON pas.repo_id = live.repo_id AND pas.path = live.path
    AND (pas.sym = live.symbol OR live.symbol = '*' OR (pas.sym = '*' AND live.symbol <> 'default'))),
dflt AS (SELECT repo_id, path, unnest(regexp_extract_all(content, {q(code.DEFAULT_EXPORT)}, 1)) AS symbol FROM scr),
als AS (SELECT repo_id, path, u.source AS source, u.symbol AS symbol FROM (SELECT repo_id, path, unnest({_LIST_SQL}) AS u FROM scr) x WHERE u.source <> u.symbol),
dead_exp AS (SELECT e.repo_id, e.path, e.symbol FROM exp e JOIN (SELECT repo_id, path FROM v_code_files WHERE {SCRIPT} AND NOT (starts_with(path, 'components/ui/') OR starts_with(path, 'lib/ai/providers/') OR regexp_matches(content, '^// @role [^\\n]*public-api') OR {BARREL_SQL})) ok USING (repo_id, path)
  WHERE NOT EXISTS (SELECT 1 FROM live u WHERE u.repo_id = e.repo_id AND u.path = e.path AND u.symbol IN (e.symbol, '*'))
    AND NOT EXISTS (SELECT 1 FROM live u JOIN dflt d ON d.repo_id = u.repo_id AND d.path = u.path WHERE u.symbol = 'default' AND d.repo_id = e.repo_id AND d.path = e.path AND d.symbol = e.symbol)
    AND NOT EXISTS (SELECT 1 FROM live u JOIN als s ON s.repo_id = u.repo_id AND s.path = u.path AND s.symbol = u.symbol WHERE s.repo_id = e.repo_id AND s.path = e.path AND s.source = e.symbol))"""


@query("dead_exports", f"""WITH RECURSIVE {RESOLVED_SQL}, {EXPORTS_SQL}, {LIVE_SQL} SELECT * FROM dead_exp""")
def _(t):
    scripts = t["v_code_files"].where(F.rlike("path", F.lit(r"\.(ts|tsx|js|jsx)$")))
    return code.dead_exports(scripts, cut_lineage(_resolved(t)), shape.file_roles(scripts)).select("repo_id", "path", "symbol")


PKG = "pkg AS (SELECT repo_id, CAST(content AS JSON) AS j FROM v_code_files WHERE path = 'package.json' AND json_valid(content))"
DEPS_SQL = f"""{PKG}, deps AS (SELECT repo_id, 'dependencies' AS kind, k AS name, json_extract_string(j, '$.dependencies."' || k || '"') AS version FROM (SELECT repo_id, j, unnest(json_keys(j, '$.dependencies')) AS k FROM pkg) a
  UNION ALL SELECT repo_id, 'devDependencies', k, json_extract_string(j, '$.devDependencies."' || k || '"') FROM (SELECT repo_id, j, unnest(json_keys(j, '$.devDependencies')) AS k FROM pkg) b)"""


@query("dead_deps", f"""WITH {DEPS_SQL}, used AS (SELECT DISTINCT repo_id, regexp_extract(specifier, '^(@[^/]+/[^/]+|[^/]+)', 1) AS name FROM ({_imports_sql('')}) i)
SELECT repo_id, name FROM deps d WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.repo_id = d.repo_id AND u.name = d.name)""")
def _(t):
    deps = shape.manifest_deps(shape.manifests(t["v_code_files"])).select("repo_id", "name")
    return code.dead_deps(deps, t["v_code_files"])


def _libs_sql(libs) -> str:
    names = ", ".join(map(q, libs))
    return f"""SELECT DISTINCT repo_id, lib FROM (SELECT repo_id, name AS lib FROM deps WHERE name IN ({names})
  UNION ALL SELECT repo_id, lib FROM (SELECT repo_id, content, unnest([{names}]) AS lib FROM v_code_files WHERE path IN ('go.mod', 'requirements.txt')) m WHERE contains(content, lib)) x"""


@query("lib_presence", f"WITH {DEPS_SQL} SELECT *, 'logging' AS kind FROM ({_libs_sql(checks.LOG_LIBS)}) a UNION ALL SELECT *, 'monitoring' FROM ({_libs_sql(checks.MONITOR_LIBS)}) b")
def _(t):
    logs = checks.lib_presence(t["v_code_files"], checks.LOG_LIBS).withColumn("kind", F.lit("logging"))
    return logs.unionByName(checks.lib_presence(t["v_code_files"], checks.MONITOR_LIBS).withColumn("kind", F.lit("monitoring")))


OBS_SQL = f"""sig AS (SELECT repo_id, path, regexp_matches(lower(path), '\\.(ts|tsx|js|jsx|mjs|cjs)$') AND regexp_matches(content, {q(checks.CONSOLE_PATTERN)}) OR path LIKE '%.py' AND regexp_matches(content, {q(checks.PRINT_PATTERN)}) AS con,
  regexp_matches(path, {q(checks.BOUNDARY_PATTERN)}) OR regexp_matches(content, {q(checks.BOUNDARY_PATTERN)}) AS bnd, regexp_matches(content, {q(checks.HEALTH_PATTERN)}) AS hea,
  regexp_matches(path, {q(checks.ROUTE_PATTERN)}) AS rou, regexp_matches(path, {q(checks.ROUTE_PATTERN)}) AND NOT regexp_matches(content, {q(checks.TRY_PATTERN)}) AS ung
  FROM v_code_files WHERE regexp_matches(lower(path), '[^/]({'|'.join(e.replace('.', '[.]') for e in checks.CODE_EXTENSIONS)})$')),
agg AS (SELECT repo_id, count(CASE WHEN con THEN 1 END) AS console_files, bool_or(bnd) AS error_boundary, count(CASE WHEN hea THEN 1 END) AS health_files, count(CASE WHEN rou THEN 1 END) AS api_routes,
  count(CASE WHEN ung THEN 1 END) AS unguarded_routes, array_to_string((list_sort(list(CASE WHEN con THEN path END) FILTER (con)))[1:5], '|') AS console_sample FROM sig GROUP BY repo_id),
roots AS (SELECT repo_id, bool_or(path IN ({', '.join(map(q, checks.INSTRUMENTATION))})) AS instrumentation, bool_or(path IN ({', '.join(map(q, checks.OBSERVED_CI))}) OR starts_with(path, '.github/workflows/')) AS ci FROM v_code_files GROUP BY repo_id),
obs AS (SELECT r.repo_id, coalesce(console_files, 0) AS console_files, coalesce(error_boundary, false) AS error_boundary, coalesce(health_files, 0) AS health_files, coalesce(api_routes, 0) AS api_routes,
  coalesce(unguarded_routes, 0) AS unguarded_routes, console_sample, instrumentation, ci FROM roots r LEFT JOIN agg USING (repo_id))"""


@query("observability", f"WITH {OBS_SQL} SELECT * FROM obs")
def _(t):
    return checks.observability_facts(t["v_code_files"])


@query("probe_findings", """SELECT repo_id, probe_id, method, route, severity, category FROM (
  SELECT *, 'high' AS severity, 'endpoint-error' AS category FROM v_probes WHERE error IS NOT NULL
  UNION ALL SELECT *, 'high', 'server-error' FROM v_probes WHERE error IS NULL AND status >= 500
  UNION ALL SELECT *, 'medium', 'missing-validation' FROM v_probes WHERE error IS NULL AND method IN ('POST', 'PUT', 'PATCH') AND status >= 200 AND status < 300
  UNION ALL SELECT *, 'low', 'slow-endpoint' FROM v_probes WHERE error IS NULL AND response_ms > 2000
  UNION ALL SELECT *, 'low', 'non-json-response' FROM v_probes WHERE error IS NULL AND status < 500 AND NOT is_json) x WHERE method <> 'DELETE'""")
def _(t):
    return checks.probe_findings(t["v_probes"])


@query("probe_metrics", f"""SELECT repo_id, count(*) AS tested, count(CASE WHEN status >= 500 THEN 1 END) AS server_errors,
  count(CASE WHEN error IS NULL AND method IN ('POST', 'PUT', 'PATCH') AND status >= 200 AND status < 300 THEN 1 END) AS missing_validation,
  count(CASE WHEN error IS NULL AND response_ms > 2000 THEN 1 END) AS slow, {half_up('CAST(sum(response_ms) AS DOUBLE) / count(*)')} AS avg_ms FROM v_probes WHERE method <> 'DELETE' GROUP BY repo_id""")
def _(t):
    return checks.probe_metrics(t["v_probes"])


@query("validate_config", """WITH d AS (SELECT repo_id, CAST(doc AS JSON) AS j FROM v_config_docs WHERE json_valid(doc)),
k AS (SELECT repo_id, j, json_extract_string(j, '$.profile') AS profile, json_extract_string(j, '$.tier') AS tier, CAST(json_extract_string(j, '$.aiTokenBudget') AS DOUBLE) AS budget,
  CAST(json_extract_string(j, '$.thresholds.complexity') AS DOUBLE) AS lim, json_type(j, '$.commands.test') AS kind, json_type(j, '$.commands.ci') AS ci, json_type(j, '$.modules.security') AS module,
  json_type(j, '$.ignore') AS ign, json_extract(j, '$.ignore[*]') AS igns, json_type(j, '$.classify."lib/x"') AS cls, json_extract(j, '$.classify."lib/x"[*]') AS clss, json_type(j, '$.auditPrompts') AS pr, json_type(j, '$.auditPrompts.a') AS pra FROM d)
SELECT repo_id, 'invalid JSON' AS violation FROM v_config_docs WHERE NOT json_valid(doc)
UNION ALL SELECT repo_id, 'threshold outside 0..100' FROM k WHERE lim < 0 OR lim > 100
UNION ALL SELECT repo_id, 'budget not a positive integer' FROM k WHERE budget <= 0 OR budget <> floor(budget)
UNION ALL SELECT repo_id, 'unknown tier' FROM k WHERE tier NOT IN ('pro', 'max', 'max-x20', 'api')
UNION ALL SELECT repo_id, 'unknown profile' FROM k WHERE profile NOT IN ('web-app', 'api-service', 'library', 'cli', 'agent-tooling', 'prototype', 'compliance-sensitive', 'solo', 'team', 'enterprise')
UNION ALL SELECT repo_id, 'command is neither text nor null' FROM k WHERE kind NOT IN ('VARCHAR', 'NULL') OR ci NOT IN ('VARCHAR', 'NULL')
UNION ALL SELECT repo_id, 'module switch is not a boolean' FROM k WHERE module <> 'BOOLEAN'
UNION ALL SELECT repo_id, 'ignore is not a list of texts' FROM k WHERE ign <> 'ARRAY' OR len(list_filter(igns, lambda x: json_type(x) <> 'VARCHAR')) > 0
UNION ALL SELECT repo_id, 'prompt is not a text' FROM k WHERE pr <> 'OBJECT' OR pra <> 'VARCHAR'
UNION ALL SELECT repo_id, 'role is neither text nor a list of texts' FROM k WHERE cls NOT IN ('VARCHAR', 'ARRAY') OR len(list_filter(clss, lambda x: json_type(x) <> 'VARCHAR')) > 0""")
def _(t):
    return checks.validate_config(t["v_config_docs"])
