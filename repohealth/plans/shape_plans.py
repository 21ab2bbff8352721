"""Queries about repository shape and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from repohealth.operators import checks, shape
from repohealth.operators.scoring import deduction_points, deduction_score
from repohealth.plans.registry import query
from repohealth.plans.rule_plans import BARREL_SQL, DEPS_SQL, OBS_SQL, PKG, TSDOC, _libs_sql
from repohealth.plans.sqltext import case, q
from repohealth.sources import documents as D

ROLE_CASES = ", ".join(f"CASE WHEN regexp_matches(path, {q(p)}) THEN {q(r)} END" for r, p in shape.PATH_ROLES)
INLINE_SQL = """CASE WHEN regexp_matches(path, '\\.[jt]sx?$') THEN flatten(list_transform(list_filter(list_transform(string_split(content, chr(10))[1:5],
  lambda s: regexp_extract(s, '//\\s*@role\\s+(.+)', 1)), lambda s: s <> ''), lambda s: string_split_regex(trim(s), '\\s+'))) ELSE [] END"""
ROLES_SQL = f"""roles AS (SELECT repo_id, path, list_sort(list_distinct(list_concat(list_filter([{ROLE_CASES}], lambda x: x IS NOT NULL),
  CASE WHEN {BARREL_SQL} THEN ['barrel-file', 'public-api'] ELSE [] END, {INLINE_SQL}))) AS roles FROM v_code_files)"""


@query("file_roles", f"WITH {ROLES_SQL} SELECT repo_id, path, array_to_string(roles, ',') AS roles FROM roles")
def _(t):
    return shape.file_roles(t["v_code_files"]).withColumn("roles", F.array_join("roles", ","))


@query("barrel_files", f"SELECT repo_id, path FROM v_code_files WHERE {BARREL_SQL}")
def _(t):
    return t["v_code_files"].where(shape.is_barrel(F.col("path"), F.col("content"))).select("repo_id", "path")


@query("inline_roles", f"SELECT repo_id, path, array_to_string({INLINE_SQL}, ',') AS roles FROM v_code_files WHERE len({INLINE_SQL}) > 0")
def _(t):
    rows = t["v_code_files"].select("repo_id", "path", shape.inline_roles(F.col("path"), F.col("content")).alias("r"))
    return rows.where(F.size("r") > 0).select("repo_id", "path", F.array_join("r", ",").alias("roles"))


OVERRIDES = """ov AS (SELECT repo_id, 'lib/db/**' AS pattern, 'generated' AS role FROM (SELECT DISTINCT repo_id FROM v_code_files) a
  UNION ALL SELECT repo_id, 'src/main.ts', 'entry' FROM (SELECT DISTINCT repo_id FROM v_code_files) b WHERE repo_id LIKE '%1'
  UNION ALL SELECT repo_id, path, 'public-api' FROM v_code_files WHERE path LIKE 'lib/m%.ts' AND path NOT LIKE '%.test.ts')"""


def _overrides(t):
    repos = t["v_code_files"].select("repo_id").distinct()
    role = lambda name: F.array(F.lit(name)).alias("roles")
    libs = t["v_code_files"].where(F.col("path").like("lib/m%.ts") & ~F.col("path").like("%.test.ts"))
    return (
        repos.select("repo_id", F.lit("lib/db/**").alias("pattern"), role("generated"))
        .unionByName(repos.where("repo_id LIKE '%1'").select("repo_id", F.lit("src/main.ts").alias("pattern"), role("entry")))
        .unionByName(libs.select("repo_id", F.col("path").alias("pattern"), role("public-api")))
    )


@query("role_overrides", f"""WITH {ROLES_SQL}, {OVERRIDES}, hit AS (SELECT r.repo_id, r.path, o.role FROM roles r JOIN ov o ON o.repo_id = r.repo_id AND
  CASE WHEN contains(o.pattern, '*') THEN starts_with(r.path, 'lib/db') ELSE r.path = o.pattern END),
every AS (SELECT repo_id, path, unnest(roles) AS role FROM roles UNION SELECT * FROM hit UNION SELECT repo_id, pattern, role FROM ov WHERE NOT contains(pattern, '*'))
SELECT coalesce(a.repo_id, e.repo_id) AS repo_id, coalesce(a.path, e.path) AS path, coalesce(e.roles, '') AS roles FROM (SELECT repo_id, path FROM v_code_files) a
  FULL OUTER JOIN (SELECT repo_id, path, string_agg(role, ',' ORDER BY role) AS roles FROM every GROUP BY 1, 2) e ON a.repo_id = e.repo_id AND a.path = e.path""")
def _(t):
    return shape.override_roles(shape.file_roles(t["v_code_files"]), _overrides(t)).withColumn("roles", F.array_join("roles", ","))


def layer_sql(path: str, roles: str | None = None) -> str:
    arms = []
    if roles:
        arms += [f"WHEN list_has_any({roles}, [{', '.join(map(q, names))}]) THEN {q(layer)}" for layer, names in shape.LAYER_ROLES]
    arms += [f"WHEN {' OR '.join(f'starts_with({path}, {q(p)})' for p in pre)} THEN {q(layer)}" for layer, pre in shape.LAYER_PREFIXES]
    return f"CASE {' '.join(arms)} ELSE 'Unknown' END"


@query("layers", f"WITH {ROLES_SQL} SELECT repo_id, path, {layer_sql('path', 'roles')} AS layer FROM roles")
def _(t):
    return shape.file_roles(t["v_code_files"]).select("repo_id", "path", shape.classify_layer(F.col("path"), F.col("roles")).alias("layer"))


@query("routes", r"""SELECT repo_id, path, '/' || array_to_string(list_transform(string_split(regexp_extract(substring(path, 5), '^(.*)/[^/]*$', 1), '/'),
  lambda s: CASE WHEN regexp_matches(s, '^\[{1,2}\.\.\.([A-Za-z0-9_]+)\]{1,2}$') THEN ':' || regexp_extract(s, '^\[{1,2}\.\.\.([A-Za-z0-9_]+)\]{1,2}$', 1) || '*'
    WHEN regexp_matches(s, '^\[([A-Za-z0-9_]+)\]$') THEN ':' || regexp_extract(s, '^\[([A-Za-z0-9_]+)\]$', 1) ELSE s END), '/') AS route,
  array_to_string(list_sort(list_distinct(regexp_extract_all(content, 'export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b', 1))), ',') AS methods
FROM v_code_files WHERE regexp_matches(path, '^app/api/.*/route\.(ts|js)$') AND len(regexp_extract_all(content, 'export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b', 1)) > 0""")
def _(t):
    return shape.detect_routes(t["v_code_files"]).withColumn("methods", F.array_join(F.array_sort("methods"), ","))


def _has_sql(names) -> str:
    return "bool_or(" + " OR ".join(f"path = {q(n)} OR starts_with(path, {q(n + '/')})" for n in names) + ")"


def _scripts_sql(names, pattern) -> str:
    checks_ = " OR ".join(f"""regexp_matches(coalesce(json_extract_string(j, '$.scripts."{n}"'), ''), {q(pattern)})""" for n in names)
    return f"coalesce({checks_}, false)"


ECO_SQL = """CASE WHEN bool_or(path = 'Cargo.toml') THEN 'rust' WHEN bool_or(path = 'go.mod') THEN 'go' WHEN bool_or(path IN ('CMakeLists.txt', 'Makefile')) THEN 'cpp'
  WHEN bool_or(path IN ('pyproject.toml', 'setup.py')) THEN 'python' ELSE 'node' END"""
FW_SQL = f"""fwc AS (SELECT repo_id, {', '.join(f"bool_or(path IN ({', '.join(map(q, n))})) AS c_{name}" for name, n, _ in shape.FRAMEWORKS if n)} FROM v_code_files GROUP BY repo_id),
fw AS (SELECT p.repo_id, CASE {' '.join("WHEN " + (f"c_{name} OR " if n else "") + f"EXISTS (SELECT 1 FROM deps d WHERE d.repo_id = p.repo_id AND d.name = {q(dep)}) THEN {q(name)}" for name, n, dep in shape.FRAMEWORKS)} END AS framework FROM pkg p JOIN fwc USING (repo_id))"""
TRAITS_SQL = f"""{DEPS_SQL}, {FW_SQL}, fl AS (SELECT repo_id, {ECO_SQL} AS ecosystem, {', '.join(f'{_has_sql(n)} AS t_{k}' for k, n in shape.TRAIT_PATHS.items())},
  {' + '.join(f'CAST({_has_sql((n,))} AS INT)' for n in shape.WEAK_COMPLIANCE)} AS weak, {_has_sql(shape.DEPLOYMENT_FILES)} AS deploy,
  bool_or(path = 'Cargo.toml' AND contains(content, '[[bin]]')) AS cargo_bin, {_has_sql(('src/main.rs',))} AS main_rs, {_has_sql(('main.go',))} AS main_go FROM v_code_files GROUP BY repo_id),
k AS (SELECT fl.*, j, framework, coalesce(framework, '') AS fwn, t_long_running_server OR {_scripts_sql(*shape.SERVER_SCRIPTS)} AS srv FROM fl LEFT JOIN pkg USING (repo_id) LEFT JOIN fw USING (repo_id)),
traits AS (SELECT repo_id, ecosystem, framework, t_api_routes AS has_api_routes,
  ecosystem = 'node' AND (t_frontend_bundle OR fwn IN ('nextjs', 'remix', 'nuxt', 'vite')) AS has_frontend_bundle,
  coalesce(json_exists(j, '$.exports') OR json_exists(j, '$.main') OR json_exists(j, '$.module') OR json_exists(j, '$.source'), false) AS has_package_library_shape,
  t_test_suite OR {_scripts_sql(*shape.TEST_SCRIPTS)} AS has_test_suite, srv AS has_long_running_server, t_api_routes OR srv OR deploy AS has_deployable_service,
  t_cli_entrypoint OR coalesce(json_exists(j, '$.bin'), false) OR (ecosystem = 'rust' AND (cargo_bin OR main_rs)) OR (ecosystem = 'go' AND main_go) AS has_cli_entrypoint,
  t_compliance OR coalesce(regexp_matches(json_extract_string(j, '$.name'), {q(shape.COMPLIANCE_NAME)}), false) OR weak >= 2 AS has_compliance_signals, t_agent_tooling AS has_agent_tooling_signals FROM k)"""
ARCH_SQL = """arch AS (SELECT *, CASE WHEN has_compliance_signals THEN 'compliance-sensitive' WHEN has_agent_tooling_signals THEN 'agent-tooling'
  WHEN has_cli_entrypoint AND NOT has_frontend_bundle AND NOT has_api_routes THEN 'cli'
  WHEN has_package_library_shape AND NOT has_frontend_bundle AND NOT has_api_routes AND NOT has_long_running_server AND NOT has_cli_entrypoint THEN 'library'
  WHEN coalesce(framework, '') IN ('nextjs', 'remix', 'nuxt') THEN 'web-app' WHEN coalesce(framework, '') IN ('express', 'fastify', 'hono') THEN 'api-service'
  WHEN has_api_routes OR has_deployable_service OR has_long_running_server THEN CASE WHEN has_frontend_bundle THEN 'web-app' ELSE 'api-service' END
  WHEN has_frontend_bundle THEN 'web-app' WHEN ecosystem <> 'node' THEN 'cli' ELSE 'prototype' END AS archetype FROM traits)"""


def _sliced(sql: str) -> str:
    """The same oracle text over the view whose repositories differ in their folders."""
    return f"WITH {sql.replace('v_code_files', 'v_sliced_files')}"


TRAIT_COLS = "repo_id, ecosystem, framework, has_api_routes, has_frontend_bundle, has_package_library_shape, has_test_suite, has_long_running_server, has_deployable_service, has_cli_entrypoint, has_compliance_signals, has_agent_tooling_signals"


@query("repo_traits", _sliced(f"{TRAITS_SQL} SELECT {TRAIT_COLS} FROM traits"))
def _(t):
    return shape.repo_traits(t["v_sliced_files"])


@query("ecosystem", f"SELECT repo_id, {ECO_SQL} AS ecosystem FROM v_code_files GROUP BY repo_id")
def _(t):
    return shape.ecosystem(t["v_code_files"])


@query("framework", f"WITH {DEPS_SQL}, {FW_SQL} SELECT repo_id, framework FROM fw")
def _(t):
    return shape.frameworks(t["v_code_files"])


@query("archetype", _sliced(f"{TRAITS_SQL}, {ARCH_SQL} SELECT repo_id, archetype FROM arch"))
def _(t):
    return shape.archetype(shape.repo_traits(t["v_sliced_files"])).select("repo_id", "archetype")


LANG_SQL = f"""lc AS (SELECT repo_id, {case("lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1))", shape.EXTENSION_LANGUAGES, 'NULL')} AS language, count(*) AS files FROM v_code_files
  WHERE len(list_filter(string_split(path, '/')[1:-2], lambda d: d IN ('node_modules', '.git', 'dist', 'build', 'target', 'vendor', '.next', '.turbo', 'coverage', '__pycache__') OR starts_with(d, '.'))) = 0 GROUP BY 1, 2 HAVING language IS NOT NULL),
tsr AS (SELECT repo_id, bool_or(path = 'tsconfig.json') AS ts FROM v_code_files GROUP BY 1),
lm AS (SELECT repo_id, CASE WHEN l = 'javascript' AND ts THEN 'typescript' ELSE l END AS language, min(o) AS o FROM (SELECT repo_id, {case('path', dict(shape.LANGUAGE_MARKERS), 'NULL')} AS l, {case('path', {n: i for i, (n, _) in enumerate(shape.LANGUAGE_MARKERS)}, '99')} AS o FROM v_code_files) x JOIN tsr USING (repo_id) WHERE l IS NOT NULL GROUP BY 1, 2),
lb AS (SELECT coalesce(lc.repo_id, lm.repo_id) AS repo_id, coalesce(lc.language, lm.language) AS language, coalesce(files, 0) AS n, o FROM lc FULL OUTER JOIN lm ON lc.repo_id = lm.repo_id AND lc.language = lm.language),
langs AS (SELECT repo_id, CASE WHEN count(o) = 1 THEN arg_min(language, o) FILTER (o IS NOT NULL) ELSE coalesce(arg_min(language, (-n, language)) FILTER (n > 0), arg_min(language, o) FILTER (o IS NOT NULL)) END AS primary_language,
  string_agg(language, ',' ORDER BY n DESC, language) AS languages FROM lb GROUP BY repo_id)"""


@query("repo_languages", _sliced(f"{LANG_SQL} SELECT * FROM langs"))
def _(t):
    return shape.repo_languages(t["v_sliced_files"])


def _applies_sql(module: str) -> str:
    service = "(has_api_routes OR has_long_running_server OR has_deployable_service OR archetype IN ('web-app', 'api-service'))"
    library = "(has_package_library_shape OR archetype IN ('library', 'cli'))"
    documented = "(archetype IN ('agent-tooling', 'library', 'compliance-sensitive') OR has_frontend_bundle)"
    return {
        "api-health": service, "dead-code": f"({library} OR has_frontend_bundle)", "test-coverage": "(has_test_suite OR archetype <> 'prototype')",
        "test-quality": "(has_test_suite OR archetype <> 'prototype')", "doc-staleness": documented, "git-health": "(archetype <> 'prototype' OR has_cli_entrypoint)",
    }.get(module, "true")


def _allowed_sql() -> str:
    js, go, rust = "(contains(languages, 'typescript') OR contains(languages, 'javascript'))", "list_contains(string_split(languages, ','), 'go')", "contains(languages, 'rust')"
    fam = {"js": js, "go": go, "rust": rust}
    none = f"NOT ({js} OR {go} OR {rust})"
    rows = [(m, "true") for m in shape.UNIVERSAL_MODULES] + [(m, f"({fam[f]} OR {none})") for f, ms in shape.LANGUAGE_MODULES.items() for m in ms]
    parts = []
    for m, cond in rows:
        off = [p for p, mods in shape.PROFILE_INAPPLICABLE.items() if m in mods]
        deny = f" AND archetype NOT IN ({', '.join(map(q, off))})" if off else ""
        parts.append(f"SELECT repo_id, {q(m)} AS module_id FROM al WHERE {cond} AND {_applies_sql(m)}{deny}")
    return f"al AS (SELECT arch.*, languages FROM arch JOIN langs USING (repo_id)), allowed AS ({' UNION ALL '.join(parts)})"


def _allowed(t):
    files = t["v_sliced_files"]
    repos = shape.archetype(shape.repo_traits(files)).join(shape.repo_languages(files), "repo_id")
    return shape.allowed_modules(repos)


@query("allowed_modules", _sliced(f"{TRAITS_SQL}, {ARCH_SQL}, {LANG_SQL}, {_allowed_sql()} SELECT * FROM allowed"))
def _(t):
    return _allowed(t)


SWITCH_SQL = """sw AS (SELECT DISTINCT repo_id, 'go-security' AS module_id, true AS enabled FROM v_code_files WHERE repo_id LIKE '%7' UNION ALL SELECT DISTINCT repo_id, 'security', true FROM v_code_files WHERE repo_id LIKE '%7'
  UNION ALL SELECT DISTINCT repo_id, 'dependencies', false FROM v_code_files WHERE repo_id LIKE '%3')"""


@query("enabled_modules", _sliced(f"""{TRAITS_SQL}, {ARCH_SQL}, {LANG_SQL}, {_allowed_sql()}, {SWITCH_SQL},
base AS (SELECT repo_id, module_id FROM allowed WHERE module_id IN ({', '.join(map(q, shape.DEFAULT_MODULES))}) AND repo_id NOT IN (SELECT repo_id FROM sw WHERE enabled) UNION SELECT repo_id, module_id FROM sw WHERE enabled)
SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM sw WHERE NOT enabled AND sw.repo_id = b.repo_id AND sw.module_id = b.module_id)"""))
def _(t):
    repos = t["v_sliced_files"].select("repo_id").distinct()
    on = repos.where("repo_id LIKE '%7'").select("repo_id", F.explode(F.array(F.lit("go-security"), F.lit("security"))).alias("module_id"), F.lit(True).alias("enabled"))
    off = repos.where("repo_id LIKE '%3'").select("repo_id", F.lit("dependencies").alias("module_id"), F.lit(False).alias("enabled"))
    return shape.enabled_modules(_allowed(t), on.unionByName(off))


@query("config_layers", """WITH l AS (SELECT repo_id, 'budget' AS key, '100000' AS value, 0 AS priority FROM v_repos UNION ALL SELECT repo_id, 'profile', 'web-app', 0 FROM v_repos
  UNION ALL SELECT repo_id, 'profile', json_extract_string(metadata, '$.mode'), 1 FROM v_repos WHERE stars > 50 UNION ALL SELECT repo_id, 'budget', json_extract_string(doc, '$.aiTokenBudget'), 2 FROM v_config_docs WHERE repo_id % 2 = 0)
SELECT repo_id, key, arg_max(value, priority) AS value, max(priority) AS priority FROM l GROUP BY repo_id, key""")
def _(t):
    repos, docs = t["v_repos"], t["v_config_docs"]

    def layer(df, key, value, priority):
        return df.select("repo_id", F.lit(key).alias("key"), value.alias("value"), F.lit(priority).alias("priority"))

    layers = layer(repos, "budget", F.lit("100000"), 0).unionByName(layer(repos, "profile", F.lit("web-app"), 0))
    layers = layers.unionByName(layer(repos.where("stars > 50"), "profile", F.get_json_object("metadata", "$.mode"), 1))
    layers = layers.unionByName(layer(docs.where("repo_id % 2 = 0"), "budget", F.get_json_object("doc", "$.aiTokenBudget"), 2))
    return shape.layered_config(layers)


@query("profile_alias", """SELECT repo_id, json_extract_string(doc, '$.profile') AS raw, CASE json_extract_string(doc, '$.profile') WHEN 'solo' THEN 'prototype' WHEN 'team' THEN 'web-app' WHEN 'enterprise' THEN 'compliance-sensitive'
  WHEN 'unknown' THEN NULL ELSE json_extract_string(doc, '$.profile') END AS profile FROM v_config_docs""")
def _(t):
    raw = F.get_json_object("doc", "$.profile")
    return t["v_config_docs"].select("repo_id", raw.alias("raw"), shape.normalize_profile(raw).alias("profile"))


@query("module_group", """SELECT DISTINCT event_type AS module_id, CASE WHEN event_type = 'view' THEN 'ai' WHEN starts_with(concat('go-', event_type), 'go-c') THEN 'go-native' ELSE 'static' END AS module_group FROM events""")
def _(t):
    event = F.col("event_type")
    module = F.when(event.startswith("c"), F.concat(F.lit("go-"), event)).otherwise(event)
    category = F.when(event == "view", "ai").otherwise("static")
    return t["events"].select(event.alias("module_id"), shape.module_group(module, category).alias("module_group")).distinct()


def _config_sql() -> str:
    def one(path, name):
        return f"max(CASE WHEN path = {q(path)} THEN content END) AS {name}"

    ci = " OR ".join(f"path = {q(p)} OR starts_with(path, {q(p + '/')})" for p in checks.CI_PATHS)
    facts = f"""cf AS (SELECT repo_id, {one('tsconfig.json', 'ts')}, {one('package.json', 'pj')}, {one('.gitignore', 'gi')}, {one('Dockerfile', 'df')}, bool_or(path = '.env') AS env, bool_or(path = '.dockerignore') AS di,
      bool_or(path IN ({', '.join(map(q, checks.LINT_CONFIGS))})) AS lint, bool_or(path IN ({', '.join(map(q, checks.ENV_TEMPLATES))})) AS envt, bool_or({ci}) AS ci FROM v_code_files GROUP BY repo_id),
    cg AS (SELECT cf.*, arch.archetype, try_cast({TSDOC.replace('content', 'ts')} AS JSON) AS tj, try_cast(pj AS JSON) AS kj FROM cf LEFT JOIN arch USING (repo_id)),
    ch AS (SELECT *, coalesce(json_extract_string(tj, '$.compilerOptions.strict') = 'true', false) AS strict, coalesce(archetype = 'prototype', false) AS proto FROM cg)"""
    rows = [
        ("'medium'", "tsconfig.json", "tsconfig", "not valid JSON", "ts IS NOT NULL AND tj IS NULL"),
        ("'medium'", "tsconfig.json", "tsconfig", "strict mode is not enabled", "tj IS NOT NULL AND NOT strict"),
        ("'high'", "package.json", "package-json", "not valid JSON", "pj IS NOT NULL AND kj IS NULL"),
        ("'medium'", ".", "eslint", "no lint configuration", "NOT lint AND NOT coalesce(json_exists(kj, '$.eslintConfig'), false)"),
        ("'high'", ".gitignore", "gitignore", "no .gitignore", "gi IS NULL"),
        ("'medium'", ".env", "env", "no .env template", "env AND NOT envt"),
        ("'medium'", "Dockerfile", "docker", "no non-root USER", "df IS NOT NULL AND NOT regexp_matches(df, '(?im)^\\s*USER\\s+')"),
        ("'low'", "Dockerfile", "docker", "no .dockerignore", "df IS NOT NULL AND NOT di"),
        ("'medium'", ".", "ci", "no CI configuration", "NOT ci AND NOT proto"),
    ]
    for flag in checks.COMPILER_FLAGS:
        implied = " AND NOT strict" if flag in ("noImplicitAny", "strictNullChecks") else ""
        rows.append(("'info'", "tsconfig.json", "tsconfig", f"missing {flag}", f"tj IS NOT NULL{implied} AND NOT json_exists(tj, '$.compilerOptions.{flag}')"))
    for field, sev, soft in (("description", "low", "info"), ("license", "low", "info"), ("engines", "info", "info")):
        rows.append((f"CASE WHEN proto THEN '{soft}' ELSE '{sev}' END", "package.json", "package-json", f"missing {field}", f"kj IS NOT NULL AND coalesce(json_extract_string(kj, '$.{field}'), '') = ''"))
    keys = "json_keys(kj, '$.scripts')"
    val = """json_extract_string(kj, '$.scripts."' || s || '"')"""
    for word, cond in (("lint", f"regexp_matches(s, '(?i)^lint') OR regexp_matches({val}, '(?i)eslint|biome|oxlint')"), ("test", f"regexp_matches(s, '(?i)^test') AND NOT contains({val}, 'no test')"), ("build", "regexp_matches(s, '(?i)^build')")):
        rows.append(("'info'", "package.json", "package-json", f"no {word} script", f"kj IS NOT NULL AND len(list_filter(coalesce({keys}, []), lambda s: {cond})) = 0"))
    for label, pattern in checks.GITIGNORE_ENTRIES:
        rows.append(("'info'", ".gitignore", "gitignore", f"missing {label}", f"gi IS NOT NULL AND len(list_filter(string_split(gi, chr(10)), lambda s: regexp_matches(trim(s), {q(pattern)}))) = 0"))
    body = " UNION ALL ".join(f"SELECT repo_id, {sev} AS severity, {q(path)} AS file_path, {q(cat)} AS category, {q(msg)} AS message FROM ch WHERE {cond}" for sev, path, cat, msg, cond in rows)
    wild = "SELECT repo_id, 'high', 'package.json', 'package-json', concat('wildcard version for ', name, ' in ', kind) FROM deps WHERE version IN ('*', 'latest')"
    return f"{facts}, cfind AS ({body} UNION ALL {wild})"


def _config_findings(t):
    files = t["v_sliced_files"]
    arch = shape.archetype(shape.repo_traits(files)).select("repo_id", "archetype")
    return checks.config_checks(files, arch)


@query("config_checks", _sliced(f"{TRAITS_SQL}, {ARCH_SQL}, {_config_sql()} SELECT * FROM cfind"))
def _(t):
    return _config_findings(t)


@query("config_score", _sliced(f"{TRAITS_SQL}, {ARCH_SQL}, {_config_sql()} SELECT repo_id, count(*) AS findings, CAST(greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 8 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 1 END)) AS INT) AS score FROM cfind GROUP BY repo_id"))
def _(t):
    return deduction_score(_config_findings(t), ["repo_id"], deduction_points("config-quality", F.col("severity")))


@query("observability_score", _sliced(f"""{TRAITS_SQL}, {ARCH_SQL}, {OBS_SQL}, lg AS (SELECT repo_id, count(*) AS n FROM ({_libs_sql(checks.LOG_LIBS)}) a GROUP BY 1), mo AS (SELECT repo_id, count(*) AS n FROM ({_libs_sql(checks.MONITOR_LIBS)}) b GROUP BY 1),
j2 AS (SELECT obs.*, arch.* EXCLUDE (repo_id), coalesce(lg.n, 0) AS lgn, coalesce(mo.n, 0) AS mon FROM obs JOIN arch USING (repo_id) LEFT JOIN lg USING (repo_id) LEFT JOIN mo USING (repo_id)),
s AS (SELECT *, CASE WHEN has_api_routes OR has_long_running_server OR has_deployable_service OR archetype IN ('web-app', 'api-service', 'compliance-sensitive') THEN 20 WHEN has_frontend_bundle THEN 35
   WHEN archetype IN ('cli', 'library', 'prototype') THEN 70 WHEN archetype = 'agent-tooling' THEN 45 ELSE 50 END
   + CASE WHEN lgn > 0 THEN 20 ELSE 0 END + CASE WHEN mon > 0 THEN 20 ELSE 0 END + CASE WHEN console_files = 0 THEN 10 WHEN console_files <= 3 THEN 5 ELSE 0 END + CASE WHEN error_boundary THEN 10 ELSE 0 END
   + CASE WHEN health_files > 0 THEN 15 ELSE 0 END + CASE WHEN api_routes > 0 AND unguarded_routes = 0 THEN 10 ELSE 0 END + CASE WHEN instrumentation THEN 5 ELSE 0 END + CASE WHEN ci THEN 10 ELSE 0 END AS raw,
   CASE WHEN lgn = 0 THEN 20 ELSE 0 END + CASE WHEN mon = 0 THEN 20 ELSE 0 END + CASE WHEN health_files = 0 THEN 15 ELSE 0 END + CASE WHEN NOT ci THEN 10 ELSE 0 END AS gain FROM j2)
SELECT repo_id, least(100, raw) AS score, least(100, least(100, raw) + gain) AS projected FROM s"""))
def _(t):
    files = t["v_sliced_files"]

    def count(libs, name):
        return checks.lib_presence(files, libs).groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))

    facts = checks.observability_facts(files).join(shape.archetype(shape.repo_traits(files)), "repo_id")
    facts = facts.join(count(checks.LOG_LIBS, "log_libs"), "repo_id", "left").join(count(checks.MONITOR_LIBS, "monitor_libs"), "repo_id", "left")
    return checks.observability_score(facts.na.fill({"log_libs": 0, "monitor_libs": 0}))


@query("jsonc", f"SELECT repo_id, path, try_cast({TSDOC} AS JSON) IS NOT NULL AS parses, json_extract_string(try_cast({TSDOC} AS JSON), '$.compilerOptions.strict') AS strict FROM v_code_files WHERE path LIKE 'tsconfig%'")
def _(t):
    rows = t["v_code_files"].where(F.col("path").like("tsconfig%")).select("repo_id", "path", D.read_jsonc(F.col("content")).alias("j"))
    return rows.select("repo_id", "path", F.col("j").isNotNull().alias("parses"), F.try_variant_get("j", "$.compilerOptions.strict", "string").alias("strict"))


@query("repo_meta", """SELECT repo_id, json_extract_string(metadata, '$.description') AS description, json_extract_string(metadata, '$.language') AS language, coalesce(CAST(json_extract_string(metadata, '$.stargazers_count') AS BIGINT), 0) AS stars,
  coalesce(CAST(json_extract_string(metadata, '$.forks_count') AS BIGINT), 0) AS forks, coalesce(CAST(json_extract_string(metadata, '$.open_issues_count') AS BIGINT), 0) AS open_issues, CAST(NULL AS VARCHAR) AS license, concat(json_extract_string(metadata, '$.topics[0]'), ',', json_extract_string(metadata, '$.topics[1]')) AS topics, '' AS created_at, '' AS pushed_at FROM v_repos""")
def _(t):
    return t["v_repos"].select("repo_id", D.repo_metadata(F.col("metadata")).alias("m")).select("repo_id", "m.*")


WORK_SQL = f"""{PKG}, ws AS (SELECT repo_id, unnest(json_extract_string(j, '$.workspaces[*]')) AS pattern FROM pkg WHERE json_type(j, '$.workspaces') = 'ARRAY'
  UNION ALL SELECT repo_id, unnest(list_transform(regexp_extract_all(regexp_extract(content, 'packages:((?:\\n  - [^\\n]*)*)', 1), '- ([^\\n]*)', 1), lambda s: trim(s, chr(39)))) FROM v_code_files WHERE path = 'pnpm-workspace.yaml')"""


@query("workspaces", f"WITH {WORK_SQL} SELECT * FROM ws")
def _(t):
    return D.workspace_patterns(t["v_code_files"])


@query("workspace_match", f"""WITH {WORK_SQL}, d AS (SELECT repo_id, regexp_extract(path, '^(.*)/package.json$', 1) AS directory FROM v_code_files WHERE path LIKE '%/package.json')
SELECT DISTINCT d.repo_id, d.directory FROM d JOIN ws USING (repo_id) WHERE (pattern = 'packages/*' AND regexp_matches(directory, '^packages/[^/]+$')) OR (pattern = 'apps/**' AND regexp_matches(directory, '^apps(/|$)'))
  OR (pattern = 'libs/*' AND regexp_matches(directory, '^libs/[^/]+$')) OR directory = pattern""")
def _(t):
    return D.match_workspaces(t["v_code_files"], D.workspace_patterns(t["v_code_files"]))


@query("entry_points", """WITH p AS (SELECT repo_id, CAST(content AS JSON) AS j FROM v_code_files WHERE path = 'package.json'),
raw AS (SELECT repo_id, json_extract_string(j, '$.main') AS e FROM p UNION SELECT repo_id, json_extract_string(j, '/exports/./import') FROM p UNION SELECT repo_id, json_extract_string(j, '/exports/./require') FROM p)
SELECT DISTINCT repo_id, regexp_replace(e, '^\\./', '') AS entry FROM raw WHERE e IS NOT NULL""")
def _(t):
    rows = t["v_code_files"].where("path = 'package.json'")
    return rows.select("repo_id", F.explode(shape.entry_points(F.col("content"))).alias("entry"))
