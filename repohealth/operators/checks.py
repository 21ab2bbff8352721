"""Checks that turn facts into findings: configuration, observability, probes, config documents, complexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repohealth.functions.paths import extension, present
from repohealth.functions.scalars import clamp, computed_once, count_if, exact_avg, half_up, matches, strict_json, strip, strip_json_comments
from repohealth.functions.severity import soften
from repohealth.operators import shape
from repohealth.operators.ordered import top_per_key
from repohealth.operators.scoring import PROFILE_ALIASES, PROFILE_WEIGHTS, maintainability
from repohealth.operators.rules import decision_count
from repohealth.sources.files import CODE_EXTENSIONS, line_count

# Files that configure a linter, template an environment, or run continuous integration.
LINT_CONFIGS = (
    "eslint.config.js", "eslint.config.mjs", "eslint.config.cjs", "eslint.config.ts", "eslint.config.mts",
    "eslint.config.cts", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.json", ".eslintrc.yml", ".eslintrc.yaml",
    ".eslintrc", "biome.json", "biome.jsonc",
)
ENV_TEMPLATES = (".env.example", ".env.sample", ".env.template")
CI_PATHS = (
    ".github/workflows", ".gitlab-ci.yml", ".circleci", "Jenkinsfile", ".travis.yml", "azure-pipelines.yml",
    "bitbucket-pipelines.yml",
)
COMPILER_FLAGS = ("noImplicitAny", "strictNullChecks", "esModuleInterop", "skipLibCheck")
GITIGNORE_ENTRIES = (("node_modules", r"^node_modules/?$"), (".env", r"^\.env$"), ("dist/build", r"^(dist|build)/?$"))

# Libraries whose presence signals structured logging or monitoring.
LOG_LIBS = (
    "winston", "pino", "bunyan", "log4js", "loglevel", "roarr", "signale", "tslog", "consola", "structlog",
    "loguru", "slog", "zap", "logrus", "zerolog",
)
MONITOR_LIBS = (
    "@sentry/node", "@sentry/nextjs", "@sentry/react", "@sentry/browser", "sentry-sdk", "newrelic",
    "@newrelic/next", "dd-trace", "datadog-metrics", "@opentelemetry/api", "@opentelemetry/sdk-node",
    "@opentelemetry/sdk-trace-node", "prom-client", "applicationinsights", "@google-cloud/logging",
    "@aws-sdk/client-cloudwatch-logs",
)
HEALTH_PATTERN = r"(?i)/health(z)?|/ready(z)?|/live(z)?|/status|/ping"
CONSOLE_PATTERN = r"\bconsole\.(log|warn|info|debug|error|trace)\s*\("
PRINT_PATTERN = r"\bprint\s*\("
BOUNDARY_PATTERN = r"ErrorBoundary|componentDidCatch|error\.tsx|error\.jsx|error\.ts|error\.js"
TRY_PATTERN = r"\btry\s*\{"
INSTRUMENTATION = ("instrumentation.ts", "instrumentation.js", "src/instrumentation.ts", "src/instrumentation.js")
OBSERVED_CI = (
    ".github/workflows", ".gitlab-ci.yml", "Jenkinsfile", ".circleci/config.yml", ".travis.yml",
    "bitbucket-pipelines.yml", "azure-pipelines.yml",
)


def _content_of(path: str) -> Column:
    """Content of one root file per repository (a repository has a path once)."""
    return F.max(F.when(F.col("path") == path, F.col("content")))


def _any_line(content: Column, pattern: str) -> Column:
    return F.exists(F.split(content, "\n"), lambda s: F.rlike(strip(s), F.lit(pattern)))


def config_checks(files: DataFrame, archetypes: DataFrame) -> DataFrame:
    """Configuration findings of every repository from one aggregate over its root files.

    ``archetypes`` is (repo_id, archetype); missing package metadata weighs less in prototypes.
    """
    roots = ("tsconfig.json", "package.json", ".gitignore", "Dockerfile", ".env", ".dockerignore") + LINT_CONFIGS + ENV_TEMPLATES
    rows = files.where(F.col("path").isin(*roots) | present(F.col("path"), CI_PATHS)).unionByName(
        files.select("repo_id").distinct().select("repo_id", F.lit("").alias("path"), F.lit("").alias("content"))
    )
    facts = rows.groupBy("repo_id").agg(
        _content_of("tsconfig.json").alias("ts"), _content_of("package.json").alias("pj"),
        _content_of(".gitignore").alias("gi"), _content_of("Dockerfile").alias("df"),
        F.bool_or(F.col("path") == ".env").alias("env"), F.bool_or(F.col("path") == ".dockerignore").alias("di"),
        F.bool_or(F.col("path").isin(*LINT_CONFIGS)).alias("lint"),
        F.bool_or(F.col("path").isin(*ENV_TEMPLATES)).alias("envt"),
        F.bool_or(present(F.col("path"), CI_PATHS)).alias("ci"),
    ).join(archetypes, "repo_id", "left")
    ts = strict_json(strip_json_comments(F.col("ts")))
    pkg = F.when(strict_json(F.col("pj")).isNotNull(), F.from_json("pj", shape.MANIFEST))
    arch = F.col("archetype")
    no = F.lit(False)

    def yes(cond: Column) -> Column:
        return F.coalesce(cond, no)

    def hit(cond: Column, severity: Column | str, path: str, category: str, message: Column | str) -> Column:
        def as_col(v):
            return v if isinstance(v, Column) else F.lit(v)

        return F.when(yes(cond), F.struct(
            as_col(severity).alias("severity"), F.lit(path).alias("file_path"), F.lit(category).alias("category"),
            as_col(message).alias("message"),
        ))

    def softer(severity: str) -> Column:
        return soften(F.lit(severity), arch)

    has_ts, ts_ok = F.col("ts").isNotNull(), ts.isNotNull()
    strict = F.coalesce(F.try_variant_get(ts, "$.compilerOptions.strict", "boolean"), no)
    out = [
        hit(has_ts & ~ts_ok, "medium", "tsconfig.json", "tsconfig", "not valid JSON"),
        hit(ts_ok & ~strict, "medium", "tsconfig.json", "tsconfig", "strict mode is not enabled"),
    ]
    for flag in COMPILER_FLAGS:
        implied = strict if flag in ("noImplicitAny", "strictNullChecks") else no
        missing = F.try_variant_get(ts, f"$.compilerOptions.{flag}", "string").isNull()
        out.append(hit(ts_ok & ~implied & missing, "info", "tsconfig.json", "tsconfig", f"missing {flag}"))
    has_pj, pkg_ok = F.col("pj").isNotNull(), pkg.isNotNull()
    out.append(hit(has_pj & ~pkg_ok, "high", "package.json", "package-json", "not valid JSON"))
    for field, severity in (("description", "low"), ("license", "low"), ("engines", "info")):
        out.append(hit(pkg_ok & (F.coalesce(pkg[field], F.lit("")) == ""), softer(severity), "package.json", "package-json", f"missing {field}"))
    scripts = F.coalesce(F.map_entries(pkg["scripts"]), F.array().cast("array<struct<key:string,value:string>>"))
    lint_script = F.exists(scripts, lambda e: F.rlike(e["key"], F.lit("(?i)^lint")) | F.rlike(e["value"], F.lit("(?i)eslint|biome|oxlint")))
    test_script = F.exists(scripts, lambda e: F.rlike(e["key"], F.lit("(?i)^test")) & ~F.contains(e["value"], F.lit("no test")))
    build_script = F.exists(scripts, lambda e: F.rlike(e["key"], F.lit("(?i)^build")))
    for ok, word in ((lint_script, "lint"), (test_script, "test"), (build_script, "build")):
        out.append(hit(pkg_ok & ~ok, softer("info"), "package.json", "package-json", f"no {word} script"))
    out += [
        hit(~F.col("lint") & F.coalesce(pkg["eslintConfig"].isNull(), F.lit(True)), "medium", ".", "eslint", "no lint configuration"),
        hit(F.col("gi").isNull(), "high", ".gitignore", "gitignore", "no .gitignore"),
    ]
    for label, pattern in GITIGNORE_ENTRIES:
        found = _any_line(F.col("gi"), pattern)
        out.append(hit(F.col("gi").isNotNull() & ~found, "info", ".gitignore", "gitignore", f"missing {label}"))
    user = _any_line(F.col("df"), r"(?i)^USER\s+")
    out += [
        hit(F.col("env") & ~F.col("envt"), "medium", ".env", "env", "no .env template"),
        hit(F.col("df").isNotNull() & ~user, "medium", "Dockerfile", "docker", "no non-root USER"),
        hit(F.col("df").isNotNull() & ~F.col("di"), "low", "Dockerfile", "docker", "no .dockerignore"),
        hit(~F.col("ci") & ~yes(arch == "prototype"), "medium", ".", "ci", "no CI configuration"),
    ]
    single = facts.select("repo_id", F.explode(F.array_compact(F.array(*out))).alias("f")).select("repo_id", "f.*")
    wild = shape.manifest_deps(shape.manifests(files)).where(F.col("version").isin("*", "latest")).select(
        "repo_id", F.lit("high").alias("severity"), F.lit("package.json").alias("file_path"),
        F.lit("package-json").alias("category"),
        F.concat(F.lit("wildcard version for "), "name", F.lit(" in "), "kind").alias("message"),
    )
    return single.unionByName(wild)


def lib_presence(files: DataFrame, libs: tuple[str, ...]) -> DataFrame:
    """Libraries found among declared packages or as text of go.mod and requirements.txt."""
    declared = shape.manifest_deps(shape.manifests(files)).where(F.col("name").isin(*libs)).select("repo_id", F.col("name").alias("lib"))
    texts = files.where(F.col("path").isin("go.mod", "requirements.txt"))
    mentioned = texts.select("repo_id", F.explode(F.array_compact(F.array(*[
        F.when(F.contains("content", F.lit(lib)), F.lit(lib)) for lib in libs
    ]))).alias("lib"))
    return declared.unionByName(mentioned).distinct()


SAMPLES = 5
# Fixed value: files that answer requests.
ROUTE_PATTERN = r"/route\.(ts|js|tsx|jsx)$|/(routes|api|controllers)/"


def observability_facts(files: DataFrame) -> DataFrame:
    """Signals per repository from its source files; console_sample has the first five paths with console output, by name.

    API routes are route handlers of any script extension and all files below a routes, api or controllers folder.
    """
    ext, path, content = extension(F.col("path")), F.col("path"), F.col("content")
    source = files.where(ext.isin(*CODE_EXTENSIONS))
    scriptish = ext.isin(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
    console = (scriptish & matches(content, CONSOLE_PATTERN)) | ((ext == ".py") & matches(content, PRINT_PATTERN))
    route = F.rlike(path, F.lit(ROUTE_PATTERN))
    flagged = source.select(
        "repo_id", "path", console.alias("console"),
        (F.rlike(path, F.lit(BOUNDARY_PATTERN)) | F.rlike(content, F.lit(BOUNDARY_PATTERN))).alias("boundary"),
        F.rlike(content, F.lit(HEALTH_PATTERN)).alias("health"), route.alias("route"),
        (route & ~matches(content, TRY_PATTERN)).alias("unguarded"),
    )
    signals = flagged.groupBy("repo_id").agg(
        count_if(F.col("console")).alias("console_files"), F.bool_or("boundary").alias("error_boundary"),
        count_if(F.col("health")).alias("health_files"), count_if(F.col("route")).alias("api_routes"),
        count_if(F.col("unguarded")).alias("unguarded_routes"),
    )
    first = top_per_key(flagged.where("console").select("repo_id", "path"), ["repo_id"], [F.col("path")], SAMPLES)
    samples = first.groupBy("repo_id").agg(F.array_join(F.sort_array(F.collect_list("path")), "|").alias("console_sample"))
    rooted = files.groupBy("repo_id").agg(
        F.bool_or(F.col("path").isin(*INSTRUMENTATION)).alias("instrumentation"),
        F.bool_or(present(F.col("path"), OBSERVED_CI)).alias("ci"),
    )
    return rooted.join(signals, "repo_id", "left").join(samples, "repo_id", "left").na.fill({
        "console_files": 0, "health_files": 0, "api_routes": 0, "unguarded_routes": 0, "error_boundary": False,
    })


def observability_score(facts: DataFrame) -> DataFrame:
    """Score from a baseline by repository shape plus the signals found; and what adding the missing ones would gain.

    ``facts`` carries log_libs, monitor_libs, archetype and the has_* traits besides ``observability_facts``.
    """
    arch = F.coalesce("archetype", F.lit(""))

    def has(name: str) -> Column:
        return F.coalesce(F.col(f"has_{name}"), F.lit(False))

    service = has("api_routes") | has("long_running_server") | has("deployable_service") | arch.isin(
        "web-app", "api-service", "compliance-sensitive")
    front = has("frontend_bundle") | (arch == "web-app")
    base = (
        F.when(service, 20).when(front, 35).when(arch.isin("cli", "library", "prototype"), 70)
        .when(arch == "agent-tooling", 45).otherwise(50)
    )

    def plus(cond: Column, points: int) -> Column:
        return F.when(cond, points).otherwise(0)

    n = F.col("console_files")
    score = (
        base + plus(F.col("log_libs") > 0, 20) + plus(F.col("monitor_libs") > 0, 20)
        + F.when(n == 0, 10).when(n <= 3, 5).otherwise(0) + plus(F.col("error_boundary"), 10)
        + plus(F.col("health_files") > 0, 15) + plus((F.col("api_routes") > 0) & (F.col("unguarded_routes") == 0), 10)
        + plus(F.col("instrumentation"), 5) + plus(F.col("ci"), 10)
    )
    gain = (
        plus(F.col("log_libs") == 0, 20) + plus(F.col("monitor_libs") == 0, 20) + plus(F.col("health_files") == 0, 15)
        + plus(~F.col("ci"), 10)
    )
    return facts.select(
        "repo_id", clamp(score).cast("int").alias("score"), F.least(F.lit(100), clamp(score) + gain).cast("int").alias("projected")
    )


SLOW_MS = 2000


def probe_findings(probes: DataFrame) -> DataFrame:
    """Findings of recorded requests; an error reports only itself, a response may report several things. DELETE is skipped."""
    status, method = F.col("status"), F.col("method")
    failed = F.col("error").isNotNull()

    def hit(cond: Column, severity: str, category: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category")))

    found = F.array_compact(F.array(
        hit(failed, "high", "endpoint-error"),
        hit(~failed & (status >= 500), "high", "server-error"),
        hit(~failed & method.isin("POST", "PUT", "PATCH") & (status >= 200) & (status < 300), "medium", "missing-validation"),
        hit(~failed & (F.col("response_ms") > SLOW_MS), "low", "slow-endpoint"),
        hit(~failed & (status < 500) & ~F.col("is_json"), "low", "non-json-response"),
    ))
    return probes.where(method != "DELETE").withColumn("f", F.explode(found)).select(
        "repo_id", "probe_id", "method", "route", "f.severity", "f.category"
    )


def probe_metrics(probes: DataFrame) -> DataFrame:
    rows = probes.where(F.col("method") != "DELETE")
    ok = F.col("error").isNull()
    bad = ok & F.col("method").isin("POST", "PUT", "PATCH") & (F.col("status") >= 200) & (F.col("status") < 300)
    return rows.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("tested"), count_if(F.col("status") >= 500).alias("server_errors"),
        count_if(bad).alias("missing_validation"), count_if(ok & (F.col("response_ms") > SLOW_MS)).alias("slow"),
        half_up(F.sum("response_ms").cast("double") / F.count(F.lit(1))).alias("avg_ms"),
    )


CONFIG_TIERS = ("pro", "max", "max-x20", "api")


# The commands a configuration may override.
CONFIG_COMMANDS = ("build", "lint", "typecheck", "test", "ci")
CONFIG_PARTS = ("commands", "modules", "ignore", "auditPrompts", "classify")


def validate_config(docs: DataFrame) -> DataFrame:
    """One row per violation in a configuration document; a document that does not parse is one violation."""
    doc, no = F.col("_doc"), F.lit(False)
    profile = F.try_variant_get(doc, "$.profile", "string")
    tier = F.try_variant_get(doc, "$.tier", "string")
    budget = F.try_variant_get(doc, "$.aiTokenBudget", "double")
    limits = F.map_values(F.from_json("doc", "thresholds map<string,double>")["thresholds"])
    # a text is parsed once, and each part taken out of it once, for all that is asked of them
    rows = computed_once(docs.select("repo_id", "doc", strict_json(F.col("doc")).alias("_doc")))
    rows = computed_once(rows.select("*", *[F.try_variant_get(doc, f"$.{name}", "variant").alias(f"_{name}") for name in CONFIG_PARTS]))
    rows = computed_once(rows.select("*", *[F.from_json(F.to_json(F.col(f"_{name}")), "map<string,variant>").alias(f"_{name}_entries") for name in CONFIG_PARTS]))

    def part(name: str) -> Column:
        return F.col(f"_{name}")

    def entries(name: str) -> Column:
        """Key and value of an object, as variants; null for anything else."""
        return F.col(f"_{name}_entries")

    def kind(value: Column) -> Column:
        return F.schema_of_variant(value)

    def is_object(name: str) -> Column:
        return kind(part(name)).startswith("OBJECT<")

    def texts(value: Column) -> Column:
        """Whether a variant is a list of texts."""
        items = F.from_json(F.to_json(value), "array<variant>")
        return kind(value).startswith("ARRAY<") & ~F.coalesce(F.exists(items, lambda v: kind(v) != "STRING"), no)

    def odd(name: str, fits) -> Column:
        """A part that is there and is no object, or has a value that does not fit."""
        return ~is_object(name) | F.exists(F.map_values(entries(name)), lambda v: ~fits(v))

    commands = F.map_filter(entries("commands"), lambda k, _: k.isin(*CONFIG_COMMANDS))
    bad_command = ~is_object("commands") | F.exists(F.map_values(commands), lambda v: ~kind(v).isin("STRING", "VOID"))
    known = tuple(PROFILE_WEIGHTS) + tuple(PROFILE_ALIASES)

    def hit(cond: Column, message: str) -> Column:
        return F.when(F.coalesce(cond, no), F.lit(message))

    found = F.array_compact(F.array(
        hit(doc.isNull(), "invalid JSON"),
        hit(F.exists(limits, lambda v: (v < 0) | (v > 100)), "threshold outside 0..100"),
        hit((budget <= 0) | (budget != F.floor(budget)), "budget not a positive integer"),
        hit(~tier.isin(*CONFIG_TIERS), "unknown tier"),
        hit(~profile.isin(*known), "unknown profile"),
        hit(bad_command, "command is neither text nor null"),
        hit(odd("modules", lambda v: kind(v) == "BOOLEAN"), "module switch is not a boolean"),
        hit(~texts(part("ignore")), "ignore is not a list of texts"),
        hit(odd("auditPrompts", lambda v: kind(v) == "STRING"), "prompt is not a text"),
        hit(odd("classify", lambda v: (kind(v) == "STRING") | texts(v)), "role is neither text nor a list of texts"),
    ))
    return rows.select("repo_id", F.explode(found).alias("violation"))


def complexity_facts(files: DataFrame) -> DataFrame:
    """Lines and decision count per script file."""
    scripts = files.where(extension(F.col("path")).isin(".ts", ".tsx", ".js", ".jsx"))
    return scripts.select("repo_id", "path", line_count(F.col("content")).alias("loc"), decision_count(F.col("content")).alias("complexity"))


def complexity_metrics(facts: DataFrame) -> DataFrame:
    out = facts.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("loc").alias("total_loc"), F.max("complexity").alias("max_complexity"),
        count_if(F.col("complexity") > 10).alias("complex_files"), count_if(F.col("loc") > 500).alias("long_files"),
        exact_avg(F.col("complexity")).alias("_cx"), exact_avg(F.col("loc")).alias("_loc"),
    )
    return out.select(
        "repo_id", "files", "total_loc", "max_complexity", "complex_files", "long_files",
        (half_up(F.col("_cx") * 100) / F.lit(100)).alias("avg_complexity"),
        maintainability(F.col("_loc"), F.col("_cx")).alias("maintainability"),
    )


def complexity_findings(facts: DataFrame) -> DataFrame:
    """Complex files and long files; ``facts`` carries roles, API routes may be longer and UI kits are exempt."""
    roles = F.col("roles")
    limit = F.when(F.array_contains(roles, "api-route"), 800).otherwise(500)
    cx, loc = F.col("complexity"), F.col("loc")

    def hit(cond: Column, severity: Column, category: str) -> Column:
        return F.when(cond, F.struct(severity.alias("severity"), F.lit(category).alias("category")))

    found = F.array_compact(F.array(
        hit(cx > 10, F.when(cx > 25, "high").when(cx > 15, "medium").otherwise("low"), "high-complexity"),
        hit(~F.array_contains(roles, "ui-kit") & (loc > limit), F.when(loc > limit * 2, "high").otherwise("medium"), "long-file"),
    ))
    return facts.withColumn("f", F.explode(found)).select("repo_id", "path", "loc", "complexity", "f.severity", "f.category")
