"""Shape of a repository: file roles, layers, routes, traits, framework, archetype, languages, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repohealth.functions.paths import basename, dirname, extension, present, starts_with_any
from repohealth.functions.scalars import keep_found, strict_json, strip, strip_json_comments
from repohealth.functions.severity import lookup
from repohealth.operators.scoring import PROFILE_ALIASES, PROFILE_INAPPLICABLE, PROFILE_WEIGHTS

# Roles given by path.
PATH_ROLES = (
    ("api-route", r"^app/api/.*\.tsx?$"), ("ui-kit", r"^components/ui/"), ("provider", r"^lib/ai/providers/"),
    ("cli-entrypoint", r"^bin/"), ("mcp-tool", r"^mcp-server/"),
)
# Path prefixes of the architecture layers, tested in this order.
LAYER_PREFIXES = (
    ("API", ("app/api/", "pages/api/")),
    ("UI", ("app/", "pages/", "components/", "src/components/", "src/app/")),
    ("Data", ("db/", "drizzle/", "prisma/", "src/db/", "lib/db/", "src/lib/db/")),
    ("Business", ("lib/", "src/lib/", "services/", "src/services/")),
    ("Utils", ("utils/", "helpers/", "src/utils/", "src/helpers/")),
    ("Infra", ("bin/", "mcp-server/", "scripts/", "src/bin/")),
)
# Roles that decide the layer before the path does.
LAYER_ROLES = (("API", ("api-route",)), ("UI", ("ui-kit",)), ("Infra", ("cli-entrypoint", "mcp-tool")))
# Imports a layer should not make.
FORBIDDEN_IMPORTS = {"UI": ("Data",), "Data": ("UI",), "Utils": ("Business", "UI", "API"), "Infra": ("UI",)}

# Lines of a barrel file.
REEXPORT = r"^export\s+\{[^}]*\}\s+from\s+['\x22]|^export\s+\*\s+from\s+['\x22]|^export\s+type\s+\{[^}]*\}\s+from\s+['\x22]"
IGNORABLE = r"^$|^//|^/\*|^\*|^['\x22]use strict['\x22];$"
ROUTE_EXPORT = r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"

# Paths that reveal a trait, scripts that reveal one, and deployment files.
TRAIT_PATHS = {
    "api_routes": ("app/api", "pages/api", "server/api", "src/server/api"),
    "frontend_bundle": ("app", "pages", "components", "src/components", "public"),
    "test_suite": ("test", "tests", "__tests__", "spec", "specs", "e2e", "integration"),
    "long_running_server": ("server", "src/server", "app/server"),
    "cli_entrypoint": ("bin", "cli", "scripts"),
    "compliance": ("compliance", "hipaa", "gdpr", "soc2", "privacy"),
    "agent_tooling": ("mcp-server", "prompts", "prompt", "agents", "playbooks", ".codex-plugin", "app/api/mcp", "src/mcp"),
}
WEAK_COMPLIANCE = ("security", "audit", "audits", "policy")
DEPLOYMENT_FILES = (
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "vercel.json", "fly.toml", "render.yaml",
    "railway.toml", "Procfile",
)
TEST_SCRIPTS = (("test", "test:ci", "coverage", "check"), r"(?i)(vitest|jest|playwright|cypress|coverage|test)")
SERVER_SCRIPTS = (
    ("start", "serve", "dev"), r"(?i)(node|tsx|ts-node|nodemon|next|nuxt|vite|express|fastify|hono|webpack)",
)
COMPLIANCE_NAME = r"(?i)(compliance|hipaa|gdpr|soc2|privacy)"
# Frameworks in order of preference with their config files and package.
FRAMEWORKS = (
    ("nextjs", ("next.config.js", "next.config.mjs", "next.config.ts"), "next"),
    ("express", (), "express"), ("fastify", (), "fastify"), ("hono", (), "hono"),
    ("remix", ("remix.config.js", "remix.config.ts"), "@remix-run/node"),
    ("nuxt", ("nuxt.config.ts", "nuxt.config.js"), "nuxt"),
    ("vite", ("vite.config.ts", "vite.config.js", "vite.config.mjs"), "vite"),
    ("electron", (), "electron"),
)
# Manifests that mark a language, and the language of a file extension.
LANGUAGE_MARKERS = (
    ("Cargo.toml", "rust"), ("go.mod", "go"), ("requirements.txt", "python"), ("pyproject.toml", "python"),
    ("setup.py", "python"), ("package.json", "javascript"),
)
EXTENSION_LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript",
    ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".go": "go", ".rs": "rust", ".py": "python",
    ".pyi": "python",
}
# Modules every repository may run, and modules of a language family.
UNIVERSAL_MODULES = ("git-health", "naming-quality", "doc-staleness", "arch-smells", "test-quality")
LANGUAGE_MODULES = {
    "js": ("security", "dependencies", "complexity", "dead-code", "circular-deps", "test-coverage", "ast-rules",
           "compliance", "api-health"),
    "go": ("go-security", "go-dependencies", "go-complexity", "go-dead-code", "go-test-coverage"),
    "rust": ("rust-security", "rust-dependencies", "rust-complexity", "rust-dead-code", "rust-test-coverage"),
}
# Modules that are on unless a config says otherwise.
DEFAULT_MODULES = (
    "security", "dependencies", "complexity", "git-health", "dead-code", "circular-deps", "test-coverage", "ast-rules",
    "go-security", "go-dependencies", "go-complexity", "go-dead-code", "go-test-coverage", "rust-security",
    "rust-dependencies", "rust-complexity", "rust-dead-code", "rust-test-coverage", "type-safety", "secrets-scan",
    "config-quality", "telemetry-observability", "build", "lint", "typecheck", "test", "file-size",
)

MANIFEST = (
    "name string, description string, license string, engines string, main string, module string, source string, "
    "exports string, bin string, eslintConfig string, workspaces string, scripts map<string,string>, "
    "dependencies map<string,string>, devDependencies map<string,string>"
)


def path_roles(path: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.rlike(path, F.lit(p)), F.lit(role)) for role, p in PATH_ROLES]))


def is_barrel(path: Column, content: Column) -> Column:
    """An index.ts(x) whose only statements are re-exports, at least one of them."""
    lines = F.transform(F.split(content, "\n"), lambda s: strip(s))
    telling = F.filter(lines, lambda s: ~F.rlike(s, F.lit(IGNORABLE)))
    named = F.rlike(basename(path), F.lit(r"^index\.tsx?$"))
    return named & (F.size(telling) > 0) & F.forall(telling, lambda s: F.rlike(s, F.lit(REEXPORT)))


def inline_roles(path: Column, content: Column, tag: str = "@role") -> Column:
    """Roles named in a tag comment within the first five lines of a script."""
    head = F.slice(F.split(content, "\n"), 1, 5)
    found = F.transform(head, lambda s: F.regexp_extract(s, rf"//\s*{tag}\s+(.+)", 1))
    words = F.flatten(F.transform(F.filter(found, lambda s: s != ""), lambda s: F.split(strip(s), r"\s+")))
    return F.when(F.rlike(basename(path), F.lit(r"\.[jt]sx?$")), words).otherwise(F.array().cast("array<string>"))


def file_roles(files: DataFrame) -> DataFrame:
    """All roles a file gets from its path, its content and its tag comments."""
    path, content = F.col("path"), F.col("content")
    barrel = F.when(is_barrel(path, content), F.array(F.lit("barrel-file"), F.lit("public-api"))).otherwise(
        F.array().cast("array<string>")
    )
    roles = F.array_distinct(F.concat(path_roles(path), barrel, inline_roles(path, content)))
    return files.select("repo_id", "path", F.array_sort(roles).alias("roles"))


def override_roles(roles: DataFrame, overrides: DataFrame) -> DataFrame:
    """Roles from repository configs: exact paths and prefix globs; an exact path is added even if no file has it.

    ``overrides`` is (repo_id, pattern, roles). The globs of a repository are one
    short list on its row, so files meet them by an equi join on the repository.
    """
    is_glob = F.col("pattern").contains("*")
    prefix = F.regexp_replace("pattern", r"/?\*+$", "")
    globs = overrides.where(is_glob).groupBy("repo_id").agg(
        F.collect_list(F.struct(prefix.alias("prefix"), F.col("roles").alias("extra"))).alias("_globs")
    )
    exact = overrides.where(~is_glob).groupBy("repo_id", F.col("pattern").alias("path")).agg(
        F.array_distinct(F.flatten(F.collect_list("roles"))).alias("_exact")
    )
    none = F.array().cast("array<string>")
    extra = F.flatten(F.transform(
        F.filter(F.coalesce("_globs", F.array().cast("array<struct<prefix:string,extra:array<string>>>")),
                 lambda g: F.col("path").startswith(g["prefix"])),
        lambda g: g["extra"],
    ))
    under = roles.join(globs, "repo_id", "left").withColumn("roles", F.concat("roles", extra)).drop("_globs")
    merged = under.join(exact, ["repo_id", "path"], "full_outer")
    return merged.select(
        "repo_id", "path",
        F.array_sort(F.array_distinct(F.concat(F.coalesce("roles", none), F.coalesce("_exact", none)))).alias("roles"),
    )


def classify_layer(path: Column, roles: Column | None = None) -> Column:
    """Layer of a file: its roles first, then ordered path prefixes."""
    out = None
    if roles is not None:
        for layer, names in LAYER_ROLES:
            hit = F.coalesce(F.arrays_overlap(roles, F.array(*[F.lit(n) for n in names])), F.lit(False))
            out = F.when(hit, layer) if out is None else out.when(hit, layer)
    for layer, prefixes in LAYER_PREFIXES:
        hit = starts_with_any(path, prefixes)
        out = F.when(hit, layer) if out is None else out.when(hit, layer)
    return out.otherwise("Unknown")


def forbidden_import(src_layer: Column, dst_layer: Column) -> Column:
    out = F.lit(False)
    for layer, targets in FORBIDDEN_IMPORTS.items():
        out = out | ((src_layer == layer) & dst_layer.isin(*targets))
    return out


def detect_routes(files: DataFrame) -> DataFrame:
    """HTTP routes under app/api with their exported verbs; files without a verb are no routes."""
    here = F.col("path").startswith("app/api/") & basename(F.col("path")).isin("route.ts", "route.js")
    verbs = F.array_distinct(F.regexp_extract_all("content", F.lit(ROUTE_EXPORT), F.lit(1)))

    def url_part(s: Column) -> Column:
        rest = F.regexp_extract(s, r"^\[{1,2}\.\.\.([A-Za-z0-9_]+)\]{1,2}$", 1)
        single = F.regexp_extract(s, r"^\[([A-Za-z0-9_]+)\]$", 1)
        return F.when(rest != "", F.concat(F.lit(":"), rest, F.lit("*"))).when(single != "", F.concat(F.lit(":"), single)).otherwise(s)

    folder = F.split(dirname(F.substr(F.col("path"), F.lit(5))), "/")
    return files.where(here).select(
        "repo_id", "path", F.concat(F.lit("/"), F.array_join(F.transform(folder, url_part), "/")).alias("route"),
        verbs.alias("methods"),
    ).where(F.size("methods") > 0)


def manifests(files: DataFrame) -> DataFrame:
    """Root package manifests that parse, as (repo_id, pkg struct); a repository without one has no row."""
    rows = files.where(F.col("path") == "package.json")
    parsed = rows.where(strict_json(F.col("content")).isNotNull())
    return parsed.select("repo_id", F.from_json("content", MANIFEST).alias("pkg"))


def manifest_deps(manifest: DataFrame) -> DataFrame:
    """Declared packages of every manifest, one row per name and group."""
    rows = manifest.select("repo_id", F.explode(F.array(
        F.struct(F.lit("dependencies").alias("kind"), F.col("pkg.dependencies").alias("deps")),
        F.struct(F.lit("devDependencies").alias("kind"), F.col("pkg.devDependencies").alias("deps")),
    )).alias("g"))
    return rows.select("repo_id", "g.kind", F.explode("g.deps").alias("name", "version"))


def _has_path(names: tuple[str, ...]) -> Column:
    """Some file is one of ``names`` or lies in a directory of that name."""
    return F.bool_or(present(F.col("path"), names))


# Root files of the build ecosystems, tested in this order.
ECOSYSTEM_FILES = (
    ("rust", ("Cargo.toml",)), ("go", ("go.mod",)), ("cpp", ("CMakeLists.txt", "Makefile")),
    ("python", ("pyproject.toml", "setup.py")),
)


def _ecosystem_flags() -> list[Column]:
    return [F.bool_or(F.col("path").isin(*names)).alias(f"_eco_{eco}") for eco, names in ECOSYSTEM_FILES]


def _ecosystem() -> Column:
    out = None
    for eco, _ in ECOSYSTEM_FILES:
        out = F.when(F.col(f"_eco_{eco}"), eco) if out is None else out.when(F.col(f"_eco_{eco}"), eco)
    return out.otherwise("node")


def _framework_flags() -> list[Column]:
    return [F.bool_or(F.col("path").isin(*names)).alias(f"_fw_{fw}") for fw, names, _ in FRAMEWORKS if names]


def _framework() -> Column:
    """First framework of the ordered table with a config file at the root or a declared package."""
    none = F.array().cast("array<string>")
    deps = F.array_union(
        F.coalesce(F.map_keys("pkg.dependencies"), none), F.coalesce(F.map_keys("pkg.devDependencies"), none)
    )
    out = None
    for name, names, package in FRAMEWORKS:
        hit = F.array_contains(deps, package)
        if names:
            hit = F.col(f"_fw_{name}") | hit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(F.col("pkg").isNotNull(), out)


def ecosystem(files: DataFrame) -> DataFrame:
    """Build ecosystem of every repository from its root files."""
    return files.groupBy("repo_id").agg(*_ecosystem_flags()).select("repo_id", _ecosystem().alias("ecosystem"))


def frameworks(files: DataFrame) -> DataFrame:
    """Framework of every repository that has a manifest."""
    facts = files.groupBy("repo_id").agg(*_framework_flags()).join(manifests(files), "repo_id")
    return facts.select("repo_id", _framework().alias("framework"))


def _script_matches(names: tuple[str, ...], pattern: str) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | F.coalesce(F.rlike(F.element_at("pkg.scripts", F.lit(name)), F.lit(pattern)), F.lit(False))
    return out


def repo_traits(files: DataFrame) -> DataFrame:
    """Nine traits, framework and ecosystem of every repository, from one aggregate over its paths and its manifest.

    Only flags are aggregated, so the files' contents are never sorted or shuffled.
    """
    facts = files.groupBy("repo_id").agg(
        *[_has_path(names).alias(f"_{trait}") for trait, names in TRAIT_PATHS.items()],
        *[_has_path((name,)).alias(f"_weak_{name}") for name in WEAK_COMPLIANCE],
        _has_path(DEPLOYMENT_FILES).alias("_deploy"),
        F.bool_or((F.col("path") == "Cargo.toml") & F.contains("content", F.lit("[[bin]]"))).alias("_cargo_bin"),
        _has_path(("src/main.rs",)).alias("_main_rs"), _has_path(("main.go",)).alias("_main_go"),
        *_ecosystem_flags(), *_framework_flags(),
    )
    parsed = facts.join(manifests(files), "repo_id", "left").withColumn("ecosystem", _ecosystem())
    known = parsed.withColumn("framework", _framework())
    no = F.lit(False)
    eco, fw = F.col("ecosystem"), F.coalesce("framework", F.lit(""))
    weak = sum((F.col(f"_weak_{n}").cast("int") for n in WEAK_COMPLIANCE), F.lit(0))
    library = F.coalesce(
        F.col("pkg.exports").isNotNull() | F.col("pkg.main").isNotNull() | F.col("pkg.module").isNotNull()
        | F.col("pkg.source").isNotNull(), no,
    )
    server = F.col("_long_running_server") | _script_matches(*SERVER_SCRIPTS)
    return known.select(
        "repo_id", "ecosystem", "framework",
        F.col("_api_routes").alias("has_api_routes"),
        ((eco == "node") & (F.col("_frontend_bundle") | fw.isin("nextjs", "remix", "nuxt", "vite"))).alias("has_frontend_bundle"),
        library.alias("has_package_library_shape"),
        (F.col("_test_suite") | _script_matches(*TEST_SCRIPTS)).alias("has_test_suite"),
        server.alias("has_long_running_server"),
        (F.col("_api_routes") | server | F.col("_deploy")).alias("has_deployable_service"),
        (F.col("_cli_entrypoint") | F.coalesce(F.col("pkg.bin").isNotNull(), no)
         | ((eco == "rust") & (F.col("_cargo_bin") | F.col("_main_rs"))) | ((eco == "go") & F.col("_main_go"))).alias("has_cli_entrypoint"),
        (F.col("_compliance") | F.coalesce(F.rlike("pkg.name", F.lit(COMPLIANCE_NAME)), no) | (weak >= 2)).alias("has_compliance_signals"),
        F.col("_agent_tooling").alias("has_agent_tooling_signals"),
    )


def archetype(traits: DataFrame) -> DataFrame:
    """Ten-step ladder from traits, framework and ecosystem to an archetype."""
    def has(name: str) -> Column:
        return F.col(f"has_{name}")

    web = has("frontend_bundle") | has("api_routes")
    fw = F.coalesce("framework", F.lit(""))
    out = (
        F.when(has("compliance_signals"), "compliance-sensitive")
        .when(has("agent_tooling_signals"), "agent-tooling")
        .when(has("cli_entrypoint") & ~web, "cli")
        .when(has("package_library_shape") & ~web & ~has("long_running_server") & ~has("cli_entrypoint"), "library")
        .when(fw.isin("nextjs", "remix", "nuxt"), "web-app")
        .when(fw.isin("express", "fastify", "hono"), "api-service")
        .when(has("api_routes") | has("deployable_service") | has("long_running_server"),
              F.when(has("frontend_bundle"), "web-app").otherwise("api-service"))
        .when(has("frontend_bundle"), "web-app")
        .when(F.col("ecosystem") != "node", "cli")
        .otherwise("prototype")
    )
    return traits.withColumn("archetype", out)


def repo_languages(files: DataFrame) -> DataFrame:
    """Languages of a repository by file count, united with the languages its manifests mark; and the primary one."""
    lang = lookup(extension(F.col("path")), EXTENSION_LANGUAGES, F.lit(None).cast("string"))
    skipped = F.exists(F.split(dirname(F.col("path"), ""), "/"), lambda d: d.isin(
        "node_modules", ".git", "dist", "build", "target", "vendor", ".next", ".turbo", "coverage", "__pycache__") | d.startswith("."))
    counts = keep_found(files.where(~skipped).select("repo_id", "path"), "language", lang).groupBy(
        "repo_id", "language").agg(F.count(F.lit(1)).alias("files"))
    marker = lookup(F.col("path"), dict(LANGUAGE_MARKERS), F.lit(None).cast("string"))
    order = lookup(F.col("path"), {name: i for i, (name, _) in enumerate(LANGUAGE_MARKERS)}, 99)
    typed = files.groupBy("repo_id").agg(F.bool_or(F.col("path") == "tsconfig.json").alias("_ts"))
    marked = keep_found(files.select("repo_id", "path", order.alias("_ord")), "language", marker).join(typed, "repo_id")
    marked = marked.withColumn(
        "language", F.when((F.col("language") == "javascript") & F.col("_ts"), "typescript").otherwise(F.col("language"))
    ).groupBy("repo_id", "language").agg(F.min("_ord").alias("_ord"))
    both = counts.join(marked, ["repo_id", "language"], "full_outer")
    # At most one row per known language and repository, so these lists are small.
    n = F.coalesce("files", F.lit(0))
    out = both.groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct((-n).alias("neg"), F.col("language")))).alias("_all"),
        F.count("_ord").alias("_markers"),
        F.min_by("language", F.col("_ord")).alias("_first_marker"),
        F.min_by("language", F.when(n > 0, F.struct((-n).alias("neg"), F.col("language")))).alias("_top"),
    )
    return out.select(
        "repo_id",
        F.when(F.col("_markers") == 1, F.col("_first_marker")).otherwise(F.coalesce("_top", "_first_marker")).alias("primary_language"),
        F.array_join(F.transform("_all", lambda s: s["language"]), ",").alias("languages"),
    )


def module_applies(module: str, arch: Column) -> Column:
    """Whether a module makes sense for a repository of this archetype and these traits."""
    def has(name: str) -> Column:
        return F.coalesce(F.col(f"has_{name}"), F.lit(False))

    service = (
        has("api_routes") | has("long_running_server") | has("deployable_service") | arch.isin("web-app", "api-service")
    )
    library = has("package_library_shape") | arch.isin("library", "cli")
    buildable = service | library | has("frontend_bundle") | (arch == "agent-tooling")
    compliance = has("compliance_signals") | (arch == "compliance-sensitive")
    documented = arch.isin("agent-tooling", "library", "compliance-sensitive") | has("frontend_bundle")
    table = {
        "build": buildable, "lint": buildable, "typecheck": buildable, "test": has("test_suite") | buildable,
        "api-health": service, "telemetry-observability": service | has("frontend_bundle"),
        "compliance-hipaa": compliance, "secrets-scan": compliance, "dead-code": library | has("frontend_bundle"),
        "test-coverage": has("test_suite") | (arch != "prototype"), "test-quality": has("test_suite") | (arch != "prototype"),
        "doc-accuracy": documented, "doc-staleness": documented, "context-conflicts": documented,
        "git-health": (arch != "prototype") | has("cli_entrypoint"),
    }
    return table.get(module, F.lit(True))


def allowed_modules(repos: DataFrame) -> DataFrame:
    """Modules a repository may run, from its languages, archetype and traits; one row per repository and module.

    ``repos`` carries languages (comma list), archetype and the has_* traits. The
    module table is a literal array exploded per row, not a join.
    """
    langs = F.split("languages", ",")
    arch = F.col("archetype")
    family = {
        "js": F.array_contains(langs, "typescript") | F.array_contains(langs, "javascript"),
        "go": F.array_contains(langs, "go"), "rust": F.array_contains(langs, "rust"),
    }
    none = ~(family["js"] | family["go"] | family["rust"])
    choices = []
    for module in UNIVERSAL_MODULES:
        choices.append((module, F.lit(True)))
    for name, members in LANGUAGE_MODULES.items():
        choices += [(module, family[name] | none) for module in members]
    arms = []
    for module, by_language in choices:
        off = [p for p, mods in PROFILE_INAPPLICABLE.items() if module in mods]
        ok = by_language & module_applies(module, arch) & (~arch.isin(*off) if off else F.lit(True))
        arms.append(F.when(ok, F.lit(module)))
    return repos.select("repo_id", F.explode(F.array_compact(F.array(*arms))).alias("module_id"))


def enabled_modules(allowed: DataFrame, switches: DataFrame) -> DataFrame:
    """Modules to run: defaults the languages allow plus explicit enables, minus disables.

    ``switches`` is (repo_id, module_id, enabled) from configuration documents.
    Explicit enables bypass the language filter; when a repository enables any
    module explicitly, its list replaces the defaults.
    """
    on = switches.where(F.col("enabled")).select("repo_id", "module_id")
    off = switches.where(~F.col("enabled")).select("repo_id", "module_id")
    listed = on.select("repo_id").distinct()
    default = allowed.where(F.col("module_id").isin(*DEFAULT_MODULES)).join(listed, "repo_id", "left_anti")
    return default.unionByName(on).join(off, ["repo_id", "module_id"], "left_anti").distinct()


def layered_config(layers: DataFrame) -> DataFrame:
    """Value of every key from the layer with the highest priority; ``layers`` is (repo_id, key, value, priority)."""
    return layers.groupBy("repo_id", "key").agg(F.max_by("value", "priority").alias("value"), F.max("priority").alias("priority"))


def normalize_profile(profile: Column) -> Column:
    """Current profile name, an old alias mapped to one, else NULL."""
    none = F.lit(None).cast("string")
    return F.coalesce(
        lookup(profile, {p: p for p in PROFILE_WEIGHTS}, none), lookup(profile, PROFILE_ALIASES, none)
    )


def module_group(module: Column, category: Column) -> Column:
    return (
        F.when(category == "ai", "ai").when(module.startswith("go-"), "go-native").when(module.startswith("rust-"), "rust-native")
        .when(module == "api-health", "runtime").otherwise("static")
    )


# Strictness flags; strict implies all but the ones in NOT_IMPLIED.
STRICT_FLAGS = ("strict", "noImplicitAny", "strictNullChecks", "noImplicitReturns", "strictPropertyInitialization")
NOT_IMPLIED = ("strict", "noImplicitReturns")


def strict_flags(content: Column) -> Column:
    """Missing strictness flags of a compiler config with comments; all of them when it does not parse."""
    doc = strict_json(strip_json_comments(content))

    def on(flag: str) -> Column:
        return F.coalesce(F.try_variant_get(doc, f"$.compilerOptions.{flag}", "boolean"), F.lit(False))

    missing = []
    for flag in STRICT_FLAGS:
        ok = on(flag) if flag in NOT_IMPLIED else on(flag) | on("strict")
        missing.append(F.when(~ok, F.lit(flag)))
    return F.array_compact(F.array(*missing))


def entry_points(manifest_json: Column) -> Column:
    """Files a manifest names as entry points: bin, main, module, source and exports down to four levels.

    Relative ./ is stripped, values inside node_modules are dropped, and the result is distinct.
    """
    doc = strict_json(manifest_json)
    plain = [F.try_variant_get(doc, f"$.{f}", "string") for f in ("main", "module", "source")]
    none = F.array().cast("array<string>")

    def strings(text: Column) -> Column:
        """String leaves of a JSON value: every quoted text that is a value, not a key."""
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r'[:\[,]\s*"((?:[^"\\]|\\.)*)"(?=\s*[,}\]])'), F.lit(1))

    raw = F.from_json(manifest_json, "exports string, bin string")
    nested = F.flatten(F.array(*[
        F.when(F.rlike(raw[f], F.lit(r"^[\{\[]")), strings(raw[f])).when(raw[f].isNotNull(), F.array(raw[f])).otherwise(none)
        for f in ("bin", "exports")
    ]))
    every = F.concat(F.array_compact(F.array(*plain)), nested)
    cleaned = F.transform(every, lambda s: F.regexp_replace(s, r"^\./", ""))
    return F.array_distinct(F.filter(cleaned, lambda s: (s != "") & ~s.startswith("node_modules")))
