"""Imports, exports, their resolution to files, and what nothing refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repohealth.functions.paths import dirname
from repohealth.functions.scalars import keep_found, strip
from repohealth.functions.severity import lookup
from repohealth.operators.ordered import first_per_key
from repohealth.session import cut_lineage

# Import forms whose first group is the specifier; the fourth is the dynamic one.
IMPORT_PATTERNS = (
    r"import\s+(?:[\s\S]*?)\s+from\s+['\x22]([^'\x22]+)['\x22]",
    r"import\s+['\x22]([^'\x22]+)['\x22]",
    r"require\s*\(\s*['\x22]([^'\x22]+)['\x22]\s*\)",
    r"import\s*\(\s*['\x22]([^'\x22]+)['\x22]\s*\)",
    r"export\s+(?:[\s\S]*?)\s+from\s+['\x22]([^'\x22]+)['\x22]",
)
DYNAMIC_IMPORT = IMPORT_PATTERNS[3]
NAMED_IMPORT = r"import\s+\{([^}]+)\}\s+from\s+['\x22]([^'\x22]+)['\x22]"
EXPORT_NAME = r"export\s+(?:default\s+)?(?:function|class|const|let|var|type|interface|enum)\s+([A-Za-z0-9_]+)"
EXPORT_LIST = r"export\s*\{([^}]+)\}"
SPEC = r"['\x22]([^'\x22]+)['\x22]"
NAMESPACE_IMPORT = r"import\s+\*\s+as\s+[A-Za-z0-9_$]+\s+from\s+" + SPEC
DEFAULT_IMPORT = r"import\s+[A-Za-z0-9_$]+\s*(?:,\s*\{[^}]*\}\s*)?\s+from\s+" + SPEC
MIXED_IMPORT = r"import\s+[A-Za-z0-9_$]+\s*,\s*\{([^}]+)\}\s*from\s+" + SPEC
REQUIRE = IMPORT_PATTERNS[2]
EXPORT_FROM = r"export\s*\{([^}]+)\}\s*from\s+" + SPEC
EXPORT_ALL = r"export\s+\*\s+from\s+" + SPEC
EXPORT_ALL_AS = r"export\s+\*\s+as\s+([A-Za-z0-9_$]+)\s+from\s+" + SPEC
DEFAULT_EXPORT = r"export\s+default\s+(?:function|class)\s+([A-Za-z0-9_]+)"
ALL, DEFAULT = "*", "default"
# Extensions tried when an import names none.
RESOLVE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs")
# Roles that keep a file or an export from counting as unused.
FILE_EXEMPT_ROLES = ("cli-entrypoint", "mcp-tool", "provider", "api-route")
EXPORT_EXEMPT_ROLES = ("public-api", "ui-kit", "provider")


# Texts that every match of a pattern contains: a plain search for them comes before the pattern.
NEEDS = {
    **dict(zip(IMPORT_PATTERNS, (("import", "from"), ("import",), ("require",), ("import",), ("export", "from")))),
    NAMED_IMPORT: ("import", "{", "from"), EXPORT_NAME: ("export",), EXPORT_LIST: ("export", "{"),
    NAMESPACE_IMPORT: ("import", "*", "from"), DEFAULT_IMPORT: ("import", "from"), MIXED_IMPORT: ("import", "{", "from"),
    EXPORT_FROM: ("export", "{", "from"), EXPORT_ALL: ("export", "*", "from"), EXPORT_ALL_AS: ("export", "*", "from"), DEFAULT_EXPORT: ("export", "default"),
}


def _all(content: Column, pattern: str, group: int = 1) -> Column:
    found, there = F.regexp_extract_all(content, F.lit(pattern), F.lit(group)), F.lit(True)
    for text in NEEDS.get(pattern, ()):
        there = there & F.contains(content, F.lit(text))
    return F.when(content.isNull() | there, found).otherwise(F.array().cast("array<string>"))


def _first_names(text: Column) -> Column:
    """Names of a comma list with their 'as' aliases cut off."""
    names = F.transform(F.split(text, ","), lambda s: strip(F.get(F.split(strip(s), r"\s+as\s+"), F.lit(0))))
    return F.filter(names, lambda s: s != "")


def extract_imports(files: DataFrame) -> DataFrame:
    """Distinct in-repository specifiers per file, whether they are dynamic, and the symbols they name."""
    content = F.col("content")
    specs = F.array_distinct(F.flatten(F.array(*[_all(content, p) for p in IMPORT_PATTERNS])))
    local = F.filter(specs, lambda s: s.startswith(".") | s.startswith("@/"))
    named = F.arrays_zip(_all(content, NAMED_IMPORT, 1).alias("names"), _all(content, NAMED_IMPORT, 2).alias("spec"))
    rows = files.select(
        "repo_id", "path", _all(content, DYNAMIC_IMPORT).alias("_dynamic"), named.alias("_named"),
        F.explode(local).alias("specifier"),
    )
    mine = F.filter("_named", lambda z: z["spec"] == F.col("specifier"))
    symbols = F.flatten(F.transform(mine, lambda z: _first_names(z["names"])))
    return rows.select(
        "repo_id", "path", "specifier", F.array_contains("_dynamic", F.col("specifier")).alias("is_dynamic"),
        symbols.alias("symbols"),
    )


def extract_exports(files: DataFrame) -> DataFrame:
    """Distinct exported names per file."""
    content = F.col("content")
    listed = F.flatten(F.transform(_all(content, EXPORT_LIST), _first_names))
    names = F.array_distinct(F.concat(_all(content, EXPORT_NAME), listed))
    return files.select("repo_id", "path", F.explode(names).alias("symbol"))


def collapse_dots(path: Column) -> Column:
    """Path with . and .. segments resolved; NULL when it leaves the root."""
    def step(acc: Column, part: Column) -> Column:
        return (
            F.when(acc.isNull() | (part == ".") | (part == ""), acc)
            .when((part == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
            .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(parts.isNotNull(), F.array_join(parts, "/"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """File every import points to: exact path, then with an extension, then an index file; self-imports dropped.

    Every file is listed once under each name it can be imported by (at most
    three), with the rank of that form. So an import stays one row in one equi
    join, and the best rank is kept by an aggregate.
    """
    spec = F.col("specifier")
    joined = F.when(spec.startswith("@/"), F.substr(spec, F.lit(3))).otherwise(
        F.concat(dirname(F.col("path"), ""), F.lit("/"), spec)
    )
    wanted = keep_found(imports, "_name", collapse_dots(joined))

    path = F.col("path")
    ext = F.regexp_extract(path, r"(\.(?:ts|tsx|js|jsx|mts|mjs))$", 1)
    bare = F.substr(path, F.lit(1), F.length(path) - F.length(ext))
    rank = lookup(ext, {e: i + 1 for i, e in enumerate(RESOLVE_EXTENSIONS)}, 0)
    folder = F.regexp_extract(bare, r"^(.+)/index$", 1)
    names = F.array_compact(F.array(
        F.struct(path.alias("name"), F.lit(0).alias("rank")),
        F.when(ext != "", F.struct(bare.alias("name"), rank.alias("rank"))),
        F.when((ext != "") & (folder != ""), F.struct(folder.alias("name"), (rank + len(RESOLVE_EXTENSIONS)).alias("rank"))),
    ))
    known = files.select("repo_id", path.alias("target")).distinct().withColumnRenamed("target", "path").select(
        "repo_id", path.alias("target"), F.explode(names).alias("_k")).select(
        "repo_id", "target", F.col("_k.name").alias("_name"), F.col("_k.rank").alias("_rank"))
    found = wanted.join(known, ["repo_id", "_name"])
    best = first_per_key(
        found.select("repo_id", "path", "specifier", "target", "is_dynamic", "symbols", "_rank"),
        ["repo_id", "path", "specifier"], ["_rank"],
    )
    return best.where(F.col("target") != F.col("path")).drop("_rank")


def import_edges(resolved: DataFrame) -> DataFrame:
    """One edge per file pair with the symbols of all its imports."""
    return resolved.groupBy("repo_id", "path", "target").agg(
        F.bool_or("is_dynamic").alias("is_dynamic"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("symbols")))).alias("symbols"),
    ).select("repo_id", F.col("path").alias("src"), F.col("target").alias("dst"), "is_dynamic", "symbols")


def _has_role(roles: str, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(roles), F.array(*[F.lit(n) for n in names])), F.lit(False))


def dead_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Source files nothing imports, apart from entry points and exempt roles; ``files`` carries roles."""
    entry = F.col("path").startswith("app/") | F.col("path").startswith("pages/")
    candidates = files.where(~entry & ~_has_role("roles", FILE_EXEMPT_ROLES))
    return candidates.join(edges.select("repo_id", F.col("dst").alias("path")).distinct(), ["repo_id", "path"], "left_anti")


def _zipped(content: Column, pattern: str) -> Column:
    """(text, spec) of every match of a pattern with the two groups."""
    return F.arrays_zip(_all(content, pattern, 1).alias("text"), _all(content, pattern, 2).alias("spec"))


def _pairs(zipped: Column) -> Column:
    """(spec, source, symbol) of every name of a comma list: what it is called at the source and where it is listed."""
    def of(z: Column) -> Column:
        parts = F.filter(F.transform(F.split(z["text"], ","), strip), lambda n: n != "")
        return F.transform(parts, lambda n: F.struct(
            z["spec"].alias("spec"), strip(F.get(F.split(n, r"\s+as\s+"), F.lit(0))).alias("source"), strip(F.element_at(F.split(n, r"\s+as\s+"), -1)).alias("symbol")))

    return F.flatten(F.transform(zipped, of))


def _specs(content: Column, pattern: str, source: str, symbol: str) -> Column:
    return F.transform(_all(content, pattern), lambda s: F.struct(s.alias("spec"), F.lit(source).alias("source"), F.lit(symbol).alias("symbol")))


def import_uses(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """Distinct (repo_id, path, symbol) that imports name: '*' for namespaces, require and dynamic imports, 'default' for defaults."""
    content = F.col("content")
    named = [_pairs(_zipped(content, p)) for p in (NAMED_IMPORT, MIXED_IMPORT)]
    whole = [_specs(content, p, ALL, ALL) for p in (NAMESPACE_IMPORT, REQUIRE, DYNAMIC_IMPORT)]
    uses = files.select("repo_id", "path", F.explode(F.concat(*named, *whole, _specs(content, DEFAULT_IMPORT, DEFAULT, DEFAULT))).alias("u"))
    return uses.select("repo_id", "path", F.col("u.spec").alias("specifier"), F.col("u.source").alias("symbol")).join(
        resolved.select("repo_id", "path", "specifier", "target"), ["repo_id", "path", "specifier"]).select(
        "repo_id", F.col("target").alias("path"), "symbol").distinct()


def reexports(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """(repo_id, path, symbol, target, source): a use of the symbol of the file is one of the source in the target.

    '*' as symbol passes every use on under its own name; '*' as source uses all of the target.
    """
    content = F.col("content")
    spaces = F.transform(_zipped(content, EXPORT_ALL_AS), lambda z: F.struct(z["spec"].alias("spec"), F.lit(ALL).alias("source"), z["text"].alias("symbol")))
    rows = files.select("repo_id", "path", F.explode(F.concat(_pairs(_zipped(content, EXPORT_FROM)), spaces, _specs(content, EXPORT_ALL, ALL, ALL))).alias("u"))
    return rows.select("repo_id", "path", F.col("u.spec").alias("specifier"), F.col("u.symbol").alias("symbol"), F.col("u.source").alias("source")).join(
        resolved.select("repo_id", "path", "specifier", "target"), ["repo_id", "path", "specifier"]).select(
        "repo_id", "path", "symbol", "target", "source").distinct()


def live_symbols(uses: DataFrame, passed: DataFrame) -> DataFrame:
    """Uses and all that follow from them through re-exports: a least fixpoint, one round for each barrel in a row.

    Only what the last round found is followed further; a default is not passed on by '*'.
    """
    keys = ["repo_id", "path", "symbol"]
    passed = cut_lineage(passed.select("repo_id", "path", F.col("symbol").alias("_as"), "target", "source"))
    fresh = cut_lineage(uses.select(*keys).distinct())
    parts = []
    while not fresh.isEmpty():
        parts.append(fresh)
        known = parts[0]
        for part in parts[1:]:
            known = known.union(part)
        on = (F.col("_as") == F.col("symbol")) | (F.col("symbol") == ALL) | ((F.col("_as") == ALL) & (F.col("symbol") != DEFAULT))
        star = (F.col("_as") == ALL) & (F.col("symbol") != ALL)
        found = fresh.join(passed, ["repo_id", "path"]).where(on).select(
            "repo_id", F.col("target").alias("path"), F.when(star, F.col("symbol")).otherwise(F.col("source")).alias("symbol")).distinct()
        fresh = cut_lineage(found.join(known, keys, "left_anti"))
    if not parts:
        return fresh
    live = parts[0]
    for part in parts[1:]:
        live = live.union(part)
    return live


def dead_exports(files: DataFrame, resolved: DataFrame, roles: DataFrame) -> DataFrame:
    """Exported names that nothing uses, also not as default, as part of a namespace or through re-exports.

    ``files`` has the contents, ``roles`` is (repo_id, path, roles).
    """
    keys = ["repo_id", "path", "symbol"]
    live = cut_lineage(live_symbols(import_uses(files, resolved), reexports(files, resolved)))
    defaults = files.select("repo_id", "path", F.explode(_all(F.col("content"), DEFAULT_EXPORT)).alias("symbol"))
    by_default = defaults.join(live.where(F.col("symbol") == DEFAULT).select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    whole = live.where(F.col("symbol") == ALL).select("repo_id", "path")
    # a list may export a name under another one, which is what importers use
    lists = F.transform(_all(F.col("content"), EXPORT_LIST), lambda x: F.struct(x.alias("text"), F.lit("").alias("spec")))
    renamed = files.select("repo_id", "path", F.explode(_pairs(lists)).alias("p")).where("p.source <> p.symbol").select("repo_id", "path", "p.symbol", "p.source")
    by_alias = renamed.join(live, keys).select("repo_id", "path", F.col("source").alias("symbol"))
    live = live.union(by_alias)
    left = extract_exports(files).join(live.union(by_default.select(*keys)), keys, "left_anti").join(whole, ["repo_id", "path"], "left_anti")
    return left.join(roles, ["repo_id", "path"], "left").where(~_has_role("roles", EXPORT_EXEMPT_ROLES)).drop("roles")


def dead_deps(deps: DataFrame, files: DataFrame) -> DataFrame:
    """Declared packages no import names; ``deps`` is (repo_id, name)."""
    content = F.col("content")
    specs = F.flatten(F.array(*[_all(content, p) for p in IMPORT_PATTERNS]))
    package = F.regexp_extract("spec", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    used = files.select("repo_id", F.explode(specs).alias("spec")).select("repo_id", package.alias("name")).distinct()
    return deps.join(used, ["repo_id", "name"], "left_anti")
