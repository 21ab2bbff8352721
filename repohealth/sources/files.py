"""Files and lines: reading checkouts, path filters, line tables, binary sniffing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repohealth.functions.paths import basename, extension

# Directories never scanned, lock files, and the extensions of source files.
SKIP_DIRS = (
    "node_modules", ".git", ".next", "dist", "build", "out", "target", "vendor", ".turbo", ".vercel", "coverage",
    "__pycache__", ".cache",
)
LOCK_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "Gemfile.lock", "poetry.lock",
    "composer.lock", "go.sum",
)
# Extensions of source files.
SOURCE_EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".pyi", ".rs", ".go", ".java", ".kt", ".kts", ".c", ".cpp",
    ".cc", ".cxx", ".h", ".hpp", ".cs", ".rb", ".php", ".swift", ".scala", ".lua", ".ex", ".exs", ".zig", ".vue",
    ".svelte", ".astro", ".css", ".scss", ".less", ".sql", ".sh", ".bash", ".zsh", ".yaml", ".yml", ".toml", ".json",
    ".jsonc", ".xml", ".html", ".htm", ".md", ".mdx", ".graphql", ".gql", ".proto", ".tf", ".hcl", ".dart", ".r",
    ".m", ".mm", ".pl", ".pm", ".clj", ".cljs", ".hs", ".erl", ".hrl", ".ml", ".mli", ".nim", ".v",
)
CODE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".rb", ".java", ".kt")


def read_files(spark: SparkSession, root: str, repo_id: str, max_bytes: int | None = None) -> DataFrame:
    """Files of a checkout as (repo_id, path, content, bytes); sizes are tested before contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_bytes is not None:
        raw = raw.where(F.col("length") <= max_bytes)
    relative = F.regexp_replace(F.col("path"), r"^(file:)?/*" + root.strip("/").replace(".", r"\."), "")
    return raw.select(
        F.lit(repo_id).alias("repo_id"), F.regexp_replace(relative, "^/", "").alias("path"),
        F.decode("content", "UTF-8").alias("content"), F.col("length").alias("bytes"),
    )


def scannable(path: Column, extensions: tuple[str, ...] = SOURCE_EXTENSIONS, skip: tuple[str, ...] = SKIP_DIRS) -> Column:
    """Not inside a skipped or dotted directory, not a lock file, and of a known extension."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    inside = F.exists(folders, lambda d: d.isin(*skip) | d.startswith("."))
    return ~inside & ~basename(path).isin(*LOCK_FILES) & extension(path).isin(*extensions)


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line with its 1-based number."""
    return files.select("repo_id", "path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).select(
        "repo_id", "path", (F.col("pos") + 1).alias("line_no"), "text"
    )


def line_count(content: Column) -> Column:
    """Lines of a file; an empty file has none."""
    return F.when(content == "", 0).otherwise(F.size(F.split(content, "\n")))


def split_count(content: Column) -> Column:
    """Pieces between newlines; an empty file has one."""
    return F.size(F.split(content, "\n"))


def is_binary(content: Column) -> Column:
    """A NUL among the first 8192 characters."""
    return F.instr(F.substring(content, 1, 8192), "\0") > 0


def largest_per_repo(files: DataFrame, n: int) -> DataFrame:
    from repohealth.operators.ordered import top_per_key

    return top_per_key(files, ["repo_id"], [F.col("bytes").desc(), F.col("path")], n, rank="place")


def structure(files: DataFrame) -> DataFrame:
    """Two-level listing: top entries and entries one level down; directories end in a slash."""
    parts = F.split("path", "/")
    n = F.size(parts)
    entry1 = F.when(n > 1, F.concat(F.get(parts, F.lit(0)), F.lit("/"))).otherwise(F.col("path"))
    entry2 = F.when(n > 2, F.concat(F.array_join(F.slice(parts, 1, 2), "/"), F.lit("/"))).when(n == 2, F.col("path"))
    hidden = F.exists(F.slice(parts, 1, 2), lambda p: p.startswith(".") | p.isin(*SKIP_DIRS))
    rows = files.where(~hidden).select("repo_id", F.explode(F.array_compact(F.array(entry1, entry2))).alias("entry")).distinct()
    source_like = F.rlike("entry", F.lit(r"^(lib|src|app)/([^/]+/|[^/]+\.(ts|tsx|js|jsx))$"))
    return rows.withColumn("public_surface", source_like)


