"""Preparing and reading reviews: file samples, budgets, batches, replies, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repohealth.functions.paths import dirname
from repohealth.functions.scalars import estimate_tokens, extract_json_text, fingerprint, strict_json
from repohealth.operators.ordered import block, running_sum, top_per_key, with_position

# Price per million input and output tokens of three model sizes.
PRICES = {"small": (0.25, 1.25), "medium": (3.0, 15.0), "large": (15.0, 75.0)}
MAX_FILE_CHARS = 50_000


def token_cost(tokens: Column, tier: str) -> Column:
    """Cost of a prompt, its answer taken as twice as long."""
    price_in, price_out = PRICES[tier]
    return tokens / F.lit(1_000_000) * F.lit(price_in) + tokens * 2 / F.lit(1_000_000) * F.lit(price_out)


def diverse_files(files: DataFrame, k: int = 15, per_dir: int = 3) -> DataFrame:
    """Largest files of a repository, at most ``per_dir`` of a directory; long contents are cut with a mark.

    Contents are joined back to the few chosen paths instead of travelling through the ranking.
    """
    sized = files.select("repo_id", "path", dirname(F.col("path")).alias("_dir"), F.length("content").alias("size"))
    order = [F.col("size").desc(), F.col("path")]
    spread = top_per_key(sized, ["repo_id", "_dir"], order, per_dir)
    chosen = top_per_key(spread, ["repo_id"], order, k, rank="place").drop("_dir")
    text = F.col("content")
    cut = F.when(F.length(text) > MAX_FILE_CHARS, F.concat(F.substring(text, 1, MAX_FILE_CHARS), F.lit("\n... (truncated)"))).otherwise(text)
    return files.select("repo_id", "path", cut.alias("content")).join(chosen, ["repo_id", "path"])


def budget_pack(batches: DataFrame, keys: list[str], budget: int, strict: bool = False) -> DataFrame:
    """Which batches fit a token budget, in order of batch_no.

    The usual rule processes a batch while what was used before it is below the
    budget, so the last one may overshoot; the strict rule also counts the batch.
    """
    rows = running_sum(batches, keys, ["batch_no"], block("batch_no"), F.col("tokens"), "used", inclusive=strict)
    fits = F.col("used") <= budget if strict else F.col("used") < budget
    return rows.withColumn("processed", fits)


def batches_of(files: DataFrame, n: int) -> DataFrame:
    """Batch number of every file: consecutive groups of ``n`` by path."""
    placed = with_position(files, ["repo_id"], [F.col("path")])
    return placed.withColumn("batch_no", F.floor((F.col("position") - 1) / n))


def review_input(files: DataFrame, n: int = 5) -> DataFrame:
    """Text of every review batch: its files as blocks in path order. A batch has ``n`` files, so it stays small."""
    content = F.concat(F.lit("### "), "path", F.lit("\n"), "content")
    rows = batches_of(files.select("repo_id", "path", content.alias("text")), n)
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))
    return rows.groupBy("repo_id", "batch_no").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("files")
    ).withColumn("tokens", estimate_tokens(F.col("text")))


def sample_files(files: DataFrame, k: int = 20) -> DataFrame:
    """Files by a mix of complexity (.4), churn (.3) and imports (.3), each against its maximum in the repository."""
    peaks = files.groupBy("repo_id").agg(*[F.max(c).alias(f"_{c}") for c in ("complexity", "churn", "imports")])
    joined = files.join(peaks, "repo_id")

    def share(c: str) -> Column:
        return F.coalesce(F.col(c) / F.nullif(F.col(f"_{c}"), F.lit(0)), F.lit(0.0))

    score = share("complexity") * 0.4 + share("churn") * 0.3 + share("imports") * 0.3
    why = F.concat_ws(", ", *[
        F.when(share(c) > 0, F.concat(F.lit(f"{c}: "), F.floor(share(c) * 100 + 0.5).cast("string"), F.lit("%")))
        for c in ("complexity", "churn", "imports")
    ])
    rows = joined.select(
        "repo_id", "path", (F.floor(score * 1000 + 0.5) / 1000).alias("score"),
        F.when(why == "", "baseline inclusion").otherwise(why).alias("reason"),
    )
    return top_per_key(rows, ["repo_id"], [F.col("score").desc(), F.col("path")], min(k, 30), rank="place")


REVIEW = "summary string, findings array<struct<severity:string,file:string,line:string,message:string,category:string>>"


def parse_reviews(replies: DataFrame) -> DataFrame:
    """Summary of every reply and its findings; an unreadable reply gives its first 1000 characters as summary.

    A finding needs a message; severity, category and file have defaults.
    """
    text = F.col("text")
    doc = extract_json_text(text)
    readable = strict_json(doc).isNotNull()
    parsed = F.when(readable, F.from_json(doc, REVIEW))
    kept = F.filter(
        F.coalesce(parsed["findings"], F.array().cast("array<struct<severity:string,file:string,line:string,message:string,category:string>>")),
        lambda f: f["message"].isNotNull(),
    )
    return replies.select(
        "response_id",
        F.when(readable, F.coalesce(parsed["summary"], F.lit(""))).otherwise(F.substring(text, 1, 1000)).alias("summary"),
        F.transform(kept, lambda f: F.struct(
            F.coalesce(f["severity"], F.lit("medium")).alias("severity"), F.coalesce(f["file"], F.lit("")).alias("file"),
            f["line"].try_cast("int").alias("line"), f["message"].alias("message"),
            F.coalesce(f["category"], F.lit("general")).alias("category"),
        )).alias("findings"),
    )


def review_findings(replies: DataFrame, module_id: str) -> DataFrame:
    """Findings of review replies with their identity."""
    rows = parse_reviews(replies).select("response_id", F.inline("findings"))
    return rows.withColumn("module_id", F.lit(module_id)).withColumn(
        "fingerprint", fingerprint(F.lit(module_id), F.col("file"), F.col("category"), F.col("message")))


def token_usage(rows: DataFrame, keys: list[str], budget: int) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    used = F.col("tokens_in") + F.col("tokens_out")
    return out.withColumn("used", used).withColumn("remaining", F.greatest(F.lit(0), F.lit(budget) - used)).withColumn(
        "exhausted", used >= budget)


TRENDING = ("trending", "cli", "framework", "machine-learning", "developer-tools")


def trending(repos: DataFrame, category: str, as_of: str, n: int = 12) -> DataFrame:
    """Most starred repositories: young with over 100 stars, or of a topic with over 500."""
    if category == "trending":
        recent = F.col("created_at") > F.date_sub(F.lit(as_of).cast("date"), 30)
        rows = repos.where(recent & (F.col("stars") > 100))
    else:
        rows = repos.where(F.array_contains("topics", category) & (F.col("stars") > 500))
    return rows.orderBy(F.col("stars").desc(), "repo_id").limit(n)
