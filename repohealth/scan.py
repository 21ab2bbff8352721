"""A whole scan of many repositories as one job: checks, findings, statuses, scores.

A check is a function from the fact tables to finding rows; registering one is
all it takes to take part in every scan. Checks are branches of one lazy plan, so
Spark runs them side by side and reads shared inputs through the same scans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repohealth.functions.paths import extension
from repohealth.functions.scalars import count_if, fingerprint
from repohealth.operators import checks as C
from repohealth.operators import deps as D
from repohealth.operators import rules, shape
from repohealth.operators.scoring import PROFILE_INAPPLICABLE, PROFILE_WEIGHTS, deduction_points, overall_score, profile_weight
from repohealth.sources import commits as H

FINDING_COLUMNS = ("repo_id", "module_id", "severity", "file_path", "line", "category", "message")


@dataclass(frozen=True)
class Facts:
    """Fact tables of a scan. ``lines`` and ``files`` are the texts; others are optional."""

    files: DataFrame
    lines: DataFrame | None = None
    probes: DataFrame | None = None
    commits: DataFrame | None = None  # repo_id, file, author
    dated_commits: DataFrame | None = None  # repo_id, file, ts
    todos: DataFrame | None = None  # repo_id, severity (null: young)
    deps: DataFrame | None = None
    advisories: DataFrame | None = None
    as_of: str | None = None  # day from which the age of an area counts


@dataclass(frozen=True)
class Check:
    id: str
    inputs: tuple[str, ...]
    family: str
    run: Callable[[Facts], DataFrame] = field(compare=False)
    judges: Callable[[Facts], DataFrame] | None = field(compare=False, default=None)


@dataclass(frozen=True)
class ScoreRule:
    inputs: tuple[str, ...]
    run: Callable[[Facts], DataFrame] = field(compare=False)


CHECKS: dict[str, Check] = {}
SCORES: dict[str, ScoreRule] = {}


def check(check_id: str, inputs: tuple[str, ...], family: str, judges: Callable[[Facts], DataFrame] | None = None):
    """Register ``fn(facts) -> rows`` as a check; ``family`` names its deduction table.

    ``judges(facts)`` gives the repositories (repo_id) that it has evidence on; without it these are all.
    """

    def add(fn: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        CHECKS[check_id] = Check(check_id, inputs, family, fn, judges)
        return fn

    return add


def score_rule(check_id: str, inputs: tuple[str, ...]):
    """Register ``fn(facts) -> repo_id, score, confidence`` as the score of a check, in place of its deductions.

    Repositories without a row have no evidence.
    """

    def add(fn: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        SCORES[check_id] = ScoreRule(inputs, fn)
        return fn

    return add


def _given(facts: Facts, inputs: tuple[str, ...]) -> bool:
    return all(getattr(facts, i) is not None for i in inputs)


@check("secrets-scan", ("lines",), "secrets-scan")
def _secrets(facts: Facts) -> DataFrame:
    return rules.secrets_scan(facts.lines).select(
        "repo_id", "severity", F.col("path").alias("file_path"), F.col("line_no").alias("line"), "category", "message")


@check("compliance-hipaa", ("lines",), "compliance")
def _compliance(facts: Facts) -> DataFrame:
    return rules.match_rules(facts.lines, rules.phi_rules()).select(
        "repo_id", "severity", F.col("path").alias("file_path"), F.col("line_no").alias("line"), "category",
        F.col("rule_message").alias("message"))


@check("git-health", ("lines",), "error-handling")
def _silos(facts: Facts) -> DataFrame:
    return rules.external_silos(facts.lines).select(
        "repo_id", F.lit("medium").alias("severity"), F.col("path").alias("file_path"), F.col("line_no").alias("line"),
        F.lit("external-silo").alias("category"), F.concat(F.lit("references "), "system").alias("message"))


@check("config-quality", ("files",), "config-quality")
def _config(facts: Facts) -> DataFrame:
    archetypes = shape.archetype(shape.repo_traits(facts.files)).select("repo_id", "archetype")
    return C.config_checks(facts.files, archetypes).select(
        "repo_id", "severity", "file_path", F.lit(None).cast("int").alias("line"), "category", "message")


@check("complexity", ("files",), "error-handling")
def _complexity(facts: Facts) -> DataFrame:
    rows = C.complexity_facts(facts.files).withColumn("roles", shape.path_roles(F.col("path")))
    return C.complexity_findings(rows).select(
        "repo_id", "severity", F.col("path").alias("file_path"), F.lit(None).cast("int").alias("line"), "category",
        F.concat(F.lit("complexity "), F.col("complexity").cast("string"), F.lit(", lines "), F.col("loc").cast("string")).alias("message"))


@check("type-safety", ("lines",), "naming-quality")
def _types(facts: Facts) -> DataFrame:
    return rules.type_safety_hits(facts.lines).select(
        "repo_id", "severity", F.col("path").alias("file_path"), F.col("line_no").alias("line"), "category", F.col("rule_message").alias("message"))


@check("security", ("deps", "advisories"), "security", judges=lambda facts: facts.deps.select("repo_id"))
def _advisories(facts: Facts) -> DataFrame:
    return D.vulnerable_deps(facts.deps, facts.advisories).select(
        "repo_id", "severity", F.col("name").alias("file_path"), F.lit(None).cast("int").alias("line"),
        F.lit("vulnerability").alias("category"), "message")


@score_rule("complexity", ("files",))
def _maintainability(facts: Facts) -> DataFrame:
    return C.complexity_metrics(C.complexity_facts(facts.files)).select(
        "repo_id", F.col("maintainability").alias("score"), F.when(F.col("files") >= 10, 1.0).otherwise(0.7).alias("confidence"))


@score_rule("git-health", ("lines", "commits", "dated_commits", "todos", "as_of"))
def _git_health(facts: Facts) -> DataFrame:
    one = F.lit(1)
    silos = rules.external_silos(facts.lines).groupBy("repo_id").agg(F.count(one).alias("silo_findings"))
    todos = facts.todos.groupBy("repo_id").agg(((F.count(one) - F.count("severity")) / F.count(one)).alias("todo_score"))
    parts = H.freshness(H.stale_areas(facts.dated_commits, facts.as_of)).join(H.churn_health(H.churn(facts.commits)), "repo_id", "full")
    return H.git_health(parts.join(silos, "repo_id", "left").join(todos, "repo_id", "left")).select("repo_id", "score", F.lit(0.9).alias("confidence"))


@score_rule("type-safety", ("files", "lines"))
def _type_safety(facts: Facts) -> DataFrame:
    path, category = F.col("path"), F.col("category")
    typed = facts.files.where(extension(path).isin(".ts", ".tsx") & ~path.contains("node_modules/")).select("repo_id").distinct()
    hits = rules.type_safety_hits(facts.lines).groupBy("repo_id").agg(
        *[count_if(category == c).alias(n) for c, n in (("any-usage", "_any"), ("type-assertion", "_cast"), ("ts-directive", "_directive"))])
    flags = facts.files.where("path = 'tsconfig.json'").groupBy("repo_id").agg(F.max(F.size(shape.strict_flags(F.col("content")))).alias("_flags"))
    n = [F.coalesce(c, F.lit(0)) for c in ("_any", "_cast", "_directive", "_flags")]
    return typed.join(hits, "repo_id", "left").join(flags, "repo_id", "left").select("repo_id", rules.type_safety_score(*n).alias("score"), F.lit(1.0).alias("confidence"))


@check("api-health", ("probes",), "api-health", judges=lambda facts: facts.probes.select("repo_id"))
def _probes(facts: Facts) -> DataFrame:
    return C.probe_findings(facts.probes).select(
        "repo_id", "severity", F.col("route").alias("file_path"), F.lit(None).cast("int").alias("line"), "category",
        F.concat("method", F.lit(" "), "route").alias("message"))


def run_checks(facts: Facts, only: tuple[str, ...] | None = None) -> DataFrame:
    """Findings of all checks whose inputs are there, with their identity."""
    parts = []
    for one in CHECKS.values():
        if (only is None or one.id in only) and _given(facts, one.inputs):
            parts.append(one.run(facts).withColumn("module_id", F.lit(one.id)).select(*FINDING_COLUMNS))
    if not parts:
        raise ValueError("no check has its inputs")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("fingerprint", fingerprint(F.col("module_id"), F.col("file_path"), F.col("category"), F.col("message")))


def _of_modules(parts: dict[str, DataFrame]) -> DataFrame | None:
    out = None
    for module, rows in parts.items():
        rows = rows.withColumn("module_id", F.lit(module))
        out = rows if out is None else out.unionByName(rows)
    return out


def module_results(
    findings: DataFrame, repos: DataFrame, modules: tuple[str, ...], facts: Facts | None = None, archetypes: DataFrame | None = None,
) -> DataFrame:
    """Score and state of every module per repository.

    A module with a score rule takes its score; others have 100 minus the points of their findings, 100 without findings.
    States: unavailable (an input is not among ``facts``), not_applicable (to the repository's archetype), insufficient_evidence
    (the rule or the check knows nothing of the repository), else completed. Only completed modules have a score and confidence, others -1 and 0.
    Without ``facts`` every module counts by its findings. ``archetypes``: repo_id, archetype, a row a repository.
    """
    points = None
    for module in modules:
        pts = deduction_points(CHECKS[module].family, F.col("severity"))
        hit = F.col("module_id") == module
        points = F.when(hit, pts) if points is None else points.when(hit, pts)
    lost = findings.groupBy("repo_id", "module_id").agg(F.sum(points).alias("_lost"), F.count(F.lit(1)).alias("findings"))
    every = repos.select("repo_id").distinct().select("repo_id", F.explode(F.array(*[F.lit(m) for m in modules])).alias("module_id"))
    out = every.join(lost, ["repo_id", "module_id"], "left")

    module, never = F.col("module_id"), F.lit(False)
    missing = [m for m in modules if facts is not None and not (_given(facts, CHECKS[m].inputs) and _given(facts, SCORES[m].inputs if m in SCORES else ()))]
    ready = [m for m in modules if facts is not None and m not in missing]
    own = _of_modules({m: SCORES[m].run(facts).select("repo_id", F.col("score").cast("int").alias("_own"), F.col("confidence").alias("_sure")) for m in ready if m in SCORES})
    seen = _of_modules({m: CHECKS[m].judges(facts).select("repo_id").distinct().withColumn("_seen", F.lit(True)) for m in ready if CHECKS[m].judges and m not in SCORES})
    blind, sure, score = never, F.lit(1.0), F.greatest(F.lit(0), F.lit(100) - F.coalesce("_lost", F.lit(0)))
    if own is not None:
        ruled = module.isin([m for m in ready if m in SCORES])
        out, score = out.join(own, ["repo_id", "module_id"], "left"), F.when(ruled, F.col("_own")).otherwise(score)
        sure, blind = F.coalesce("_sure", sure), blind | (ruled & F.col("_own").isNull())
    if seen is not None:
        judged = module.isin([m for m in ready if CHECKS[m].judges and m not in SCORES])
        out, blind = out.join(seen, ["repo_id", "module_id"], "left"), blind | (judged & F.col("_seen").isNull())
    unfit = never
    if archetypes is not None:
        out = out.join(archetypes.select("repo_id", "archetype"), "repo_id", "left")
        for name, left_out in PROFILE_INAPPLICABLE.items():
            unfit = unfit | F.coalesce((F.col("archetype") == name) & module.isin(*left_out), never)
    state = (
        F.when(unfit, "not_applicable").when(module.isin(missing) if missing else never, "unavailable")
        .when(blind, "insufficient_evidence").otherwise("completed")
    )
    return out.withColumn("state", state).select(
        "repo_id", "module_id", F.when(F.col("state") == "completed", score).otherwise(F.lit(-1)).cast("int").alias("score"),
        F.when(F.col("state") == "completed", sure).otherwise(0.0).alias("confidence"), "state", F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"))


def weighted_scores(results: DataFrame, archetypes: DataFrame) -> DataFrame:
    """repo_id, overall_score: mean of the completed modules under the weights of the repository's archetype."""
    rows = results.join(archetypes.select("repo_id", "archetype"), "repo_id", "left")
    weight = F.lit(1.0)
    for name in PROFILE_WEIGHTS:
        weight = F.when(F.col("archetype") == name, profile_weight(F.col("module_id"), name)).otherwise(weight)
    return overall_score(rows, ["repo_id"], weight)
