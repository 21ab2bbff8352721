"""Comparing reviewers: similarity join, one-to-one matching, agreement of providers, presence on both sides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repohealth.functions.paths import basename
from repohealth.functions.scalars import count_if, half_up, keep_found, normalise_category, normalise_file, overlap_ratio, word_set
from repohealth.session import cut_lineage, release, ship

THRESHOLD = 0.4
FIELDS = ("path", "line", "message", "severity")
NAME_PAIRS = 1_000_000  # above, findings of one file name are not all paired
REPO_PAIRS = 2_000_000  # above, the pairs of a repository are matched in rounds


def distinct_findings(findings: DataFrame, path: str, prefix: str) -> DataFrame:
    """Distinct findings of a side with their number of copies.

    A third of all rows may be copies of one finding; they become one row here,
    before anything is joined, and are counted again in the results.
    """
    cols = [F.col("repo_id"), F.lower(F.coalesce(F.col(path), F.lit(""))).alias("path"), F.col("line"), F.col("message"),
            F.lower("severity").alias("severity")]
    rows = findings.select(*cols).groupBy("repo_id", *FIELDS).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("repo_id", *[F.col(c).alias(f"{prefix}_{c}") for c in (*FIELDS, "n")])


def finding_id(p: str) -> Column:
    """Id of a distinct finding: the md5 of its repository and fields."""
    line = F.coalesce(F.col(f"{p}_line").cast("string"), F.lit("-"))
    return F.md5(F.concat_ws("\x1f", F.col("repo_id").cast("string"), f"{p}_path", line, f"{p}_message", f"{p}_severity"))


def profiles(findings: DataFrame, path: str, prefix: str) -> DataFrame:
    """Distinct findings of a side with their ids and words."""
    rows = distinct_findings(findings, path, prefix)
    return rows.select("repo_id", finding_id(prefix).alias(f"{prefix}_id"), *rows.columns[1:], word_set(F.col(f"{prefix}_message")).alias(f"{prefix}_words"))


def _numbered(findings: DataFrame, path: str, p: str) -> DataFrame:
    """Distinct findings of a side, written once with a number each: ids and words are made where they are read."""
    return cut_lineage(distinct_findings(findings, path, p).withColumn(f"{p}_no", F.monotonically_increasing_id()))


def path_score(left: Column, right: Column) -> Column:
    known = (left != "") & (right != "")
    return (
        F.when(known & (left == right), 0.5)
        .when(known & (left.endswith(right) | right.endswith(left)), 0.35)
        .when(known & (basename(left) != "") & (basename(left) == basename(right)), 0.25)
        .otherwise(0.0)
    )


def similarity(row: dict[str, Column]) -> Column:
    """Score of a pair: place, line distance when there is a place, shared words, equal severity; at most 1."""
    place = path_score(row["s_path"], row["a_path"])
    far = F.abs(row["s_line"] - row["a_line"])
    near = F.when((place > 0) & far.isNotNull(), F.when(far == 0, 0.15).when(far <= 5, 0.1).when(far <= 20, 0.05).otherwise(0.0)).otherwise(0.0)
    words = overlap_ratio(row["s_words"], row["a_words"]) * F.lit(0.3)
    same = F.when(row["s_severity"] == row["a_severity"], 0.05).otherwise(0.0)
    return F.least(place + near + words + same, F.lit(1.0))


def _crowded(s: DataFrame, a: DataFrame, limit: int) -> DataFrame | None:
    """File names that too many findings of both sides share to pair them all, or None."""
    counts = s.groupBy("repo_id", "_name").agg(F.count(F.lit(1)).alias("_s")).join(
        a.groupBy("repo_id", "_name").agg(F.count(F.lit(1)).alias("_a")), ["repo_id", "_name"])
    names = cut_lineage(counts.where(F.col("_s") * F.col("_a") > limit).select("repo_id", "_name"))
    return None if names.isEmpty() else names


def _by_suffix(s: DataFrame, a: DataFrame) -> DataFrame:
    """Pairs with different file names of which one, a path without folders, ends the other."""
    def spread(df: DataFrame, p: str, other: str) -> DataFrame:
        names = df.select("repo_id", F.col("_name").alias(f"{p}_name")).where(F.length(f"{p}_name") > 1).distinct()
        tails = F.transform(F.sequence(F.lit(2), F.length(f"{p}_name")), lambda i: F.substr(F.col(f"{p}_name"), i))
        return names.select("repo_id", f"{p}_name", F.explode(tails).alias(f"{other}_name"))

    def short(df: DataFrame, p: str) -> DataFrame:
        return df.where(F.col(f"{p}_path") == F.col("_name")).withColumnRenamed("_name", f"{p}_name")

    def pairs(longer: DataFrame, lp: str, shorter: DataFrame, sp: str) -> DataFrame:
        ends = spread(longer, lp, sp).join(short(shorter, sp).select("repo_id", f"{sp}_name").distinct(), ["repo_id", f"{sp}_name"], "left_semi")
        found = longer.withColumnRenamed("_name", f"{lp}_name").join(ends, ["repo_id", f"{lp}_name"])
        return found.join(short(shorter, sp), ["repo_id", f"{sp}_name"])

    columns = ["repo_id", *[c for df in (s, a) for c in df.columns if c not in ("repo_id", "_name")]]
    return pairs(s, "s", a, "a").select(*columns).union(pairs(a, "a", s, "s").select(*columns))


def _selective(s: DataFrame, a: DataFrame) -> DataFrame:
    """Pairs of one file name that can reach the threshold, each from exactly one equi join.

    With equal or suffix paths (.5, .35) the paths themselves are joined, each
    distinct path spread into its suffixes. With only the file name in common (.25)
    a pair still needs .15: the same line, or the same severity within five lines,
    or a shared word. Each of these is a join key of its own, so files called alike
    are not all paired, and a join leaves out what one before it has found.
    """
    columns = ["repo_id", *[c for df in (s, a) for c in df.columns if c not in ("repo_id", "_name")]]

    def paths(df: DataFrame, p: str) -> DataFrame:
        return df.select("repo_id", f"{p}_path").distinct()

    def suffixes(df: DataFrame, p: str, other: str) -> DataFrame:
        """Every suffix of every distinct path, under the name of the other side's path."""
        tails = F.transform(F.sequence(F.lit(1), F.length(f"{p}_path")), lambda i: F.substr(F.col(f"{p}_path"), i))
        return paths(df, p).select("repo_id", f"{p}_path", F.explode(tails).alias(f"{other}_path"))

    def keyed(df: DataFrame, *keys: Column) -> DataFrame:
        return df.select("*", *keys)

    ends = suffixes(s, "s", "a").join(paths(a, "a"), ["repo_id", "a_path"], "left_semi").select("repo_id", "s_path", "a_path")
    ends = ends.union(suffixes(a, "a", "s").join(paths(s, "s"), ["repo_id", "s_path"], "left_semi").select("repo_id", "s_path", "a_path")).distinct()
    by_path = s.join(ends, ["repo_id", "s_path"]).join(a, ["repo_id", "_name", "a_path"])
    rest = path_score(F.col("s_path"), F.col("a_path")) == 0.25
    line = F.coalesce(F.col("s_line") == F.col("a_line"), F.lit(False))
    close = F.coalesce((F.abs(F.col("s_line") - F.col("a_line")) <= 5) & (F.col("s_severity") == F.col("a_severity")), F.lit(False))
    name = ["repo_id", "_name"]
    by_line = keyed(s, F.col("s_line").alias("_line")).join(keyed(a, F.col("a_line").alias("_line")), [*name, "_line"]).where(rest)
    cell = lambda c: F.floor(F.col(c) / 6)
    around = F.explode(F.array(*[cell("a_line") + d for d in (-1, 0, 1)])).alias("_cell")
    by_severity = keyed(s, cell("s_line").alias("_cell"), F.col("s_severity").alias("_sev")).join(
        keyed(a, around, F.col("a_severity").alias("_sev")), [*name, "_cell", "_sev"]).where(rest & ~line & close)
    word = lambda c: F.explode(F.col(c)).alias("_word")
    first = F.array_min(F.array_intersect("s_words", "a_words")) == F.col("_word")
    by_word = keyed(s, word("s_words")).join(keyed(a, word("a_words")), [*name, "_word"]).where(rest & ~line & ~close & first)
    return by_path.select(*columns).union(by_line.select(*columns)).union(by_severity.select(*columns)).union(by_word.select(*columns))


def similar_pairs(scan: DataFrame, audit: DataFrame, scan_path: str = "file_path", audit_path: str = "file_path") -> DataFrame:
    """Pairs of distinct findings of the two sides that score at least the threshold, with their numbers of copies.

    The distinct findings of a side are read by several joins, so they are written once.
    """
    rows = _scored(_numbered(scan, scan_path, "s"), _numbered(audit, audit_path, "a"))
    fields = [f"{p}_{c}" for p in "sa" for c in (*FIELDS, "n")]
    return rows.select(finding_id("s").alias("s_id"), finding_id("a").alias("a_id"), "repo_id", *fields, "similarity")


def _scored(s: DataFrame, a: DataFrame, limit: int = NAME_PAIRS) -> DataFrame:
    """All pairs that reach the threshold, scored in the join that makes them: no pair is shuffled.

    Without a common place a pair scores at most .35, so both ends have a path, and
    either the same file name or one path without folders that ends the other's name.
    Findings of one file name meet in one join; where a name has more than ``limit``
    pairs, selective keys bring together only those that can reach the threshold.
    """
    s, a = (df.where(F.col(f"{p}_path") != "").select(
        "*", basename(F.col(f"{p}_path")).alias("_name"), word_set(F.col(f"{p}_message")).alias(f"{p}_words")) for df, p in ((s, "s"), (a, "a")))
    name, others = ["repo_id", "_name"], _by_suffix(s, a)
    crowded = _crowded(s, a, limit)
    if crowded is None:
        pairs = s.join(a, name).drop("_name")
    else:
        pairs = s.join(crowded, name, "left_anti").join(a, name).drop("_name")
        pairs = pairs.union(_selective(s.join(crowded, name, "left_semi"), a.join(crowded, name, "left_semi")).select(*pairs.columns))
    pairs = pairs.union(others.select(*pairs.columns))
    score = similarity({f"{p}_{c}": F.col(f"{p}_{c}") for p in "sa" for c in (*FIELDS, "words")})
    return keep_found(pairs, "similarity", F.when(score >= THRESHOLD, score)).drop("s_words", "a_words")


def match_order(s_id: Column, a_id: Column) -> Column:
    """Number that orders pairs of equal similarity: the first 60 bits of the md5 of both ids.

    Any total order makes the matching unique. Under one that looks random, a block
    of ties has many pairs that are the best of both their ends, so it takes a
    logarithmic number of rounds; an order by ids would give one pair a round.
    """
    return F.conv(F.substring(F.md5(F.concat(s_id, a_id)), 1, 15), 16, 10).cast("bigint")


def greedy_match(pairs: DataFrame, limit: int = REPO_PAIRS) -> DataFrame:
    """One-to-one matching, best similarity (six digits) first, ties by ``match_order``.

    No pair crosses repositories. A repository of up to ``limit`` pairs is matched
    by one pass over them in order, many repositories to a task; larger ones go
    through rounds over all of them.
    """
    return _matched(pairs.select("repo_id", "s_id", "a_id", _level(), "s_n", "a_n", match_order(F.col("s_id"), F.col("a_id")).alias("tie")), limit)


def _level() -> Column:
    return F.round("similarity", 6).alias("similarity")


def _matched(pairs: DataFrame, limit: int = REPO_PAIRS) -> DataFrame:
    """Matching of (repo_id, s_id, a_id, similarity, s_n, a_n, tie); ids may be of any type that can be ordered."""
    ship(pairs.sparkSession)
    left = cut_lineage(pairs)
    counts = left.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(counts.where(F.col("n") > limit).select("repo_id"))
    crowded = not large.isEmpty()
    small = left.join(large, "repo_id", "left_anti") if crowded else left
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("repo_id", "s_id", "a_id", "similarity")) + f", matched {kinds['s_n']}"
    # a group has about 200,000 pairs, or those of a single repository
    bucket = F.pmod(F.xxhash64("repo_id"), F.lit(32 + left.count() // 200_000)).alias("_bucket")
    found = small.groupBy(bucket).applyInArrow(_in_order, schema)
    return found.union(_in_rounds(left.join(large, "repo_id", "left_semi"))) if crowded else found


def _in_order(pairs: pa.Table) -> pa.Table:
    """Greedy matching of whole repositories: their pairs in order, each as many copies as both ends have left."""
    pairs = pairs.sort_by([("similarity", "descending"), ("tie", "ascending"), ("s_id", "ascending"), ("a_id", "ascending")]).combine_chunks()
    ends, left = [], []
    for end, copies in (("s_id", "s_n"), ("a_id", "a_n")):
        code = pairs[end].combine_chunks().dictionary_encode().indices.to_numpy()
        n = np.zeros(code.max(initial=-1) + 1, "int64")
        n[code] = pairs[copies].to_numpy()
        ends.append(code.tolist())
        left.append(n.tolist())
    rows, matched = [], []
    left_s, left_a = left
    for i, (x, y) in enumerate(zip(*ends)):
        if left_s[x] and left_a[y]:
            m = min(left_s[x], left_a[y])
            left_s[x] -= m
            left_a[y] -= m
            rows.append(i)
            matched.append(m)
    taken = pairs.select(["repo_id", "s_id", "a_id", "similarity"]).take(pa.array(rows, pa.int64()))
    return taken.append_column("matched", pa.array(matched, pairs.schema.field("s_n").type))


def _in_rounds(pairs: DataFrame) -> DataFrame:
    """The same matching for repositories of any size.

    A pair that is the best of both its ends is what the greedy order would take,
    so each round takes all such pairs at once, as many copies as both ends have
    left. The rest goes on without the exhausted ends, until there is none.
    """
    columns = ["repo_id", "s_id", "a_id", "similarity", "s_n", "a_n", "tie"]
    left = cut_lineage(pairs.select(*columns))
    order = F.struct((-F.col("similarity")).alias("a"), F.col("tie"), F.col("s_id"), F.col("a_id"))
    zero, taken = F.lit(0), []
    while not left.isEmpty():
        best_s = left.groupBy("s_id").agg(F.min_by("a_id", order).alias("a_id"))
        best_a = left.groupBy("a_id").agg(F.min_by("s_id", order).alias("s_id"))
        mutual = cut_lineage(
            left.join(best_s, ["s_id", "a_id"], "left_semi").join(best_a, ["s_id", "a_id"], "left_semi")
            .select("repo_id", "s_id", "a_id", "similarity", F.least("s_n", "a_n").alias("matched")))
        taken.append(mutual)
        used_s = mutual.select("s_id", F.col("matched").alias("_us"))
        used_a = mutual.select("a_id", F.col("matched").alias("_ua"))
        rest = {"s_n": F.col("s_n") - F.coalesce("_us", zero), "a_n": F.col("a_n") - F.coalesce("_ua", zero)}
        after = cut_lineage(left.join(used_s, "s_id", "left").join(used_a, "a_id", "left").select(
            *[rest.get(c, F.col(c)).alias(c) for c in columns]).where("s_n > 0 AND a_n > 0"))
        release(left)
        left = after
    if not taken:
        return left.select("repo_id", "s_id", "a_id", "similarity", F.col("s_n").alias("matched"))
    out = taken[0]
    for part in taken[1:]:
        out = out.union(part)
    return out


def _numbered_matches(s: DataFrame, a: DataFrame) -> DataFrame:
    """Matching of numbered findings; the numbers stand for the ids, which only the order of ties reads."""
    tie = match_order(finding_id("s"), finding_id("a")).alias("tie")
    return _matched(_scored(s, a).select("repo_id", F.col("s_no").alias("s_id"), F.col("a_no").alias("a_id"), _level(), "s_n", "a_n", tie))


def match_findings(scan: DataFrame, audit: DataFrame, scan_path: str = "file_path", audit_path: str = "file_path") -> DataFrame:
    """``greedy_match`` of the similar pairs of two sides; the pairs carry numbers instead of ids until they are matched."""
    s, a = _numbered(scan, scan_path, "s"), _numbered(audit, audit_path, "a")
    found = _numbered_matches(s, a).withColumnsRenamed({"s_id": "s_no", "a_id": "a_no"})
    named = found.join(s.drop("repo_id"), "s_no").join(a.drop("repo_id"), "a_no")
    return named.select("repo_id", finding_id("s").alias("s_id"), finding_id("a").alias("a_id"), "similarity", "matched")


def match_remainders(scan: DataFrame, audit: DataFrame, scan_path: str = "file_path", audit_path: str = "file_path") -> DataFrame:
    """Every distinct finding of both sides with how many of its copies were matched and how many only its side has."""
    s, a = _numbered(scan, scan_path, "s"), _numbered(audit, audit_path, "a")
    matches = cut_lineage(_numbered_matches(s, a))

    def side(df: DataFrame, p: str, name: str) -> DataFrame:
        used = matches.groupBy(F.col(f"{p}_id").alias(f"{p}_no")).agg(F.sum("matched").alias("_used"))
        matched = F.coalesce("_used", F.lit(0))
        return df.join(used, f"{p}_no", "left").select(
            F.lit(name).alias("side"), "repo_id", *[F.col(f"{p}_{c}").alias(c) for c in FIELDS],
            matched.cast("bigint").alias("matched"), (F.col(f"{p}_n") - matched).cast("bigint").alias("only_here"))

    return side(s, "s", "scan").union(side(a, "a", "audit"))


def unmatched(side: DataFrame, matches: DataFrame, prefix: str) -> DataFrame:
    """Findings of a side left over after matching, with how many copies are left."""
    used = matches.groupBy(f"{prefix}_id").agg(F.sum("matched").alias("_used"))
    left = F.col(f"{prefix}_n") - F.coalesce("_used", F.lit(0))
    return side.join(used, f"{prefix}_id", "left").withColumn("left", left).where("left > 0").drop("_used")


def match_keys(findings: DataFrame) -> DataFrame:
    """Distinct agreement keys: module, and normalised file with normalised category."""
    file = F.when(F.coalesce(F.col("file"), F.lit("")) == "", "__no_file__").otherwise(normalise_file(F.col("file")))
    key = F.concat(file, F.lit("::"), normalise_category(F.col("category")))
    return findings.select("provider", "module_id", key.alias("key")).distinct()


def agreement(findings: DataFrame, first: str, second: str) -> DataFrame:
    """Agreement of two providers per module: shared keys over all keys; 100 when neither found anything."""
    sides = match_keys(findings.where(F.col("provider").isin(first, second))).groupBy("module_id", "key").agg(
        F.max((F.col("provider") == first).cast("int")).alias("a"), F.max((F.col("provider") == second).cast("int")).alias("b"))
    both = (F.col("a") == 1) & (F.col("b") == 1)
    return sides.groupBy("module_id").agg(
        count_if(both).alias("agreed"), count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_first"),
        count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_second"), F.count(F.lit(1)).alias("union_size"),
    ).withColumn("agreement", agreement_score(F.col("agreed"), F.col("union_size")))


def agreement_score(agreed: Column, union: Column) -> Column:
    return F.coalesce(half_up(agreed / F.nullif(union, F.lit(0)) * 100), F.lit(100)).cast("int")


def presence(scan: DataFrame, audit: DataFrame, keys: list[str]) -> DataFrame:
    """Finding counts of both sides per key with presence flags; a missing side counts 0."""
    left = scan.groupBy(*keys).agg(F.count(F.lit(1)).alias("_s"))
    right = audit.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    zero = F.lit(0)
    return left.join(right, keys, "full_outer").select(
        *keys, F.col("_s").isNotNull().alias("in_scan"), F.col("_a").isNotNull().alias("in_audit"),
        F.coalesce("_s", zero).cast("bigint").alias("scan_findings"), F.coalesce("_a", zero).cast("bigint").alias("audit_findings"),
    )
