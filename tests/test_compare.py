import hashlib
import random
import re

from repohealth.operators import compare as C

SCHEMA = "repo_id int, file_path string, line int, message string, severity string"
WORDS = ["unused", "variable", "loop", "missing", "check", "token", "value", "a"]


def score(s, a):
    sp, ap = s[1].lower(), a[1].lower()
    out = 0.0
    if sp and ap:
        if sp == ap:
            out = 0.5
        elif sp.endswith(ap) or ap.endswith(sp):
            out = 0.35
        elif sp.split("/")[-1] == ap.split("/")[-1] != "":
            out = 0.25
    place = out
    near = 0.0
    if place > 0 and s[2] is not None and a[2] is not None:
        far = abs(s[2] - a[2])
        near = 0.15 if far == 0 else 0.1 if far <= 5 else 0.05 if far <= 20 else 0.0
    sw, aw = ({w for w in re.split(r"\W+", m.lower()) if len(w) > 2} for m in (s[3], a[3]))
    words = len(sw & aw) / min(len(sw), len(aw)) * 0.3 if sw and aw else 0.0
    same = 0.05 if s[4].lower() == a[4].lower() else 0.0
    return min(place + near + words + same, 1.0)


def side(rng, n):
    def path():
        return rng.choice(["", "a.ts", "b.ts", "x/a.ts", "lib/x/a.ts", "X/B.ts", "zb.ts", "q/zb.ts"])

    def message():
        return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 4)))

    return [(rng.randrange(2), path(), rng.choice([None, 1, 4, 7, 30]), message(), rng.choice(["high", "LOW", "low"])) for _ in range(n)]


def fixture(seed, n=60):
    rng = random.Random(seed)
    return side(rng, n), side(rng, n)


def key(r):
    return (r[0], r[1].lower(), r[2], r[3], r[4].lower())


def test_no_pair_is_missed(spark):
    for seed in (3, 4):
        scan, audit = fixture(seed)
        got = C.similar_pairs(spark.createDataFrame(scan, SCHEMA), spark.createDataFrame(audit, SCHEMA)).collect()
        found = {((r.repo_id, r.s_path, r.s_line, r.s_message, r.s_severity), (r.repo_id, r.a_path, r.a_line, r.a_message, r.a_severity)): (round(r.similarity, 9), r.s_n, r.a_n) for r in got}
        sk, ak = [key(s) for s in scan], [key(a) for a in audit]
        want = {(key(s), key(a)): (round(score(s, a), 9), sk.count(key(s)), ak.count(key(a)))
                for s in scan for a in audit if s[0] == a[0] and score(s, a) >= 0.4}
        assert found == want


def test_spec_values():
    assert round(score((0, "f.ts", 3, "", "low"), (0, "f.ts", 3, "", "low")), 9) == 0.7
    assert score((0, "", 3, "missing check", "low"), (0, "", 3, "missing check", "low")) < 0.4


def test_matching_equals_greedy(spark):
    for seed in (5, 6):
        scan, audit = fixture(seed, 45)
        pairs = C.similar_pairs(spark.createDataFrame(scan, SCHEMA), spark.createDataFrame(audit, SCHEMA))
        left_s, left_a, want = {}, {}, {}
        tie = lambda r: int(hashlib.md5((r.s_id + r.a_id).encode()).hexdigest()[:15], 16)
        listed = sorted(pairs.collect(), key=lambda r: (-round(r.similarity, 6), tie(r), r.s_id, r.a_id))
        for r in listed:
            left_s.setdefault(r.s_id, r.s_n)
            left_a.setdefault(r.a_id, r.a_n)
        for r in listed:
            m = min(left_s[r.s_id], left_a[r.a_id])
            if m > 0:
                want[(r.s_id, r.a_id)] = m
                left_s[r.s_id] -= m
                left_a[r.a_id] -= m
        matched = C.greedy_match(pairs)
        assert {(r.s_id, r.a_id): r.matched for r in matched.collect()} == want
        s = C.profiles(spark.createDataFrame(scan, SCHEMA), "file_path", "s")
        assert sum(r.left for r in C.unmatched(s, matched, "s").collect()) == len(scan) - sum(want.values())


def test_agreement_of_nothing_is_full(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(C.agreement_score(F.lit(0), F.lit(0)).alias("a"), C.agreement_score(F.lit(1), F.lit(3)).alias("b")).first()
    assert tuple(row) == (100, 33)


def test_a_block_of_ties_takes_few_rounds(spark, monkeypatch):
    rows = [(1, f"s{i}", f"a{j}", 0.7, 1 + i % 2, 1) for i in range(200) for j in range(200)]
    pairs = spark.createDataFrame(rows, "repo_id int, s_id string, a_id string, similarity double, s_n int, a_n int")
    written = []
    monkeypatch.setattr(C, "cut_lineage", lambda df, cut=C.cut_lineage: written.append(1) or cut(df))
    got = C.greedy_match(pairs).collect()
    assert len(written) < 2 * 20 and sum(r.matched for r in got) == 200
    assert len({r.a_id for r in got}) == 200 and all(r.matched == 1 for r in got)


def test_crowded_names_give_the_same_pairs_once(spark):
    for seed in (7, 8):
        scan, audit = (spark.createDataFrame(rows, SCHEMA) for rows in fixture(seed))
        s, a = C._numbered(scan, "file_path", "s"), C._numbered(audit, "file_path", "a")
        paired, keyed = ([(r.s_no, r.a_no, round(r.similarity, 9)) for r in C._scored(s, a, n).collect()] for n in (10**6, 0))
        assert sorted(paired) == sorted(keyed) and len({p[:2] for p in keyed}) == len(keyed) > 50


def test_pairs_are_scored_where_they_are_made(spark):
    scan, audit = (spark.createDataFrame(rows, SCHEMA) for rows in fixture(9))
    plan = C.similar_pairs(scan, audit)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("s_id#" in line or "a_id#" in line for line in joins)


def test_one_pass_and_rounds_match_alike(spark, monkeypatch):
    scan, audit = (spark.createDataFrame(rows, SCHEMA) for rows in fixture(10))
    pairs, written = C.similar_pairs(scan, audit), []
    rounds = sorted(map(tuple, C.greedy_match(pairs, limit=0).collect()))
    monkeypatch.setattr(C, "cut_lineage", lambda df, cut=C.cut_lineage: written.append(1) or cut(df))
    assert sorted(map(tuple, C.greedy_match(pairs).collect())) == rounds != [] and len(written) == 2
    monkeypatch.undo()
    assert sorted(map(tuple, C.match_findings(scan, audit).collect())) == rounds
