import math
import random
import re
from collections import Counter

import pytest

from repohealth.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, rank string, score string, task int", "item_id long, text string, term string, classes string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top):
    """(item, rank, document, score) from the formula, document by document."""
    counts = [(d, Counter(terms(t))) for d, t, *_ in docs]
    n, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t, *_ in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        found = []
        for d, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return out


def same(got, want):
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def sample(seed, n, m):
    r = random.Random(seed)
    lexicon = [f"w{k}" for k in range(60)] + ["Ärger", "naïve", "日本", "E"]
    pick = lambda: lexicon[min(int(r.expovariate(0.1)), len(lexicon) - 1)]
    text = lambda k: "".join(pick() + r.choice([" ", ", ", "\n", "-", "/"]) for _ in range(k))
    docs = [(i, text(r.randrange(0, 80)), "r", "s", 1) for i in range(n)]
    base = text(8)
    items = [(i, base * (i % 3 > 0) + text(r.randrange(0, 12)), "t", "c") for i in range(m)]
    return docs, items


@pytest.mark.parametrize("size", [20, 1 << 20])
def test_against_the_formula(spark, size):
    docs, items = sample(size, 300, 25)
    got = ranking.rank(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS), size=size).collect()
    same(got, plain(docs, items, 10))
    assert len(got) > 200


def test_odd_rows(spark):
    docs, items = sample(3, 40, 6)
    docs += [(None, "w1 w2 w3", "", "", 0), (None, None, "", "", 0), (7, "", "", "", 0), (7, "..,!", "", "", 0), (8, "w1 " * 5000 + "w50", "", "", 0)] + [(50, "w1 w5 w9", "", "", 0)] * 12
    items += [(3, "w9 W9 Ä", "", ""), (None, "w1 w50", "", ""), (90, None, "", ""), (91, "", "", ""), (92, "absent", "", ""), (93, "w5 w1", "", ""), (93, "w5 w1", "", "")]
    got = ranking.rank(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)).collect()
    same(got, plain(docs, items, 10))


def test_empty_tables(spark):
    docs, items = sample(4, 5, 2)
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame(docs, DOCS)
    assert ranking.rank(none, spark.createDataFrame(items, ITEMS)).count() == 0
    assert ranking.rank(some, spark.createDataFrame([], ITEMS)).count() == 0
    assert ranking.rank(spark.createDataFrame([(1, None, "", "", 0)], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0


def test_a_shared_set_is_one_class_and_one_node(spark):
    asked = spark.createDataFrame([(i, t) for i, ts in ((1, "abcx"), (2, "abcy"), (3, "abz"), (4, "q")) for t in map(ord, ts)], "item_id long, term long")
    classes, sequences = ranking.mine(asked)
    of = {chr(r.term): r["class"] for r in classes.collect()}
    assert of["a"] == of["b"] != of["c"] and len(set(of.values())) == 6
    graph = ranking.Graph(classes.toArrow(), sequences.toArrow())
    # a and b once, c below them once, then x, y, z and q
    assert sorted(graph.level) == [0, 0, 1, 1, 2, 2] and sum(map(len, graph.ending)) == 4
