"""Classes against brute force over all pairs."""

import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from repohealth.llm import jaccard
from repohealth.llm.components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    passage = [word() for _ in range(60)]
    texts = ["", None, " \n", "one", "ONE", "one two", "one  Two", "a b c d", "a b c d e", "é É é É é", "x " * 3000, "x " * 20]
    for _ in range(12):  # families of near copies, with edits around the threshold
        base = [word() for _ in range(r.randint(8, 160))]
        for _ in range(r.randint(1, 14)):
            x = list(base)
            for _ in range(r.randint(0, max(1, len(x) // 40))):
                x[r.randrange(len(x))] = word()
            if r.random() < 0.3:
                x += [word() for _ in range(r.randrange(len(x) // 4 + 1))]
            texts.append(" ".join(x))
    base = [word() for _ in range(90)]
    for _ in range(70):  # one large family
        x = list(base)
        x[r.randrange(90)] = word()
        texts.append(" ".join(x))
    for _ in range(80):  # different documents that share a passage
        x = [word() for _ in range(r.randint(1, 90))]
        at = r.randrange(len(x))
        texts.append(" ".join(x[:at] + passage + x[at:]))
    texts += [texts[20]] * 40
    rows = list(enumerate(texts, 100))
    r.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus() + [(100, "a repeated id with another text here"), (None, "one"), (None, "nobody else has these words at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("id", F.lit(3)).repartition(6)
    got = sorted((tuple(x) for x in jaccard.near_duplicates(docs).collect()), key=repr)
    assert got == brute(rows)
    kept = jaccard.one_of_each(docs)
    stay = {i for i, _, c in got if i == c} - {i for i, _, c in got if i != c}
    assert {x.doc_id for x in kept.collect()} - {None} == stay and kept.columns == docs.columns


def test_no_rows_and_no_links(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == [(1, 2, 1), (2, 0, 2)]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_bitmap_bound_is_never_too_low():
    r = np.random.default_rng(1)
    for _ in range(300):
        pool = r.integers(0, 1 << 63, 60).astype(np.uint64)
        x, y = (np.unique(r.choice(pool, r.integers(1, 60))) for _ in range(2))
        bits, wide = 64, 256
        a, b = jaccard.bitmap(x, bits), jaccard.fold(jaccard.bitmap(y, wide), wide, bits)
        assert b == jaccard.bitmap(y, bits)
        if jaccard.linked(x, y, 80):
            assert jaccard.may_link(a, b, len(x), len(y), 80)


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200 + i, 200 + (i + 1) % 17) for i in range(17)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 217), 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
