import math
import random

import numpy as np
import pytest

from repohealth.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, block string, row string, v string, a_n int"


def plain(rows, every, k, m, low=30, high=90, scale=256):
    """(anchor, positive, rank, negative, scores) by comparing all rows."""
    good = [(i, c, [math.floor(scale * x) for x in v]) for i, c, v, *_ in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, c, v) in enumerate(good):
        if i % every:
            continue
        score = {b: sum(x * y for x, y in zip(v, w)) for b, (_, _, w) in enumerate(good)}
        order = sorted((b for b in score if b != a), key=lambda b: (-score[b], good[b][0]))
        for p in [b for b in order if good[b][1] == c][:k]:
            fit = [b for b in order if good[b][1] != c and low * score[p] <= 100 * score[b] <= high * score[p]]
            out += [(i, good[p][0], r + 1, good[b][0], score[p], score[b]) for r, b in enumerate(fit[:m])]
    return sorted(out)


def rows_of(r, n, dims, levels=None):
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    out = []
    for i in range(n):
        c = r.randrange(4)
        v = [(x + r.gauss(0, 0.7)) / 5 for x in centres[c]]
        out.append((i, c, [round(x * levels) / levels for x in v] if levels else v, "b", "r", "v", 1))
    return out


@pytest.mark.parametrize("size", [16, 4096])
@pytest.mark.parametrize("levels", [None, 4])
def test_against_all_pairs(spark, size, levels):
    rows = rows_of(random.Random(size), 300, 20, levels)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(x) for x in negatives.mine(df, every=10, size=size).collect())
    assert got == plain(rows, 10, 5, 10) and len(got) > 500


def test_odd_rows(spark):
    r = random.Random(2)
    rows = rows_of(r, 60, 6)
    rows += [(100, 1, None, "", "", "", 0), (101, None, [1.0] * 6, "", "", "", 0), (None, 1, [1.0] * 6, "", "", "", 0), (110, 1, [1.0, None] + [0.0] * 4, "", "", "", 0), (120, 2, [float("nan")] * 6, "", "", "", 0), (130, 2, [float("inf")] * 6, "", "", "", 0)]
    rows += [(200, 1, [0.0] * 6, "", "", "", 0), (210, 1, [-0.5] * 6, "", "", "", 0), (220, 3, [], "", "", "", 0), (230, 1, [0.9, 0.1], "", "", "", 0)]
    rows += [rows[10]] * 3 + [(10, (rows[10][1] + 1) % 4, rows[10][2], "", "", "", 0)]
    got = sorted(tuple(x) for x in negatives.mine(spark.createDataFrame(rows, SCHEMA), every=10, size=16).collect())
    assert got == plain(rows, 10, 5, 10)


def test_large_numbers_without_bounds(spark):
    r = random.Random(8)
    rows = [(i, i % 3, [r.uniform(0.5, 1) * 1e6 for _ in range(5)], "", "", "", 0) for i in range(60)]
    got = sorted(tuple(x) for x in negatives.mine(spark.createDataFrame(rows, SCHEMA), every=10, size=16).collect())
    assert got == plain(rows, 10, 5, 10) and got


def test_hot_copies_and_one_label(spark):
    rows = [(i, 0 if i % 3 else 1, [0.25, 0.5, -0.125], "", "", "", 0) for i in range(200)]
    got = sorted(tuple(x) for x in negatives.mine(spark.createDataFrame(rows, SCHEMA), every=50, size=16).collect())
    assert got == plain(rows, 50, 5, 10)
    alone = [(i, 0, v, *rest) for i, _, v, *rest in rows]
    assert negatives.mine(spark.createDataFrame(alone, SCHEMA)).count() == 0


def test_no_rows(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_drop_candidates():
    r = np.random.default_rng(1)
    data = (r.normal(size=(32, 500)) * 100).astype("<i2")
    block = negatives.Block({"n": 500, "dims": 32, "data": data.tobytes(), **{c: np.arange(500, dtype="<i8").tobytes() for c in ("ids", "labels", "rows")}})
    anchor = data[:, 3].astype(np.int64)
    anchor[8:] //= 50
    left, score = block.scan(anchor, np.ones(500, bool), negatives.best(5))
    exact = anchor @ data.astype(np.int64)
    assert len(left) < 100 and (score == exact[left]).all() and set(np.argsort(-exact)[:5]) <= set(left)
