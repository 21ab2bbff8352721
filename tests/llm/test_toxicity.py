"""Held-out accuracy on made-up text, and the defined results of odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from repohealth.llm import toxicity


def data():
    r = random.Random(4)
    syllables = [a + b for a in "bdgklmnprst" for b in ("a", "e", "i", "o", "en", "ar")]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        w = [word() for _ in range(r.randint(40, 200))]
        if bad:
            for _ in range(max(3, len(w) // 30)):
                w[r.randrange(len(w))] = r.choice(["scoundrel", "Nincompoop", "vile" + word(), "wretched"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = data()
    odd = [(5000, None), (5001, ""), (None, "la la"), (5002, rows[0][1]), (5002, rows[0][1]), (5003, rows[1][1] * 300)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    known = spark.createDataFrame([*labels, (7, 1), (None, 1), (9000, 1), (8, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, known).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    truth = dict(labels)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 5000]
    assert len(held) > 300
    assert np.mean([x.predicted for x in held if truth[x.doc_id]]) > 0.9
    assert np.mean([x.predicted for x in held if not truth[x.doc_id]]) < 0.02
    assert [x.predicted for x in got if x.doc_id == 5002] == [1, 1]
    assert [x.predicted for x in got if x.doc_id in (5000, 5001)] == [0, 0]


def test_one_class_only_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert [x.score for x in toxicity.score(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")).collect()] == [0, 0]
    assert toxicity.score(docs.limit(0), spark.createDataFrame([(1, 0)], "doc_id long, toxic int")).count() == 0


def test_windows_cover_every_byte_of_a_row_and_cross_none():
    offsets = np.array([0, 0, 5, 37, 69, 170])
    segments, places = toxicity.windows(offsets)
    for k in range(5):
        own = segments[places[k]:places[k + 1]]
        assert {b for a, n in own for b in range(a, a + n)} == set(range(offsets[k], offsets[k + 1]))
