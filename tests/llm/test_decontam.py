"""Planted leaks are found and clean documents are not; windows agree with a plain reading of the texts."""

import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repohealth.llm import decontam, quality


def words(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(n))


ITEM = "Tom has 12 apples and Anna has 30 pears in the large basket. If Tom gives 12 apples away, how many kg does Anna carry after 3 days in total?"


def test_planted_leaks(spark):
    r = random.Random(2)
    items = [(1, ITEM), (2, "Über " + words(r, 30)), (3, words(r, 7)), (4, "a b"), (5, None), (6, ""), (None, words(r, 40)), (1, ITEM)]
    clean = [(i, words(r, 60)) for i in range(100, 140)] + [(140, None), (141, ""), (142, "7 " * 500), (143, " ".join(items[1][1].split()[3:9]) + words(r, 50))]
    dirty = [
        (1, f"{words(r, 20)}. {ITEM} {words(r, 20)}"),
        (2, f"{words(r, 20)} " + ITEM.replace("Tom", "Igor").replace("Anna", "Maria").replace("12", "45").replace("30", "7.5").replace("kg", "miles").replace(" 3 ", " 1,000 ")),
        (3, words(r, 5) + " " + items[1][1].upper().replace(" ", " \n")),
        (4, f"{words(r, 3)}; {items[2][1]} {words(r, 9)}"),
        (5, words(r, 20_000) + " " + ITEM.lower()),
        (1, f"{words(r, 20)}. {ITEM} {words(r, 20)}"),
    ]
    mixed = ITEM.split()
    for k, x in enumerate(mixed):  # every number another, also where the item repeats one: slots do not agree
        if x.isdigit():
            mixed[k] = str(50 + k)
    docs = spark.createDataFrame(clean + dirty, "doc_id long, text string").withColumn("row", F.lit("clash")).repartition(4)
    got = {(x.doc_id, x.item_id): x for x in decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sorted({d for d, _ in got}) == [1, 2, 3, 4, 5]
    assert {i for d, i in got if d == 2} == {1} and got[2, 1].changed_slots >= 4
    assert got[1, 1].covered_tokens == got[1, 1].item_tokens and got[1, 1].changed_slots == 0
    assert {i for d, i in got if d == 3} == {2} and {i for d, i in got if d == 4} == {3}
    kept = decontam.without_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, _ in clean) and kept.columns == docs.columns


def test_verbatim_copies_of_items_with_few_literals(spark):
    r = random.Random(3)
    sums = "What is " + " + ".join(str(k * 7) for k in range(3, 30)) + "?"
    items = [(1, "Evaluate 12 + 7 * 3 - 45 / 9"), (2, "What is 12 * 7 + 3?"), (3, sums), (4, "zebra quagga okapi")]
    docs = [(i, f"{words(r, 30)}. {t.upper()} {words(r, 30)}") for i, t in items]
    docs += [(10 + i, f"{words(r, 30)}. {re.sub('[0-9]+', lambda m: str(int(m[0]) + 1), t).replace('zebra', 'horse')} {words(r, 30)}") for i, t in items]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()))
    assert got == [(1, 1, 6, 6, 0), (2, 2, 5, 5, 0), (3, 3, 29, 29, 0), (4, 4, 3, 3, 0)]


def test_slots_must_agree():
    hit = lambda place, item, doc: {"i_place": place, "length": 8, "i_slots": item, "slots": doc}
    assert decontam.judged([hit(0, [1, 2], [5, 6]), hit(4, [2, 1], [6, 5])]) == (12, 2)
    assert decontam.judged([hit(0, [1, 2], [5, 6]), hit(1, [1, 2], [5, 6]), hit(20, [1], [9])]) == (9, 2)  # 1 cannot be 5 and 9
    assert decontam.judged([hit(0, [1], [1]), hit(8, [2], [1])])[0] == 8  # nor can 1 and 2 both be 1


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontam.leaks(docs, full).count() == 0
    assert decontam.leaks(full.withColumnRenamed("item_id", "doc_id"), items).count() == 0


@pytest.mark.parametrize("work", ["windows", "measures"])
def test_memory_of_a_task_does_not_follow_its_batch(monkeypatch, work):
    monkeypatch.setattr(decontam.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    text = ITEM + "\n" + words(random.Random(3), 100)

    def peak(n):
        batch = pa.RecordBatch.from_pydict({"doc_id": np.arange(n), "text": [text] * n, "host": np.zeros(n, np.int64)})
        tracemalloc.start()
        rows = decontam._windows([batch], range(1, 9), np.zeros(1 << decontam.FILTER_BITS, bool), False) if work == "windows" else quality._facts([batch])
        for _ in rows:
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    peak(10)  # powers and the like
    assert peak(8000) < 128 << 20  # of 6 MB of text
