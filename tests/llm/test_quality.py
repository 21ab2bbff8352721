"""Measures against a brute-force version, and the rule across documents on planted lines."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from repohealth.llm import quality

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    r = random.Random(5)
    pool = ["a", "b", "cc", "ü", "ñandú", "#x", "|", "\n", "\n\n", "\t", " ", "\r\n", " line ", " ", "The", "9"]
    out = ["", None, "\n", " \n ", "one", "a b c d e a b c d e", "x\nx\nx", "x \nx\n x", "a" * 5000, "a b " * 700, "p q r s t\n" * 3 + "u"]
    return out + ["".join(r.choice(pool) + r.choice(["", " "]) for _ in range(r.randrange(80))) for _ in range(150)]


def test_measures_equal_brute_force(spark):
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}") for i, t in enumerate(texts())]
    rows += rows[:3] + [(None, "no id here", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_words", F.lit("clash")).withColumn("row", F.lit(1)).repartition(3)
    got = sorted((tuple(r)[:6] for r in quality.judge(docs).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t, _ in rows), key=repr)


def test_no_rows(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_lines_of_many_documents_are_removed_and_depleted_documents_rejected(spark):
    r = random.Random(1)
    line = lambda: " ".join("".join(r.choices("abcdefgh", k=7)) for _ in range(8))
    footer = [line() for _ in range(3)]
    rows = [(i, f"{line()}\n{line()}\n{footer[i % 3]}", "a") for i in range(150)]  # clean, with a footer
    mixed = [(1000 + i, "\n".join([footer[0].upper(), footer[1], "  ".join(footer[2].split())][:2 + i % 2]) + f"\nw{i}", "a") for i in range(40)]
    other = [(200, "\n".join(footer), "b")]  # the same lines in another host
    copies = [(300 + i, "\n".join(line_ for line_ in ["one two three four five six", "seven eight nine ten eleven twelve"]), "a") for i in range(80)]
    base = [line() for _ in range(12)]
    near = []
    for i in range(80):
        x = list(base)
        x[r.randrange(12)] += f" edit{i}"
        near.append((400 + i, "\n".join(x), "c"))
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows + mixed + other + copies + near, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept and got[i].n_removed_words == 8 for i, _, _ in rows)
    assert not any(got[i].kept or got[i].base_failed for i, _, _ in mixed)
    assert all(got[i].kept for i, _, _ in other + copies)
    assert sum(got[i].kept for i, _, _ in near) == len(near)


def test_template_lines_of_every_host_go(spark):
    r = random.Random(4)
    line = lambda: " ".join("".join(r.choices("abcdefgh", k=7)) for _ in range(8))
    rows = []
    for h in range(30):
        shared = [line() for _ in range(10)]
        rows += [(1000 * h + i, "\n".join([*shared, line()]), f"h{h}") for i in range(60)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(x.n_removed_words == 80 and not x.kept for x in got)


def test_an_absolute_limit_holds_in_large_hosts(spark):
    r = random.Random(7)
    line = lambda: " ".join("".join(r.choices("abcdefgh", k=7)) for _ in range(12))
    footer = line()
    rows = [(i, line() + f"\n{footer}" * (i < 60), "a") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cut = lambda **x: {r.doc_id for r in quality.judge(docs, **x).where("n_removed_words = 12").collect()}
    assert cut() == set() and cut(max_documents=50) == set(range(60))
