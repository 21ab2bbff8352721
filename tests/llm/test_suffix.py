"""Removed bytes against brute force over all windows."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from repohealth.llm import jaccard, suffix

N = suffix.LENGTH


def brute(rows):
    texts = sorted({(1 << 63 if i is None else i, (t or "").encode()) for i, t in rows})
    seen, removed = {}, {}
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - N + 1):
            first = seen.setdefault(t[s:s + N], (i, s))
            if first < (i, s):
                gone[s:s + N] = True
        removed[i, t] = gone
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = removed[1 << 63 if i is None else i, raw]
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((i, len(raw), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghiñü", k=r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(4)]
    out = ["", None, "short", "a" * 99, "a" * 100, "a" * 101, "a" * 5000, "ab" * 700, ("xyz" * 40 + "q") * 30, text(9000)]
    for _ in range(90):
        x = [text(r.randint(1, 60)) for _ in range(r.randint(1, 4))]
        if r.random() < 0.7:
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            x.insert(r.randrange(len(x) + 1), p[a:a + r.randint(60, len(p))])
        out.append(" ".join(x))
    near = list(out[40])
    near[len(near) // 2] = "Q"
    out += [out[30]] * 5 + ["".join(near), out[41][:101], out[42][-100:], out[43][5:], out[9][3000:3500] * 3]
    r.shuffle(out)
    return list(enumerate(out))


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tid", F.lit("clash")).withColumn("__x", F.lit(1)).repartition(5)
    got = suffix.without_repeats(docs)
    assert got.columns[:4] == docs.columns
    assert sorted((tuple(x) for x in got.select("doc_id", "__bytes", "__removed", "__spans", "__sha256").collect()), key=repr) == brute(rows)
    return got


def test_removed_bytes_equal_brute_force(spark):
    rows = corpus()
    got = check(spark, rows + [rows[12], (None, rows[50][1])])
    text = {x.doc_id: x["__text"] for x in got.collect()}
    assert all(text[i] == (t or "") for i, t in rows if len((t or "").encode()) < N)


def test_no_rows(spark):
    assert suffix.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_of_a_text_with_a_passage_in_several_partitions(spark):
    r = random.Random(8)
    line = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage = line(400)
    text, other = f"{line(150)}{passage}{line(150)}", f"{line(150)}{passage}{line(150)}"
    rows = [(50, other), (100, text), (5, text), (7, line(300))]
    # the first copy is in another task than the later one and the passage's other text
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    assert [[x.doc_id for x in part] for part in docs.rdd.glom().collect()] == [[50, 100], [5, 7]]
    got = suffix.without_repeats(docs).collect()
    assert sorted(((x.doc_id, x["__bytes"], x["__removed"], x["__spans"], x["__sha256"]) for x in got), key=repr) == brute(rows)
    assert [x.doc_id for x in got if passage in x["__text"]] == [5]


def test_windows_of_a_hot_key_dealt_out_one_by_one():
    import pyarrow as pa


    class Shared:
        def __init__(self, value):
            self.value = value

    r = random.Random(2)
    passage = bytes(r.choices(b"abcdefgh ", k=300))
    texts = [bytes(r.choices(b"abcdefgh ", k=150)) + passage + bytes(r.choices(b"abcdefgh ", k=150)) for _ in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(range(100, 112)), pa.array([t.decode() for t in texts])], names=["doc", "tid", "text"])
    every = Shared(np.full(1 << jaccard.BITMAP_BITS - 6, ~np.uint64(0)))
    results = []
    for hot in (None, every):
        strings = pa.Table.from_batches(suffix._strings([batch], every, hot))
        done = [(x["tid"], x["first"], x["stop"]) for x in strings.to_pylist() if x["string"] is None]
        rows = strings.filter(pa.compute.is_valid(strings["string"])).sort_by("hash").to_batches()
        for out in suffix._intervals(rows):
            done += [tuple(x.values()) for x in out.to_pylist()]
        results.append({(t, k) for t, a, b in done for k in range(a, b)})
    seen, want = set(), set()
    for d, t in enumerate(texts):
        for k in range(len(t) - N + 1):
            if t[k:k + N] in seen:
                want |= {(100 + d, b) for b in range(k, k + N)}
        seen |= {t[k:k + N] for k in range(len(t) - N + 1)}
    assert results[0] == results[1] == want


def test_anchor_of_a_window_depends_on_its_bytes_alone():
    r = random.Random(3)
    window = bytes(r.choices(b"ab", k=N))
    found = set()
    for n in (0, 1, 7, 150, 4000):
        raw = np.frombuffer(bytes(r.choices(b"ab", k=n)) + window + bytes(r.choices(b"ab", k=n)), np.uint8)
        _, hashes, at, lo, hi = suffix.anchors(raw, np.array([0, len(raw)]))
        k = np.flatnonzero((lo <= n) & (n <= hi))
        found.add((int(hashes[k[0]]), int(at[k[0]]) - n))
        assert len(k) == 1
    assert len(found) == 1


def test_equal_windows_have_equal_keys_and_every_window_has_one():
    r = random.Random(5)
    for symbols in (b"ab", b"a", b"abcdefghij "):
        texts = [bytes(r.choices(symbols, k=n)) for n in (0, 99, 100, 101, 400)]
        shared = bytes(r.choices(symbols, k=140))
        texts += [bytes(r.choices(symbols, k=n)) + shared + bytes(r.choices(symbols, k=n)) for n in (0, 3, 77, 200)]
        raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        row, keys, at, lo, hi = suffix.keyed(raw, offsets)
        of, seen = {}, set()
        for k in range(len(keys)):
            for s in range(int(lo[k]), int(hi[k]) + 1):
                assert s not in seen and s + N <= offsets[row[k] + 1]
                seen.add(s)
                of.setdefault(raw[s:s + N].tobytes(), set()).add((int(keys[k]), int(at[k]) - s))
        assert seen == {s for a, b in zip(offsets, offsets[1:]) for s in range(a, b - N + 1)}
        assert all(len(x) == 1 for x in of.values())
