"""Scores against a plain model that walks every text word by word."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repohealth.llm import lm
from repohealth.llm.common import PIECE, scratch_paths, text_buffer, word_hashes, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
END = b"\n"


def tokens(text):
    return [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall((text or "").encode())] + [END]


def brute(rows, order, share):
    """doc_id -> (n_tokens, n_known, N, base, score), with interpolation written out for every history."""
    train = [tokens(t) for i, t, held in rows if not held]
    counts = [Counter(tuple(x[i:i + n]) for x in train for i in range(len(x) - n + 1)) for n in range(1, order + 1)]
    total, types = sum(counts[0].values()), len(counts[0])
    least = max(2, math.ceil(total * share))
    kept = [{g: c for g, c in counts[0].items() if c >= least}]
    for n in range(1, order):
        kept.append({g: c for g, c in counts[n].items() if c >= least})

    def p(history, w):
        if not history:
            return (counts[0][(w,)] + types / (types + 1)) / (total + types) if total else 1.0
        lower = p(history[1:], w)
        follow = [c for g, c in kept[len(history)].items() if g[:-1] == history]
        if not follow:
            return lower
        c = kept[len(history) - 1][history]
        return (kept[len(history)].get((*history, w), 0) + (c - sum(follow) + len(follow)) * lower) / (c + len(follow))

    out = []
    for i, t, held in rows:
        x = tokens(t)
        base = sum(math.log10((counts[0][(w,)] + 0.1) / (total + 0.1 * (types + 1))) for w in x)
        score = sum(math.log10(p(tuple(x[max(0, k - order + 1):k]), w)) for k, w in enumerate(x))
        out.append((i, held, len(x), sum(counts[0][(w,)] > 0 for w in x), total, base, score))
    return out


TEXTS = [
    "a b c a b c a b d", "the cat sat on the mat the cat sat", "", None, "A B  C\na\tb c", "unseen words only zz yy", "a b c " * 400, "the cat sat on the mat",
    "über die brücke über die brücke", "the cat", "a b c", "a b c", "x",
]


@pytest.mark.parametrize(("order", "share"), [(1, 0.01), (2, 0.001), (3, 0.001), (4, 0.0001)])
def test_scores_equal_the_plain_model(spark, order, share):
    rows = [(i, t, i % 5 == 0) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").withColumn("score", F.lit("clash")).withColumn("block", F.lit(1))
    got = sorted(map(tuple, lm.score(docs.repartition(3), F.col("held"), order, share).collect()))
    for g, w in zip(got, brute(rows, order, share), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_ngrams_seen_twice_count_however_large_the_input(spark):
    r = random.Random(1)
    filler = [" ".join(r.choices("pqrstuvwxyz", k=40)) for _ in range(1500)]
    rows = [(i, t, False) for i, t in enumerate(["rare pair here", "a rare pair here", *filler])] + [(5000, "rare pair here", True), (5001, "here rare pair", True)]
    got = {x.doc_id: x for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(4), F.col("held")).collect()}
    assert got[5000].train_tokens > 60_000  # two occurrences are less than 1/20,000 of them
    want = {x[0]: x for x in brute(rows, lm.ORDER, 0)}
    assert [got[i].score for i in (0, 1, 5000, 5001)] == pytest.approx([want[i][-1] for i in (0, 1, 5000, 5001)], rel=1e-9)
    assert got[5000].score > got[5001].score + 2


def test_tables_and_shuffles_have_no_row_for_each_ngram(spark):
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(400)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    begun = len(scratch_paths(spark))
    assert lm.score(docs, F.col("doc_id") % 5 == 0).count() == len(texts)
    written = [spark.read.parquet(p).count() for p in scratch_paths(spark)[begun:]]
    assert written and sum(written) < 1000  # of 24,000 tokens in two blocks: a row for each block, order and bucket at most


def test_long_texts_in_stretches_have_the_states_of_one_walk(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices("abcdefgh", k=n)), i % 4 == 0) for i, n in enumerate([1, 255, 256, 257, 511, 513, 1500, 90])]
    got = sorted(map(tuple, lm.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean"), F.col("held")).collect()))
    assert [g[-1] for g in got] == pytest.approx([w[-1] for w in brute(rows, lm.ORDER, 0)], rel=1e-12)


def test_probabilities_of_a_state_add_up_to_one():
    kept = [{(1,): 6, (2,): 4, (3,): 2}, {(1, 2): 3, (1, 3): 2}]
    model = lm.build(kept, tokens=15, types=5)
    state = model.entry[0]
    root = lambda c: lm.root_probability(c, 15, 5)
    arcs = sum(10 ** model.arc_cost[k] for k, key in enumerate(model.arc_key) if key // 3 == state)
    others = root(6) + 2 * root(1.5) + root(0)  # word 1, two words that are not kept (3 tokens together), unknown
    assert arcs + 10 ** model.backoff[state] * others == pytest.approx(1)


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = lm.score(docs, F.lit(True)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    assert lm.score(docs.limit(0), F.lit(False)).count() == 0


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", lm.fold(F.col("id")).alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.id).encode()) % 10 == 0) for r in got)


def test_words_are_hashed_in_pieces():
    texts = ["ab cd " * (PIECE // 4), "x" * (2 * PIECE) + " ab", None, "", "cd  " + " " * PIECE + "ab"]
    raw, offsets = text_buffer(pa.array(texts))
    starts, ends, _ = words(raw, offsets)
    alone = {w: word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in (b"ab", b"cd", b"x" * (2 * PIECE))}
    data = raw.tobytes()
    assert word_hashes(raw, starts, ends).tolist() == [alone[data[a:b]] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def test_memory_of_a_block_while_its_words_are_hashed():
    texts = pa.array(["some words of a text " * 1000] * 400)  # 8.4 MB
    lm.token_hashes(texts[:1])
    tracemalloc.start()
    lm.token_hashes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * texts.nbytes
