"""Pieces against a plain packing of whole texts by the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from repohealth.llm import packing
from repohealth.llm.queries import vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(vocabulary())


def texts(n=120):
    r = random.Random(3)
    pool = ["The", "cat", "don't", "x's.", "3.14", "ñandú,", "É", "…", ". ,", ".,", "<|endoftext|>", "a<|startoftext|>b", " ", "İ", "日本", "é", "\x00", "ﬁ", "a,b.c", "#$%"]
    out = ["", None, " \n\t", "a", "word " * 30_000]
    return out + ["".join(r.choice(pool) + r.choice(["", " ", "\n", "  "]) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("sequence", [64, 4096])
def test_pieces(spark, tokenizer, sequence):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "a"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(5)
    got = packing.pack(docs, vocabulary(), sequence).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    found = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length and zlib.crc32(bytes(p.ids)) == p.ids_crc32
        if p.start == 0:
            found.setdefault(p.doc_id, []).append([])
        assert p.start == len(found[p.doc_id][-1])
        found[p.doc_id][-1] += ids
        assert p.doc_tokens >= p.start + p.length
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    ends = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert sorted(ends) == list(range(len(ends)))
    assert all(n == sequence for s, n in ends.items() if s < len(ends) - 1)


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary()).count() == 0


def test_slices_of_a_batch_and_a_full_memory(tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "KNOWN_WORDS", 20)
    words = packing.WordIds(vocabulary())
    column = pa.array(texts(40))
    for low in range(0, len(column), 7):
        part = column.slice(low, 7)
        ids, offsets = words.encode(part)
        for k, t in enumerate(part.to_pylist()):
            assert ids[offsets[k]:offsets[k + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from repohealth.llm.packing import WordIds

    path = vocabulary()
    t, words = Tokenizer.from_file(path), WordIds(path)
    r = random.Random(4)
    bits = ["<|ENDOFTEXT|>", "<|endoftext|>", "x<|StartOfText|>y", "<|", "|>", "İs", "é", "don't", "12.5", "a.b,c", " ", "\x85", "ǅ", "ß", "١٢", "日本語", " ", "\n", "Word", "the", "ﬁ", "‍", ".", "'LL"]
    texts = [None, "", " "] + ["".join(r.choice(bits) + r.choice(["", " ", "\t"]) for _ in range(r.randrange(1, 30))) for _ in range(400)]
    for by_words in (True, False):
        words.by_words = words.by_words and by_words
        ids, offsets = words.encode(pa.array(texts, pa.string()))
        for k, x in enumerate(texts):
            assert ids[offsets[k]:offsets[k + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids, x
