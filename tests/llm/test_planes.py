import zlib

import numpy as np
import pytest

from repohealth.llm import planes
from repohealth.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, part string, n string, ids int, h int, row string"


def expected(rows, end_id):
    """(doc_id, n, crc) in the files' order by the tokenizer itself, ties unordered."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    out = []
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, end_id]
        out.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_of_a_block_round_trip(bits, width):
    r = np.random.default_rng(5)
    for n in (1, 7, 8, 9, 1000):
        ids = r.integers(0, 1 << 8 * width, n, dtype=np.uint64).astype(f"<u{width}")
        found = planes.to_planes(ids, bits)
        assert len(found) == width * (8 if bits else 1)
        assert (planes.from_planes(found, n, width, bits) == ids).all()


def test_file_and_its_chunk_index():
    ids = np.arange(1000, dtype="<u2") * 7
    data = planes.segment_file(ids, [3, None, 5], np.array([400, 100, 500]), 2, 1, 77, 256, True) + b"\n"
    assert (planes.read_block(data, 2) == ids[512:768]).all() and (planes.read_block(data, 3) == ids[768:]).all()
    got, null, number, n = planes.read_file(data)
    assert (got == ids).all() and null.tolist() == [0, 1, 0] and number.tolist() == [3, 0, 5] and n.tolist() == [400, 100, 500]
    with pytest.raises(ValueError):
        planes.footer(b"x" * 200)


@pytest.mark.parametrize("bits", [False, True])
def test_files_of_odd_documents(spark, tmp_path, bits):
    texts = ["One small step, again.", None, "", "x" * 3000, "ünï Çödé ½ 12.5", "one two three " * 800, "<|ENDOFTEXT|> and <|endoftext|>", "a\x85b c d", "Ǆ İstanbul ﬁn"]
    rows = [(7 * i % 11, t, "p", "n", 1, 2, "r") for i, t in enumerate(texts)] + [(4, "same", "", "", 0, 0, "")] * 3 + [(None, "no id", "", "", 0, 0, ""), (None, None, "", "", 0, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    path = str(tmp_path / "ids")
    planes.write(docs, vocabulary(), path, block=64, segment=500, bits=bits)
    got = planes.read(spark, path, with_ids=True).orderBy("start").collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.ids_crc32) for r in got) == sorted(((d is not None, d or 0), n, c) for d, n, c in expected(rows, 1))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)
    files = planes.describe(spark, path).collect()
    assert sum(f.n_docs for f in files) == len(rows) and max(f.segment for f in files) > 0


def test_no_documents(spark):
    assert planes.round_trip(spark.createDataFrame([], SCHEMA), vocabulary()).count() == 0


def test_query_over_the_table(spark):
    from repohealth.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want, start = {}, 0
    for d, n, c in sorted(expected(rows, 1)):
        want[d] = (start, n, c)
        start += n
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op13_bit_planes"](spark, folder).collect()} == want
