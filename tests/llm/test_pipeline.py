"""The pipeline on a small folder, stage by stage against plain versions."""

import random
from collections import defaultdict

import pytest
import test_jaccard
import test_suffix

from pyspark.sql import functions as F

import corpus_pipeline as cp
from repohealth.llm import decontam, quality
from repohealth.llm.queries import vocabulary


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghijklm", k=r.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(30)) for i in range(4)]
    passage = text(70)
    rows = [text(r.randint(30, 120)) for _ in range(60)]
    rows += [rows[0], rows[1] + " " + text(3), rows[2]]  # copies and a near copy
    rows += [text(40) + " " + passage + " " + text(40) for _ in range(5)]  # a shared passage
    rows += [text(30) + "\n" + items[k][1] + "\n" + text(10) for k in range(3)]  # leaks
    rows += ["too short", "", None, "spam spam spam spam spam " * 30]  # rejected
    path = tmp_path_factory.mktemp("tables")
    docs = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(rows)] + [(None, text(50), None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == columns and got.schema == docs.schema
        after = {r.doc_id: r for r in got.collect()}
        texts = [(i, r.text) for i, r in rows.items()]
        if name == "quality rules":
            assert set(rows) - set(after) == {r.doc_id for r in quality.judge(docs).collect() if r.base_failed}
            assert len(set(rows) - set(after)) == 4
        elif name == "n-gram Jaccard join":
            assert set(after) - {None} == {i for i, _, c in test_jaccard.brute(texts) if i == c} - {None}
            assert len(rows) - len(after) == 3
        elif name == "suffix-array dedup":
            want = {i: n for i, _, n, _, _ in test_suffix.brute(texts)}
            assert set(after) == set(rows)
            assert {i: len((rows[i].text or "").encode()) - len((r.text or "").encode()) for i, r in after.items()} == want
            assert sum(n > 0 for n in want.values()) == 4 and all(r.n_chars in (None, len(r.text)) for r in after.values())
        else:
            assert set(rows) - set(after) == {r.doc_id for r in decontam.leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
            assert len(rows) - len(after) == 3
        docs, rows = got, after
    tokenizer = tokenizers.Tokenizer.from_file(vocabulary())
    found = defaultdict(bytes)
    for p in sorted(cp.run(spark, folder).collect(), key=lambda p: (p.sequence_id, p.offset)):
        found[p.doc_id] += bytes(p.ids)
    assert {i: len(x) // 4 for i, x in found.items()} == {i: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in rows.items()}


def test_columns_with_inner_names_and_empty_tables(spark, tmp_path):
    """Columns named as the operators' own ones are kept as they are; an empty table passes every stage."""
    import corpus_pipeline

    names = ["f_doc", "F_TID", "r_text", "__n", "__copy", "__text", "__leak", "gone", "_gone", "tid", "doc", "row", "host", "c0"]
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = source.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names])
    expect = source
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        for which in ("expect", "docs"):
            path = str(tmp_path / f"{which}{k}")
            stage(spark, expect if which == "expect" else docs, "/root/testdata/sf0.001").write.parquet(path)
            if which == "expect":
                expect = spark.read.parquet(path)
            else:
                docs = spark.read.parquet(path)
        assert docs.columns == [*source.columns, *names]
        got = {r.doc_id: r for r in docs.collect()}
        assert {d: (r.text, r.n_chars) for d, r in got.items()} == {r.doc_id: (r.text, r.n_chars) for r in expect.collect()}
        assert all(r[n] == f"{n} {d}" for d, r in got.items() for n in names)
    none = source.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "/root/testdata/sf0.001")
        assert out.count() == 0, name


def test_a_prefix_shingle_that_only_one_side_counts():
    """Sets of Jaccard 0.8 whose common prefix shingle lies before the counted ones of one set and behind those of the other."""
    import numpy as np

    from repohealth.llm import jaccard

    own, often, common = (np.sort(np.arange(n, dtype=np.uint64) + np.uint64(base)) for n, base in ((20, 1), (16, 100), (64, 1000)))
    a, b = np.concatenate([own, often, common]), np.concatenate([often, common])
    prefix, late = [], []
    for s in (a, b):
        n = len(s)
        chosen = jaccard._prefix_places(s, np.where(np.isin(s, often), 0, -1), n - jaccard.needed(n, 80) + 1)
        prefix.append(set(s[chosen].tolist()))
        late.append(set(s[chosen[chosen >= jaccard._head(n, 80)]].tolist()))
    shared = prefix[0] & prefix[1]
    assert shared and shared <= late[0] | late[1] | {int(x) for x in a[:jaccard._head(100, 80)] if x in set(b[:jaccard._head(80, 80)].tolist())}


def test_texts_reach_the_workers_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.range(9000).selectExpr("id AS doc_id", "repeat('some text ', 200) AS text", "'x' AS source").coalesce(1)  # 18 MB

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch({"n": [batch.nbytes]})

    try:
        cp.small_batches(spark)
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 2 * (4 << 20)
    finally:
        spark.conf.unset(key)
