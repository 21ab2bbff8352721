"""Ranked lexical search for many items at once: what items share is added up once for each document.

Mining. The terms that occur in exactly the same items form one class (a shared term set; the terms of one item alone are
one class too), found by signatures of their item sets. Every item is then a sequence of classes, those of most items
first, and the sequences are laid into a tree of common prefixes. Classes and tree together are the sharing graph: a class
feeds all its tree nodes, a tree node feeds all nodes and items below it.

Evaluation. One pass over the documents keeps, block by block, the occurrences of the items' terms and counts what the
weights need. A second pass takes each block: the partial score of every class is materialised once as a list of (document,
sum), then the tree is walked from its root with one accumulator for each level, and an item's scores are read where its
sequence ends. A task keeps the best documents of every item so far and gives only those on.

Items are taken in slices of a bounded number of terms, so that neither the graph nor the weights grow with their number.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repohealth.llm.common import cut, find, per_row, row_of, ship, signed, slices, text_buffer, word_hashes, words

SLICE = 1 << 20  # terms of the items that are taken at once
TOP = 10

GAP = np.zeros(256, bool)
GAP[:0x80] = True
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

BLOCKS = "n_docs long, docs binary, absent binary, lengths binary, terms binary, places binary, counts binary, df array<long>, used long, total long"


def terms_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of an Arrow string column, and the n + 1 offsets of its rows in them."""
    raw, offsets = text_buffer(column, lower=True)
    starts, ends, of = words(raw, offsets, GAP)
    return word_hashes(raw, starts, ends), of


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of ``items`` (item_id, text); terms are 64-bit hashes."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for rows in slices(batches, "text"):
            found, of = terms_of(rows.column("text"))
            yield pa.RecordBatch.from_arrays([rows.column("item_id").take(pa.array(row_of(of))), pa.array(signed(found))], names=["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term long").distinct()


def mine(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of terms (term, class) and sequences of the items (item_id, classes) for distinct (item_id, term).

    The signature of an item set has 128 bits and the number of items. Classes of many items come first.
    """
    signs = [F.bit_xor(F.xxhash64("item_id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    signed_terms = asked.groupBy("term").agg(F.count(F.lit(1)).alias("n"), *signs)
    keys = ["n", "x1", "x2"]
    classes = signed_terms.join(signed_terms.groupBy(*keys).agg(F.min("term").alias("class")), keys).select("term", "class", "n")
    classes = cut(classes, "ranking-classes")
    firsts = classes.where("term = class").select("term", "class", "n")
    sequences = asked.join(firsts, "term").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("a"), F.col("class").alias("c")))).alias("s"))
    return classes.select("term", "class"), sequences.select("item_id", F.col("s.c").alias("classes"))


class Graph:
    """The sharing graph of a slice of items: sorted terms with their class, and the tree in the order of a walk."""

    def __init__(self, classes, sequences):
        import pyarrow as pa

        term, of = (classes.column(c).to_numpy().astype(np.int64) for c in ("term", "class"))
        order = np.argsort(term.view(np.uint64))
        self.terms = term[order].view(np.uint64)
        names, self.class_of = np.unique(of[order], return_inverse=True)
        self.n_classes = len(names)
        self.items = sequences.column("item_id")
        self.items = self.items.combine_chunks() if isinstance(self.items, pa.ChunkedArray) else self.items
        number = {int(c): k for k, c in enumerate(names)}
        paths = sorted(([number[c] for c in path], k) for k, path in enumerate(sequences.column("classes").to_pylist()))
        # a node for every prefix that differs from the one before, with the items whose sequence ends there
        self.level, self.adds, self.ending = [], [], []
        last: list[int] = []
        for path, item in paths:
            same = 0
            while same < min(len(path), len(last)) and path[same] == last[same]:
                same += 1
            for depth in range(same, len(path)):
                self.level.append(depth)
                self.adds.append(path[depth])
                self.ending.append([])
            if path:
                self.ending[-1].append(item)
            last = path


def _postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Blocks of documents with the occurrences of ``terms``; the last row of a task has its counts instead."""

    def run(batches):
        import pyarrow as pa

        df, used, total = np.zeros(len(terms), np.int64), 0, 0
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        kinds = [pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64()), pa.int64(), pa.int64()]

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names=names)

        for rows in slices(batches, "text"):
            found, of = terms_of(rows.column("text"))
            lengths = np.diff(of)
            used += int((lengths > 0).sum())
            total += len(found)
            at = find(terms, found)
            known = at >= 0
            # sorted by term, then document
            keys, counts = np.unique(at[known] * rows.num_rows + row_of(of)[known], return_counts=True)
            term, place = keys // rows.num_rows, keys % rows.num_rows
            df += np.bincount(term, minlength=len(terms))
            ids = rows.column("doc_id")
            absent = ids.is_null().to_numpy(zero_copy_only=False)
            docs = ids.fill_null(0).to_numpy(zero_copy_only=False)
            yield row(rows.num_rows, docs.astype("<i8").tobytes(), absent.astype(np.uint8).tobytes(), lengths.astype("<i8").tobytes(), term.astype("<i4").tobytes(), place.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), None, None, None)
        yield row(*[None] * 7, df.tolist(), used, total)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def damping(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of every document."""
    if lengths.max(initial=0) > (1 << 62) // (90 * max(n, 1)):
        return np.array([10 + 90 * x * n // total for x in lengths.tolist()], np.int64)
    return 10 + 90 * lengths * n // max(total, 1)


def _scores(blocks: DataFrame, graph: Graph, weight: np.ndarray, n: int, total: int, top: int, kind: str) -> DataFrame:
    """The best documents of every item in every task: item_id, doc_id, score."""
    schema = f"task int, item_id {kind}, doc_id long, score long"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        none = np.empty(0, np.int64)
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                size = row["n_docs"]
                docs, lengths = (np.frombuffer(row[c], "<i8") for c in ("docs", "lengths"))
                absent = np.frombuffer(row["absent"], np.uint8)
                term, place, tf = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("terms", "places", "counts"))
                parts = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * damping(lengths, n, total)[place]))
                # one list of (document, sum) for every class
                key = graph.class_of[term] * size + place
                order = np.argsort(key, kind="stable")
                key = key[order]
                edge = np.flatnonzero(np.diff(key, prepend=-1))
                sums = np.add.reduceat(parts[order], edge) if len(key) else none
                where, begins = key[edge] % size, np.searchsorted(key[edge], np.arange(graph.n_classes + 1) * size)
                levels = [np.zeros(size, np.int64)]
                for level, add, ending in zip(graph.level, graph.adds, graph.ending, strict=True):
                    a, b = begins[add], begins[add + 1]
                    del levels[level + 1:]
                    here = levels[level]
                    if b > a:
                        here = here.copy()
                        here[where[a:b]] += sums[a:b]
                    levels.append(here)
                    for item in ending:
                        score, doc, gone = best.get(item, (none, none, none))
                        hits = np.flatnonzero(here >= (max(1, score[-1]) if len(score) == top else 1))
                        if len(hits) > top:
                            least = np.partition(here[hits], len(hits) - top)[len(hits) - top]
                            hits = hits[here[hits] >= least]
                        if len(hits):
                            score, doc, gone = np.append(score, here[hits]), np.append(doc, docs[hits]), np.append(gone, absent[hits])
                            keep = np.lexsort((doc, gone, -score))[:top]
                            best[item] = score[keep], doc[keep], gone[keep]
        task = TaskContext.get().partitionId()
        for item, (score, doc, gone) in best.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(score), task), pa.int32()), graph.items.take(pa.array([item] * len(score))), pa.array(doc, mask=gone.astype(bool)), pa.array(score)], names=["task", "item_id", "doc_id", "score"])

    return blocks.mapInArrow(run, schema)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, size: int = SLICE) -> DataFrame:
    """The ``top`` documents of ``docs`` (doc_id, text) with the highest score above 0 for each item of ``items`` (item_id, text).

    Returns item_id, rank, doc_id, score; equal scores by ascending doc_id, null ids last. Null and empty texts have no
    terms: such documents score nothing and count nowhere, such items have no rows. Rows of ``docs`` that repeat an id are
    documents of their own; rows of ``items`` that repeat an id are one item with the terms of all. Further columns are not
    read, whatever their names. Empty tables give no rows. Terms are told apart by 64-bit hashes. The longest text is held
    whole by a task; of the items about ``size`` terms are taken at once, more than that only for one item that has them.
    """
    ship(docs.sparkSession)
    kind = items.schema["item_id"].dataType.simpleString()
    asked = cut(item_terms(items), "ranking-items")
    count = max(1, -(-asked.count() // size))
    results = None
    for k in range(count):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k)
        classes, sequences = mine(part)
        graph = Graph(classes.toArrow(), sequences.toArrow())
        blocks = cut(_postings(docs, graph.terms), "ranking-blocks")
        counts = blocks.where("df IS NOT NULL")
        n, total = counts.agg(F.coalesce(F.sum("used"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        seen = counts.select(F.posexplode("df").alias("term", "df")).where("df > 0").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(graph.terms), np.int64)
        df[seen.column("term").to_numpy()] = seen.column("df").to_numpy()
        found = _scores(blocks.where("df IS NULL"), graph, weights(df, n), n, total, top, kind)
        results = found if results is None else results.union(found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # first the best of groups of tasks, then of all, so that no window is as long as there are tasks
    for keys in (["item_id", F.pmod("task", F.lit(256))], ["item_id"]):
        results = results.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return results.select("item_id", "rank", "doc_id", "score")
