"""Hard negatives by a vertical scan: dimensions as columns, read for each anchor in descending order of its magnitudes.

Rows are packed in blocks whose dimensions lie one after another, with the least and greatest value of each. An anchor
adds up its products with a block dimension by dimension, largest own component first. What the unread dimensions can
still add at least and at most bounds every candidate's score, and the bitmap of candidates shrinks: first to those that
may be among the best rows of the anchor's label, then to those that may lie in a positive's window of scores and among
its best there. Once few are left, only their values are gathered, and their exact scores decide.

Anchors are a stated set and meet all blocks; both sides of that join are packed rows, dealt out by block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repohealth.llm.common import cut, ship

ROWS = 4096  # rows of a block, about
STEP = 8  # dimensions between two looks at the bounds
EXACT = 1 << 53  # sums below are exact in doubles

BLOCKS = "block long, piece long, n long, dims long, data binary, ids binary, labels binary, rows binary"
PAIRS = "anchor_row long, anchor_id long, grp long, place long, other_row long, other_id long, score long"
FOUND = "anchor_row long, anchor_id long, positive_rank long, positive_id long, positive_score long, negative_row long, negative_id long, negative_score long"


def usable(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label and the vector as whole numbers floor(scale * x), without rows that lack one of them or a finite component."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _packed(rows: DataFrame, dims: int, size: int) -> DataFrame:
    """Blocks of ``rows`` (vec_id, label, v, block, row), the matrix of each with a dimension in a row; short vectors end in zeros."""

    def block_of(held):
        import pyarrow as pa

        columns = [pa.chunked_array([b.column(c) for b in held]).combine_chunks() for c in ("vec_id", "label", "row", "v")]
        ids, labels, place = (c.to_numpy(zero_copy_only=False).astype("<i8") for c in columns[:3])
        lists, n = columns[3], len(ids)
        lengths = np.diff(np.asarray(lists.offsets))
        matrix = np.zeros((n, dims), "<i8")
        matrix[np.repeat(np.arange(n), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
        small = not matrix.size or np.abs(matrix).max() < 1 << 15
        data = np.ascontiguousarray(matrix.T.astype("<i2") if small else matrix.T)
        return [n, dims, *(x.tobytes() for x in (data, ids, labels, place))]

    def run(batches):
        import pyarrow as pa

        held, count, block, piece = [], 0, None, 0

        def full():
            kinds = [pa.int64()] * 4 + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([block, piece, *block_of(held)], kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            numbers = batch.column("block").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if held and (numbers[a] != block or count >= 2 * size):
                        yield full()
                        held, count, piece = [], 0, piece + 1 if numbers[a] == block else 0
                    block, step = int(numbers[a]), min(b - a, 2 * size - count)
                    held.append(batch.slice(a, step))
                    a, count = a + step, count + step
        if held:
            yield full()

    dealt = rows.repartition(F.col("block")).sortWithinPartitions("block", "vec_id", "row")
    return dealt.mapInArrow(run, BLOCKS)


def opened(row: dict) -> tuple[np.ndarray, ...]:
    """Matrix (a dimension in a row), ids, labels and row numbers of a packed block."""
    n, dims = row["n"], row["dims"]
    kind = "<i2" if len(row["data"]) == 2 * n * dims else "<i8"
    ids, labels, rows = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "rows"))
    return np.frombuffer(row["data"], kind).reshape(dims, n), ids, labels, rows


def _anchors(blocks: DataFrame, every: int) -> DataFrame:
    """The rows of every block whose id is divisible by ``every``, packed in the same way; grp numbers the packs."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                data, ids, labels, rows = opened(row)
                take = np.flatnonzero(ids % every == 0)
                if len(take):
                    values = [row["block"], row["piece"], len(take), row["dims"], np.ascontiguousarray(data[:, take]).tobytes(), ids[take].tobytes(), labels[take].tobytes(), rows[take].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, [pa.int64()] * 4 + [pa.binary()] * 4, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    return blocks.mapInArrow(run, BLOCKS).withColumn("grp", F.monotonically_increasing_id()).drop("block", "piece")


class Block:
    """A block opened for scanning."""

    def __init__(self, row: dict):
        data, self.ids, self.labels, self.rows = opened(row)
        self.data = data.astype(np.float64)
        wide = data.astype(np.int64) if data.dtype.itemsize < 8 else data
        self.whole = wide
        n = data.shape[1]
        self.least, self.most = (wide.min(axis=1), wide.max(axis=1)) if n else (np.zeros(len(data), np.int64),) * 2
        self.size = np.abs(wide).max(axis=1).astype(np.float64) if n else np.zeros(len(data))

    def scan(self, anchor: np.ndarray, alive: np.ndarray, decide) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows left of the bitmap ``alive`` and their exact scores.

        ``decide(lower, upper)`` says, from bounds on the scores of the rows left, which stay. Sums that could leave the
        exact range of doubles are taken as 64-bit integers, without bounds.
        """
        if np.abs(anchor.astype(np.float64)) @ self.size >= EXACT:
            left = np.flatnonzero(alive)
            with np.errstate(over="ignore"):
                return left, (anchor.astype(np.int64)[:, None] * self.whole[:, left]).sum(axis=0)
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order].astype(np.float64)
        ends = np.stack([a * self.least[order], a * self.most[order]])
        # what the dimensions from a place on can still add, at least and at most
        rest = np.concatenate([np.cumsum(np.stack([ends.min(axis=0), ends.max(axis=0)])[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1))], axis=1)
        at, dense = 0, True
        left = np.flatnonzero(alive)
        score = np.zeros(len(alive))
        while at < len(order) and len(left):
            dims = order[at:at + STEP]
            if dense and 4 * len(left) < len(alive):
                score, dense = score[left], False
            if dense:
                for d in dims:
                    if anchor[d]:
                        score += anchor[d] * self.data[d]
            else:
                for d in dims:
                    if anchor[d]:
                        score += anchor[d] * self.data[d][left]
            at += len(dims)
            now = score[left] if dense else score
            keep = decide(now + rest[0, at], now + rest[1, at])
            left = left[keep]
            if not dense:
                score = score[keep]
        return left, (score[left] if dense else score).astype(np.int64)


def best(k: int):
    """Decide for the k highest scores; ties stay."""

    def decide(lower, upper):
        if len(lower) <= k:
            return np.ones(len(lower), bool)
        return upper >= np.partition(lower, len(lower) - k)[len(lower) - k]

    return decide


def in_windows(windows: list[tuple[int, int]], k: int):
    """Decide for the k highest scores inside each window; a row stays while one window may want it."""

    def decide(lower, upper):
        keep = np.zeros(len(lower), bool)
        for low, high in windows:
            sure = lower[(lower >= low) & (upper <= high)]
            bar = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) > k else low
            keep |= (upper >= max(low, bar)) & (lower <= high)
        return keep

    return decide


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score x with low * score <= 100 * x <= high * score."""
    return -(-low * score // 100), high * score // 100


def _cells(anchors: DataFrame, blocks: DataFrame, count: int) -> DataFrame:
    """Every pack of anchors beside every block: the stated anchors against all rows."""
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>")).alias("block"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    return asked.join(blocks.drop("piece"), "block")


def _positives(cells: DataFrame, k: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                data, ids, labels, rows = opened({c[2:]: v for c, v in row.items() if c.startswith("a_")})
                out: list[list] = [[] for _ in range(7)]
                for place in range(len(ids)):
                    left, score = block.scan(data[:, place], (block.labels == labels[place]) & (block.rows != rows[place]), best(k))
                    top = np.lexsort((block.rows[left], block.ids[left], -score))[:k]
                    for c, x in zip(out, ([rows[place]] * len(top), [ids[place]] * len(top), [row["a_grp"]] * len(top), [place] * len(top), block.rows[left[top]], block.ids[left[top]], score[top]), strict=True):
                        c.extend(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[x.split()[0] for x in PAIRS.split(", ")])

    return cells.mapInArrow(run, PAIRS)


def _negatives(cells: DataFrame, k: int, low: int, high: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                data, ids, labels, rows = opened({c[2:]: v for c, v in row.items() if c.startswith("a_")})
                mine: dict[int, list[dict]] = {}
                for p in row["a_positives"]:
                    mine.setdefault(p["place"], []).append(p)
                out: list[list] = [[] for _ in range(8)]
                for place, positives in mine.items():
                    windows = [(a, b) for a, b in (window(p["score"], low, high) for p in positives) if a <= b]
                    if not windows:
                        continue
                    left, score = block.scan(data[:, place], block.labels != labels[place], in_windows(windows, k))
                    order = np.lexsort((block.rows[left], block.ids[left], -score))
                    left, score = left[order], score[order]
                    for p in positives:
                        a, b = window(p["score"], low, high)
                        top = np.flatnonzero((score >= a) & (score <= b))[:k]
                        for c, x in zip(out, (*([v] * len(top) for v in (rows[place], ids[place], p["rank"], p["other_id"], p["score"])), block.rows[left[top]], block.ids[left[top]], score[top]), strict=True):
                            c.extend(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[x.split()[0] for x in FOUND.split(", ")])

    return cells.mapInArrow(run, FOUND)


def _first(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def mine(rows: DataFrame, vector: str = "embedding", scale: int = 256, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, size: int = ROWS) -> DataFrame:
    """Hard negatives of ``rows`` (vec_id, label, ``vector``) for each anchor and each of its positives.

    Anchors are the rows whose vec_id is divisible by ``every``. Positives are the first rows of the same label, negatives
    the first rows of other labels with low * positive <= 100 * negative <= high * positive; scores are inner products of
    floor(scale * x), highest first, ties by smaller vec_id. Rows without id, label or vector, or with a null or
    non-finite component, take no part. Rows that repeat an id are rows of their own, also as anchors and as another
    row's positive. Vectors of different lengths are compared as if the shorter ended in zeros; components beyond 64 bits
    become the nearest such number, and sums beyond 64 bits wrap around. Further columns are not read, whatever their
    names. An empty table gives no rows. A task holds one block and one pack of anchors, so long tables only mean more of
    them; a block is dealt out by a row's place in a written table, so no label, id or copy fills one.
    """
    ship(rows.sparkSession)
    plain = cut(usable(rows, vector, scale), "negatives-rows")
    n, dims = plain.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    count = max(1, -(-n // size))
    dealt = plain.withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)))
    blocks = cut(_packed(dealt, dims, size), "negatives-blocks")
    anchors = cut(_anchors(blocks, every), "negatives-anchors")
    near = _first(_positives(_cells(anchors, blocks, count), positives), ["anchor_row"], [F.col("score").desc(), F.col("other_id"), F.col("other_row")], positives)
    asked = cut(near.groupBy("grp").agg(F.collect_list(F.struct("place", F.col("rank").cast("long").alias("rank"), "other_id", "score")).alias("positives")), "negatives-positives")
    found = _negatives(_cells(anchors.join(asked, "grp"), blocks, count), negatives, low, high)
    top = _first(found, ["anchor_row", "positive_rank"], [F.col("negative_score").desc(), F.col("negative_id"), F.col("negative_row")], negatives)
    return top.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
