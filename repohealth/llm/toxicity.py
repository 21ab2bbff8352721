"""Toxicity by compression distance: windows that a dictionary of toxic text compresses better than one of ordinary text.

Two zstandard dictionaries are trained on a bounded sample of labelled documents: one on ordinary text, one on those
parts of toxic text whose short strings ordinary text lacks. Every text is cut into overlapping windows; each window is
compressed against the ordinary dictionary alone and against the toxic dictionary in front of it. As both have the
ordinary part, the lengths of an ordinary window are nearly the same, and what is saved comes from toxic material.
Thresholds of the saving are calibrated on the sample's ordinary windows, and a logistic fit turns the shares of windows
above them into a score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repohealth.llm.common import crc_mod, mix, per_row, row_of, ship, slices, text_buffer

SAMPLE = {1: 2000, 0: 3000}  # labelled documents of each class that the fit reads, by least hash of the id
SAMPLE_BYTES = 100_000  # longer texts are not taken into the sample (they are scored whole like all others)
WINDOW, STRIDE = 32, 16
GRAM = 5  # bytes of the short strings
MIN_SHARE, MIN_RATIO = 0.02, 8  # of toxic documents that have a string; times its share in ordinary documents
TOXIC_BYTES, ORDINARY_BYTES = 4096, 8192
BUCKETS = 22  # bits of the table that counts strings
FALSE_RATES = (0.03, 0.01, 0.003, 0.001)  # of ordinary windows above each threshold, at most
TOXIC_WEIGHT = 2.0
CUT = 0.7


def _bucket(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and place of every string of GRAM bytes inside a row."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    value = np.zeros(n, np.uint64)
    for k in range(GRAM):
        value = value << np.uint64(8) | raw[k:k + n]
    row = row_of(offsets)
    at = np.flatnonzero(row[:n] == row[GRAM - 1:])
    return (mix(value[at]) >> np.uint64(64 - BUCKETS)).astype(np.int64), at


def _document_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """In how many rows each bucket occurs."""
    bucket, at = _bucket(raw, offsets)
    keys = np.unique(row_of(offsets)[at] << BUCKETS | bucket)
    return np.bincount(keys & (1 << BUCKETS) - 1, minlength=1 << BUCKETS)


def _toxic_parts(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> list[bytes]:
    """For each row the stretches that wanted strings cover, a line each; rows without them are left out."""
    bucket, at = _bucket(raw, offsets)
    covered = np.zeros(len(raw) + 1, np.int64)
    starts = at[wanted[bucket]]
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + GRAM, -1)
    inside = np.cumsum(covered[:-1]) > 0
    edge = inside.copy()
    edge[1:] &= ~inside[:-1] | (row_of(offsets)[1:] != row_of(offsets)[:-1])
    first = np.flatnonzero(edge)
    stop = np.append(inside[1:] & ~edge[1:], False) if len(raw) else inside
    last = np.flatnonzero(inside & ~stop) + 1
    data, row = raw.tobytes(), row_of(offsets)
    parts: dict[int, list[bytes]] = {}
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        parts.setdefault(int(row[a]), []).append(data[a:b])
    return [b"\n".join(x) for x in parts.values()]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the most frequent lines of the samples."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6, level=3, threads=0).as_bytes()
    except zstandard.ZstdError:
        lines = Counter(x for s in samples for x in s.split(b"\n"))
        ranked = sorted(lines, key=lambda x: (-lines[x], x))
        return b"\n".join(reversed(ranked))[-size:]


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the windows of every row, and the n + 1 offsets of the rows in them; empty rows have none."""
    n = np.diff(offsets)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    places = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(places[-1]) - np.repeat(places[:-1], count)
    start = np.repeat(offsets[:-1], count) + k * STRIDE
    return np.stack([start, np.minimum(WINDOW, np.repeat(offsets[1:], count) - start)], axis=1), places


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    thresholds: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the first one is the constant

    def __post_init__(self):
        self._compressors = None

    def __getstate__(self):
        return {**self.__dict__, "_compressors": None}

    def lengths(self, raw: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compressed lengths of the windows against the ordinary dictionary and against both."""
        import zstandard

        if self._compressors is None:
            parameters = zstandard.ZstdCompressionParameters(
                window_log=16, chain_log=14, hash_log=14, search_log=4, min_match=4, target_length=8, strategy=zstandard.STRATEGY_BTLAZY2,
                write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            self._compressors = []
            for content in (self.ordinary, self.toxic + self.ordinary):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=parameters)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=parameters))
        if not len(segments):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = zstandard.BufferWithSegments(raw.tobytes(), segments.astype("<u8").tobytes())
        out = []
        for c in self._compressors:
            done = c.multi_compress_to_buffer(parts, threads=0)
            out.append(np.fromiter((len(done[k]) for k in range(len(done))), np.int64, len(done)))
        return out[0], out[1]

    def savings(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        segments, places = windows(offsets)
        plain, both = self.lengths(raw, segments)
        return plain - both, places

    def features(self, saved: np.ndarray, places: np.ndarray) -> np.ndarray:
        n = np.diff(places) + 4.0
        over = [per_row(saved >= t, places) for t in self.thresholds]
        some = places[:-1][np.diff(places) > 0]
        top = np.zeros(len(n))
        if len(some):
            top[np.diff(places) > 0] = np.maximum.reduceat(saved, some)
        return np.stack([*(x / np.sqrt(n) for x in over), *(x / n for x in over), per_row(saved, places) / n, np.log(n), top], axis=1)

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = (self.features(*self.savings(raw, offsets)) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """The model of labelled texts; None unless both classes are there."""
    import pyarrow as pa

    labels_ = np.array(labels, int)
    if not 0 < labels_.sum() < len(labels_):
        return None
    columns = [[t for t, x in zip(texts, labels, strict=True) if x == k] for k in (0, 1)]

    def parts(k: int):
        """The texts of a class, half a megabyte at a time."""
        for batch in slices([pa.RecordBatch.from_arrays([pa.array(columns[k], pa.string())], names=["text"])], "text", 1 << 19):
            yield text_buffer(batch.column("text"), lower=True)

    clean, toxic = (sum(_document_counts(*p) for p in parts(k)) for k in (0, 1))
    wanted = (toxic >= max(2, MIN_SHARE * len(columns[1]))) & (toxic / len(columns[1]) > MIN_RATIO * (clean + 1) / len(columns[0]))
    pieces = [raw[a:a + 256].tobytes() for raw, _ in parts(0) for a in range(0, len(raw), 256)]
    step = max(1, len(pieces) // 20_000)  # 5 MB are plenty for a dictionary of 8 KB
    model = Model(_dictionary(pieces[::step], ORDINARY_BYTES), _dictionary([x for p in parts(1) for x in _toxic_parts(*p, wanted)] or [b" "], TOXIC_BYTES), np.zeros(0), np.zeros(0), np.ones(0), np.zeros(0))
    saved = [[model.savings(*p) for p in parts(k)] for k in (0, 1)]
    ordinary = np.concatenate([s for s, _ in saved[0]])
    low = 1
    thresholds = []
    for rate in FALSE_RATES:
        while (ordinary >= low).mean() > rate:
            low += 1
        thresholds.append(low)
        low += 1
    model.thresholds = np.array(thresholds)
    x = np.concatenate([model.features(*s) for k in (0, 1) for s in saved[k]])
    y = np.repeat([0.0, 1.0], [len(columns[0]), len(columns[1])])
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - model.centre) / model.scale]
    weight, w = np.where(y == 1, TOXIC_WEIGHT, 1.0), np.zeros(z.shape[1])
    for _ in range(40):  # Newton steps of the ridge-penalised logistic likelihood
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (y - p)) - w
        w = w + np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(w)), slope)
    model.weights = w
    return model


def sample(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[list[str], list[int]]:
    """Texts and labels of at most SAMPLE documents of each class; ``learn`` tells which rows may be read."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("s_id")).agg(F.max("toxic").alias("toxic"))
    rows = docs.where(learn & F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id", "text")
    ids = known.where(learn_id(F.col("s_id")))
    chosen = None
    for label, n in SAMPLE.items():
        part = ids.where(F.col("toxic") == label).orderBy(F.xxhash64("s_id"), "s_id").limit(n)
        chosen = part if chosen is None else chosen.unionAll(part)
    # at most sum(SAMPLE) ids, so this side may be broadcast
    found = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("s_id")).select("s_id", "text", "toxic").dropDuplicates(["s_id"]).orderBy("s_id").collect()
    return [r.text for r in found], [int(r.toxic) for r in found]


def learn_id(doc_id: Column) -> Column:
    """The contract's rows to learn from; the others are held out."""
    return crc_mod(F.coalesce(doc_id.cast("string"), F.lit("")), 3) != 1


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text), from ``labels`` (doc_id, toxic).

    Whole texts are scored, and nothing but the text enters a score. Null and empty texts have no windows and get the
    score of that. Rows with null or other labels, and labels of absent documents, teach nothing; of contradicting
    labels of one id the toxic one counts. Without labelled rows of both classes every score is 0. Repeated rows are
    scored each for itself, null ids stay null, further columns are not read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    model = fit(*sample(docs, labels, learn_id(F.col("doc_id"))))

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            raw, offsets = text_buffer(batch.column("text"), lower=True)
            value = model.scores(raw, offsets) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(value), pa.array((value >= CUT).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (~learn_id(F.col("doc_id"))).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
