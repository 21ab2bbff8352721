"""Helpers that several operators share: tables, scratch tables in the shared folder, hashing of bytes."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repohealth.session import ensure_checkpoint_dir, ship  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the cluster's checkpoint folder; the file system removes it when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    scratch_paths(spark).append(path)
    return path


def scratch_paths(spark: SparkSession) -> list[str]:
    """All paths that ``scratch`` has given out in this application, oldest first."""
    context = spark.sparkContext
    if not hasattr(context, "_repohealth_scratch"):
        context._repohealth_scratch = []
    return context._repohealth_scratch


def cut(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The files outlive lost executors, hold only the columns that are needed and
    give the planner true sizes.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._scratch = path
    return kept


def cut_shuffled(df: DataFrame, label: str = "table") -> DataFrame:
    """``cut``, after which the shuffled files that led to the table are removed too; ``df`` is not run again."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return cut(df, label)
    finally:
        conf.set(name, before)


def remove(spark: SparkSession, paths) -> None:
    """Delete scratch tables that nothing will read again."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``cut`` that nothing will read again; later rounds need not share the disk."""
    for t in tables:
        remove(t.sparkSession, [t._scratch])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_ids(df: DataFrame, ids, label: str) -> DataFrame:
    """Rows of ``df`` whose doc_id is not among those that ``ids()`` gives in its only column; null ids stay.

    The columns of ``df`` may have any names. What ``ids`` wrote on its way is removed: the result reads one table of ids.
    """
    name, begun = fresh(df, "gone"), len(scratch_paths(df.sparkSession))
    gone = cut(ids().toDF(name).distinct(), label)
    remove(df.sparkSession, scratch_paths(df.sparkSession)[begun:-1])
    return df.join(gone, df["doc_id"] == F.col(name), "left_anti")


def lower_az(c: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` would change other letters too."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


# --- hashing inside tasks -------------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BYTE = np.random.default_rng(20240611).integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 20  # bytes that are hashed at a time: of texts, or of an array of hashes


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.empty(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_ODD ** i modulo 2**64 for i below n, kept for the next call."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 4096) - 1, _ODD, np.uint64))])
    return _POWERS[:n]


def text_buffer(column, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column and the n + 1 offsets of its rows; null is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    data, offsets = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    return raw, (offsets - offsets[0]) if len(column) else np.zeros(1, np.int64)


def words(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes outside ``gap``, ASCII white space if not said otherwise) of all rows of a buffer.

    Returns start and end of every word, and for every row the number of words
    before it (n + 1 numbers). Words never cross rows.
    """
    if not len(raw):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~gap[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: a polynomial over random byte values, then mixed with the length.

    The words follow one another. They are read in pieces of about ``PIECE`` bytes, since a byte takes 40 on the way.
    """
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + PIECE)))
        out[a:b] = _word_hashes(raw[starts[a]:ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a])
        a = b
    return out


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    # position of each byte counted from the start of its word or gap
    edge = np.zeros(len(raw), np.int64)
    edge[starts] = starts
    place = np.arange(len(raw)) - np.maximum.accumulate(edge)
    value = _BYTE[raw] * powers(int(place.max()) + 1)[place]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    return mix((total[ends] - total[starts]) ^ ((ends - starts).astype(np.uint64) * _ODD))


def window_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring items; entry i covers items i to i + width - 1."""
    n = len(items) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, PIECE // 8):
        m = min(PIECE // 8, n - a)
        total = np.zeros(m, np.uint64)
        for k in range(a, a + width):
            total = total * _ODD + items[k:k + m]
        out[a:a + m] = mix(total)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices(batches, column: str, size: int = 4 << 20):
    """Arrow batches cut so that ``column`` has about ``size`` bytes in each, one row at least."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of every item, from the n + 1 offsets of the rows."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the items of every row; rows without items give 0."""
    total = np.cumsum(values)
    total = np.concatenate([np.zeros(1, total.dtype), total])
    return total[offsets[1:]] - total[offsets[:-1]]


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of every key in ``sorted_keys``, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)
