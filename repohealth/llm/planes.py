"""Token-id files: ids in blocks of a fixed size, each block turned into bit or byte planes, each plane under zstandard.

Documents are tokenized, put in ascending order of doc_id by a range shuffle of their ids (not of their texts), and every
partition of that order writes its ids as a sequence of segment files. A file is complete in itself:

    chunks          the planes of one block after another, each compressed for itself
    documents       compressed arrays: is the id null (uint8), id (int64), number of tokens (int64)
    chunk index     for each block: place in the file (uint64), number of ids (uint32), bytes of each plane (uint32)
    footer          FOOTER: where the parts begin, and the file's place in the order (part, segment, ids of the part before)

so one block can be read by its index entry alone, and the files of a folder give the whole stream again. Spark's own
writer stores the files, wherever the folder is; it ends each with a line feed that belongs to no part.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from repohealth.llm.common import cut, scratch, ship
from repohealth.llm.packing import tokenized

BLOCK = 1 << 16  # ids of a block
SEGMENT = 1 << 24  # ids after which a file is full; a document stays whole
END_ID = 1
LEVEL = 3
MAGIC = b"IDPLANES"
# version, bytes of an id, 1 for bit planes, ids of a block, part, segment, ids of the part before this file,
# ids, documents, chunks, place of the documents, place of the chunk index
FOOTER = struct.Struct("<8sHBBIqqqqqqqq")

FILES = "part long, segment long, before long, n_ids long, n_docs long, bytes long"
DOCUMENTS = "part long, start long, doc_id long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of a block of unsigned ids: plane k holds bit k (or byte k) of every id."""
    raw = ids.view(np.uint8).reshape(len(ids), ids.itemsize)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(ids.itemsize)]
    wide = np.unpackbits(raw, axis=1, bitorder="little")
    return [x.tobytes() for x in np.packbits(np.ascontiguousarray(wide.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    """The ids again."""
    if not bits:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        wide = np.unpackbits(np.stack([np.frombuffer(p, np.uint8) for p in planes]), axis=1, count=n, bitorder="little")
        raw = np.packbits(np.ascontiguousarray(wide.T), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(f"<u{width}").reshape(n)


def segment_file(ids: np.ndarray, docs: list[int | None], lengths: np.ndarray, part: int, segment: int, before: int, block: int, bits: bool) -> bytes:
    """The bytes of one file."""
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL)
    out, index, at = [], [], 0
    for k in range(0, len(ids), block):
        chunk = ids[k:k + block]
        planes = [press.compress(p) for p in to_planes(chunk, bits)]
        index.append(struct.pack(f"<QI{len(planes)}I", at, len(chunk), *map(len, planes)))
        out += planes
        at += sum(map(len, planes))
    null = np.fromiter((d is None for d in docs), np.uint8, len(docs))
    number = np.fromiter((d or 0 for d in docs), "<i8", len(docs))
    table = press.compress(null.tobytes() + number.tobytes() + lengths.astype("<i8").tobytes())
    foot = FOOTER.pack(MAGIC, 1, ids.itemsize, bits, block, part, segment, before, len(ids), len(docs), len(index), at, at + len(table))
    return b"".join([*out, table, *index, foot])


def footer(data) -> tuple:
    """The footer's fields of a file as Spark wrote it, the magic word left out."""
    size = FOOTER.size
    magic, *fields = FOOTER.unpack(bytes(data[-1 - size:-1]))
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    return tuple(fields)


def read_block(data, k: int) -> np.ndarray:
    """Block ``k`` of a file, by its entry in the chunk index."""
    import zstandard

    _, width, bits, _, _, _, _, _, _, _, _, index = footer(data)
    planes = width * 8 if bits else width
    entry = struct.Struct(f"<QI{planes}I")
    at, n, *sizes = entry.unpack(bytes(data[index + k * entry.size:index + (k + 1) * entry.size]))
    opened, parts = zstandard.ZstdDecompressor(), []
    for size in sizes:
        parts.append(opened.decompress(bytes(data[at:at + size])))
        at += size
    return from_planes(parts, n, width, bool(bits))


def read_file(data) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, and for each document whether its id is null, the id, and its number of tokens."""
    import zstandard

    _, width, _, _, _, _, _, _, n_docs, chunks, table, index = footer(data)
    blocks = [read_block(data, k) for k in range(chunks)]
    ids = np.concatenate(blocks) if blocks else np.empty(0, f"<u{width}")
    raw = zstandard.ZstdDecompressor().decompress(bytes(data[table:index]))
    return ids, np.frombuffer(raw, np.uint8, n_docs), np.frombuffer(raw, "<i8", n_docs, n_docs), np.frombuffer(raw, "<i8", n_docs, 9 * n_docs)


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, block: int = BLOCK, segment: int = SEGMENT, bits: bool = False) -> None:
    """Write the ids of ``docs`` (doc_id, text) to token-id files in the folder ``path``, in ascending order of doc_id.

    ``vocabulary`` is the path of a tokenizer file that every executor has. Null and empty texts are the end id alone.
    Null ids come first; rows that repeat an id stay rows of their own, ordered by a hash of their ids, so equal rows may
    stand in any order. Further columns are not read, whatever their names. An empty table writes no file with ids. A very
    long text is held whole, as its tokens, by the task that writes it; otherwise a task holds ``segment`` ids.
    """
    ship(docs.sparkSession)
    ids = cut(tokenized(docs, vocabulary, end_id).select("doc_id", "n", "ids"), "planes-ids")
    # the row's place in the written table makes the order total, so that no id or copy fills a range alone
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("row").asc()]
    placed = ids.select("*", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("row"))

    def run(batches):
        import pyarrow as pa

        part, number, before = TaskContext.get().partitionId(), 0, 0
        held, names, lengths, size = [], [], [], 0

        def full():
            data = segment_file(np.concatenate(held), names, np.array(lengths, np.int64), part, number, before, block, bits)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["file"])

        for batch in batches:
            for doc, n, raw in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids"), strict=True):
                raw = raw.as_buffer()
                held.append(np.frombuffer(raw, f"<u{raw.size // n}").copy())
                names.append(doc)
                lengths.append(n)
                size += n
                if size >= segment:
                    yield full()
                    held, names, lengths, number, before, size = [], [], [], number + 1, before + size, 0
        if names:
            yield full()

    files = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n", "ids").mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")


def describe(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file of the folder: its place in the order, and its sizes."""
    ship(spark)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(f[4], f[5], f[6], f[7], f[8], len(data.as_buffer())) for data in batch.column("content") for f in [footer(memoryview(data.as_buffer()))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=[x.split()[0] for x in FILES.split(", ")])

    return _files(spark, path).mapInArrow(run, FILES)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the token-id files under ``path``: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary).

    ``start`` counts the ids of all documents before; the checksum is that of the ids as little-endian unsigned 32-bit
    numbers, as ``ids`` has them. The order of the files is in their footers; one number for each part is summed up in
    one task, whatever the number of documents. A folder without files gives no rows.
    """
    ship(spark)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for value in batch.column("content"):
                data = memoryview(value.as_buffer())
                _, _, _, _, part, _, before, *_ = footer(data)
                ids, null, number, n = read_file(data)
                ids = ids.astype("<u4")
                starts = np.concatenate([[0], np.cumsum(n)])
                raw = memoryview(ids.tobytes())
                parts = [raw[4 * a:4 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                out = [pa.array(np.full(len(n), part)), pa.array(before + starts[:-1]), pa.array(number, mask=null.astype(bool)), pa.array(n), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                # files without ids are read in large steps, with ids in small ones
                step = 1000 if with_ids else len(n)
                for k in range(0, len(n), step):
                    more = [pa.array([bytes(p) for p in parts[k:k + step]], pa.binary())] if with_ids else []
                    yield pa.RecordBatch.from_arrays([*(c.slice(k, step) for c in out), *more], names=["part", "start", "doc_id", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    totals = cut(describe(spark, path).groupBy("part").agg(F.sum("n_ids").alias("n")), "planes-parts")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("part", before.alias("base"))
    found = _files(spark, path).mapInArrow(run, DOCUMENTS + ", ids binary" * with_ids)
    return found.join(base, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read their documents back; nulls, copies and ties as ``write`` says."""
    path = scratch(docs.sparkSession, "planes-files")
    write(docs, vocabulary, path, end_id)
    return read(docs.sparkSession, path)
