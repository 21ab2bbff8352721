"""WARC: revisit records for repeated payloads, archives with fresh headers, and their reader.

Of the records with equal payloads the one with the largest page id stays a response; the others become revisit records
without a payload that refer to it. Only headers (digest, id) are grouped to find the originals; the payload is shuffled
once, on its digest, to meet the decision.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repohealth.llm.common import cut, scratch, ship

DATE = "2024-01-01T00:00:00Z"  # of every record unless the caller gives another; a clock would differ between retries
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
READ_SCHEMA = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, declared_digest string, refers_to long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hexadecimal digits are four base32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def resolve_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds record_type and refers_to to rows with page_id, payload_bytes and payload_digest.

    Payloads under ``min_bytes`` are never revisits. Rows that share both page id and payload are responses together if
    that id is the largest. Null ids rank below all others and revisit them; a digest that only null ids have gives
    responses. A digest with a third of all rows is one row a task in the grouping, and the join's large side can be
    split by the planner.
    """
    originals = records.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("o_digest")).agg(
        F.max("page_id").alias("o_page"), F.min("page_id").alias("o_least"), F.count("*").alias("o_rows"), F.count("page_id").alias("o_ids"))
    originals = cut(originals.where("o_rows > 1 AND (o_least < o_page OR o_ids < o_rows)").select("o_digest", "o_page"), "warc-originals")
    joined = records.join(originals, (F.col("payload_digest") == F.col("o_digest")) & (F.col("payload_bytes") >= min_bytes), "left")
    revisit = F.col("o_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("o_page"))
    return joined.withColumns({
        "record_type": F.when(revisit, "revisit").otherwise("response"),
        "refers_to": F.when(revisit, F.col("o_page")).cast("long"),
    }).drop("o_digest", "o_page")


def _record_id(page_id: Column, digest: Column) -> Column:
    """Version 5 style name from page and digest, the same on every attempt of a task."""
    h = F.sha1(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("null")), digest).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def write_archives(records: DataFrame, path: str, date: str = DATE) -> None:
    """Write records (page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) as gzipped WARC files.

    Every record is a header block, a block and two line ends; Spark's text writer puts the line ends, commits whole
    tasks and repeats lost ones. Line ends in a url are percent-encoded. A task writes one file, so that the
    size of a file follows the size of the partitions.
    """
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    url = F.col("url")
    for c in "\r\n":  # the only characters that would end a header line
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    is_response = F.col("record_type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(is_response, F.concat(http, F.coalesce("html", F.lit("")))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(~is_response, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(~is_response, _record_id(F.col("refers_to"), F.col("payload_digest")))),
        line("X-Page-Id", F.col("page_id")),
        line("X-Refers-To-Page", F.col("refers_to")),
        line("Content-Type", F.when(is_response, F.lit("application/http; msgtype=response")).otherwise(F.lit("application/http"))),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    records.select(F.concat(head, block).alias("record")).write.option("lineSep", END).option("compression", "gzip").text(path)


def parse(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive that arrives in pieces; blocks are cut by Content-Length."""
    data = bytearray()

    def fill(until) -> bool:
        while not until():
            piece = next(stream, None)
            if piece is None:
                return False
            data.extend(piece)
        return True

    while fill(lambda: data.find(b"\r\n\r\n") >= 0):
        end = data.find(b"\r\n\r\n")
        first, *lines = bytes(data[:end]).decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:60]!r}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        length = int(headers["Content-Length"])
        if not fill(lambda: len(data) >= end + 4 + length + 4):
            raise ValueError("a record is cut short")
        yield headers, bytes(data[end + 4:end + 4 + length])
        del data[:end + 4 + length + 4]


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of one or more gzip members, in pieces."""
    while data:
        d = zlib.decompressobj(31)
        rest = data
        while rest and not d.eof:
            yield d.decompress(rest, step)
            rest = d.unconsumed_tail
        data = d.unused_data


def _rows(batches, with_payload: bool):
    import pyarrow as pa

    names = ["page_id", "record_type", "url", "payload_bytes", "payload_digest", "declared_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for headers, block in parse(inflate(content.as_py())):
                payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
                digest = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                rows.append((
                    number(headers.get("X-Page-Id")), headers["WARC-Type"], headers.get("WARC-Target-URI"), None if payload is None else len(payload), digest,
                    headers["WARC-Payload-Digest"].removeprefix("sha1:"), number(headers.get("X-Refers-To-Page")), payload if with_payload else None,
                ))
                held += len(block)
                if len(rows) >= 5000 or held >= 1 << 24 and with_payload:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives under ``path``; length and digest are taken from the payload that was read.

    Revisit records have no payload: length, digest and payload are null, ``declared_digest`` is the header's.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(lambda batches: _rows(batches, with_payload), READ_SCHEMA)


def deduplicated(pages: DataFrame, path: str | None = None, min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as deduplicated archives, read them back and resolve the revisits.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to for every row. A null html is an empty
    payload and a null url leaves out its header. Repeated rows give repeated records; further columns are not read. An
    empty table gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    path = path or scratch(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    records = pages.select("page_id", "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))
    write_archives(resolve_revisits(records, min_bytes), path, date)
    found = cut(read_archives(spark, path, with_payload=False).drop("payload", "url"), "warc-read")
    # a revisit takes its length from the response that it names
    originals = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("s_page"), F.col("payload_digest").alias("s_digest")).agg(F.max("payload_bytes").alias("s_bytes"))
    wanted = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("w_page"), F.col("declared_digest").alias("w_digest")).distinct()
    originals = cut(originals.join(wanted, (F.col("s_page") == F.col("w_page")) & (F.col("s_digest") == F.col("w_digest")), "left_semi"), "warc-sources")
    joined = found.join(originals, (F.col("refers_to") == F.col("s_page")) & (F.col("declared_digest") == F.col("s_digest")), "left")
    return joined.select(
        "page_id", F.coalesce("payload_bytes", "s_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "s_digest").alias("payload_digest"), "record_type", "refers_to",
    )
