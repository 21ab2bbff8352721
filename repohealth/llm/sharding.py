"""Consistent-hash ring with virtual nodes and bounded loads, as DataFrame operations only.

The ring is divided into a fixed number of cells; a document falls into the cell of the md5 of its key. Virtual nodes of
the shards stand on cells. A cell's documents, in the order of their hash, go to the next shard clockwise; what
overflows a full shard goes on to the next shard that has room. Shards take their own cells' documents first, then those
that come from one shard further, and so on.

With capacities that add up to the number of documents every shard ends exactly full, so counts differ by one at most,
and only the overflow moves away from the plain ring's place.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CELLS = 1 << 14  # fixed, whatever the number of rows; the plan that the driver makes has this many lines and the overflow
REPLICAS = 128

PLAN = T.StructType([
    T.StructField("p_cell", T.LongType()), T.StructField("p_from", T.LongType()), T.StructField("p_to", T.LongType()),
    T.StructField("p_shard", T.IntegerType()), T.StructField("p_slot", T.LongType()),
])


def ring_hash(key: Column) -> Column:
    """First 13 hexadecimal digits of the md5 of the key as text: 52 bits. Null keys count as empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long")


def _cell(h, cells: int):
    return h % cells


def ring(shards: int, cells: int = CELLS, replicas: int = REPLICAS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, in ring order; adding a shard adds nodes and moves none."""
    nodes = [(int(hashlib.md5(f"node {s} {r}".encode()).hexdigest()[:13], 16) % cells, s) for s in range(shards) for r in range(replicas)]
    return sorted(nodes)


def preference(cell: int, nodes: list[tuple[int, int]]) -> list[int]:
    """Shards in the order in which they are met clockwise from a cell."""
    at = bisect.bisect_left(nodes, (cell, -1))
    return list(dict.fromkeys(s for _, s in nodes[at:] + nodes[:at]))


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def placement(counts: dict[int, int], shards: int, cells: int = CELLS, replicas: int = REPLICAS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, first slot): where each cell's documents go.

    ``counts`` has at most ``cells`` entries.
    """
    nodes = ring(shards, cells, replicas)
    room, used = capacities(sum(counts.values()), shards), [0] * shards
    waiting = [(cell, 0, preference(cell, nodes)) for cell in sorted(counts)]
    plan = []
    for hop in range(shards):
        later = []
        for cell, done, order in waiting:
            shard = order[hop]
            take = min(counts[cell] - done, room[shard] - used[shard])
            if take:
                plan.append((cell, done, done + take, shard, used[shard]))
                used[shard] += take
            if done + take < counts[cell]:
                later.append((cell, done + take, order))
        waiting = later
    return plan


def assign(docs: DataFrame, shards: int, cells: int = CELLS, replicas: int = REPLICAS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text).

    Null text has no bytes; null ids share one place on the ring. Repeated ids and rows are placed each for itself, ties
    of the hash go by id, size and crc. Further columns are not read. An empty table gives no rows.

    Two scans: ids only for the counts of the cells, then ids and text. One shuffle of (id, size, crc) by cell; cells are
    even because they come from a hash, and slots come from the plan without a second shuffle.
    """
    spark = docs.sparkSession
    h = ring_hash(F.col("doc_id"))
    counted = docs.select(_cell(h, cells).alias("cell")).groupBy("cell").count().collect()  # at most CELLS rows
    plan = spark.createDataFrame(placement({r["cell"]: r["count"] for r in counted}, shards, cells, replicas), PLAN)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text).cast("long") + F.lit(16)).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), h.alias("h"),
    ).withColumn("cell", _cell(F.col("h"), cells))
    order = Window.partitionBy("cell").orderBy("h", "doc_id", "size", "text_crc32")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    placed = rows.join(plan, (F.col("cell") == F.col("p_cell")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.col("p_shard").alias("shard"), (F.col("p_slot") + F.col("rank") - F.col("p_from")).alias("slot"),
    )
