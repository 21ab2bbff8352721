"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection of sorted arrays.

Every document is the set of the hashes of its shingles. Two sets link when their Jaccard similarity reaches the
threshold. Exactness rests on prefixes: in any one order of all shingles, similar sets share a shingle among the first
n - ceil(t n) + 1 of each. The order used puts frequent shingles last, so that common passages bring few sets together.

1. Heads: the first shingles of every set are counted (one exchange of sorted blocks of hashes, added up in each task).
   Frequent ones and a bitmap of the repeated ones are shared; both have fixed bounds.
2. Tiles: sets that share a prefix shingle meet, ordered by size. The few sets of a rare shingle give the pairs whose
   sizes and places in the order leave room for a link; each pair then meets its two bitmaps once, however many
   shingles it shares. The sets of other shingles bring their bitmaps along, and a task passes on just enough pairs to
   keep what is connected. Bitmaps of about one bit a shingle bound the overlap from above. A shingle with very many
   sets is dealt out as pairs of tiles.
3. Blocks: sets connected in 2 meet with their whole arrays; within a block pairs of fitting sizes that are not connected
   yet are bounded by bitmaps and then intersected exactly. Large blocks are dealt out as pairs of tiles too.

Sets with equal shingles are one from the start, so copies cost nothing beyond the first step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repohealth.llm.common import cut, drop, find, mix, ship, signed, slices, text_buffer, window_hashes, without_ids, word_hashes, words
from repohealth.llm.components import components

WIDTH = 5
PERCENT = 80
FREQUENT = 24  # head shingles with more sets than this go last in the order ...
FREQUENT_BITS = 20  # ... but at most 2 ** 20 of them: with more input the count that makes one frequent grows
BITMAP_BITS = 27
FEW = 8  # head shingles with at most this count give pairs without bitmaps
SLICE = 1 << 20  # bytes of text that a task works on at a time
TILE = 4096


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any similar set."""
    return -(-percent * n // 100)


def shingle_sets(column, width: int = WIDTH):
    """For every text of an Arrow column its sorted distinct shingle hashes, in turn."""
    raw, offsets = text_buffer(column, lower=True)
    starts, ends, firsts = words(raw, offsets)
    value = word_hashes(raw, starts, ends)
    full = window_hashes(value, width)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(full[a:b - width + 1])
        elif b > a:
            yield window_hashes(np.append(value[a:b], np.uint64(b - a)), b - a + 1)  # fewer words: the whole sequence
        else:
            yield np.empty(0, np.uint64)


def set_id(hashes: np.ndarray) -> int:
    """64-bit name of a set; equal sets have equal names."""
    total = mix(hashes).sum(dtype=np.uint64) if len(hashes) else np.uint64(0)
    return int(signed(mix(np.array([total ^ np.uint64(len(hashes) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64)))[0])


def bitmap(hashes: np.ndarray, bits: int) -> int:
    """Bit k is set when a hash falls into part k of ``bits`` equal parts; halving ``bits`` joins neighbours."""
    flags = np.zeros(bits, np.uint8)
    flags[(hashes >> np.uint64(65 - bits.bit_length())).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(flags).tobytes(), "big")


def _width(n: int, per: int = 1) -> int:
    return max(64, 1 << (per * n - 1).bit_length())


def fold(x: int, bits: int, to: int) -> int:
    """The bitmap of ``to`` bits from one of ``bits``."""
    if bits == to:
        return x
    flags = np.unpackbits(np.frombuffer(x.to_bytes(bits // 8, "big"), np.uint8)).reshape(to, -1).any(1)
    return int.from_bytes(np.packbits(flags).tobytes(), "big")


def may_link(a: int, b: int, n: int, m: int, percent: int) -> bool:
    """Whether bitmaps a and b of one width leave room for a link: a bit in one only is an element in one only."""
    both = min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())
    return 100 * both >= percent * (n + m - both)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact: intersection of two sorted arrays."""
    if len(x) > len(y):
        x, y = y, x
    both = np.count_nonzero(find(y, x) >= 0)
    return 100 * both >= percent * (len(x) + len(y) - both)


class Forest:
    """Union-find over numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (p := up.get(top, top)) != top:
            top = p
        while (p := up.get(x, x)) != top:
            up[x] = top
            x = p
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _heads(batches, width, percent, ranges):
    """Blocks of head shingles by range of the hash: distinct hashes of a task and in how many of its sets they are."""
    import pyarrow as pa

    def flush(parts):
        hashes, counts = np.unique(np.concatenate(parts), return_counts=True)
        cuts = np.searchsorted(hashes, [np.uint64((r << 64) // ranges) for r in range(1, ranges)])
        edges = [0, *cuts.tolist(), len(hashes)]
        rows = [(r, hashes[a:b].tobytes(), np.minimum(counts[a:b], 1 << 31).astype("<u4").tobytes()) for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "hashes", "counts"])

    parts, size, seen = [], 0, set()
    for batch in slices(batches, "text", SLICE):
        for s in shingle_sets(batch.column("text"), width):
            name = set_id(s)
            if len(s) and name not in seen:
                seen.add(name)
                parts.append(s[:_head(len(s), percent)])
                size += len(parts[-1])
        if size > 4_000_000:
            yield flush(parts)
            parts, size = [], 0
        if len(seen) > 1_000_000:
            seen.clear()
    if size:
        yield flush(parts)


def _head(n: int, percent: int) -> int:
    """Shingles that are counted: half as many again as the plain prefix has."""
    return min(n, (n - needed(n, percent) + 1) * 3 // 2 + 1)


def _counted(batches):
    """Repeated hashes of a range and their counts; a partition holds whole ranges."""
    import pyarrow as pa

    held: dict[int, list] = {}
    for batch in batches:
        for part, h, c in zip(batch.column("part").to_pylist(), batch.column("hashes"), batch.column("counts"), strict=True):
            held.setdefault(part, []).append((np.frombuffer(h.as_buffer(), np.uint64).copy(), np.frombuffer(c.as_buffer(), "<u4").astype(np.int64)))
    for blocks in held.values():
        hashes, counts = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        total = np.add.reduceat(counts, first)
        again = total > 1
        yield pa.RecordBatch.from_arrays([pa.array(signed(hashes[first][again])), pa.array(total[again])], names=["hash", "n"])


def _prefix_places(s: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Places of the prefix of a set in the order with frequent shingles (those with a ``place``) last."""
    rare = np.flatnonzero(place < 0)[:length]
    return rare if len(rare) == length else np.concatenate([rare, np.flatnonzero(place >= 0)[:length - len(rare)]])


def _late(batches, width, percent, frequent):
    """Prefix shingles that their set has not counted, because frequent ones before them were put last."""
    import pyarrow as pa

    seen = set()
    for batch in slices(batches, "text", SLICE):
        found = []
        for s in shingle_sets(batch.column("text"), width):
            if not len(s) or (name := set_id(s)) in seen:
                continue
            seen.add(name)
            chosen = _prefix_places(s, find(frequent.value, s), len(s) - needed(len(s), percent) + 1)
            found.append(s[chosen[chosen >= _head(len(s), percent)]])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found)))], names=["hash"])
        if len(seen) > 1_000_000:
            seen.clear()


def _prefixes(batches, width, percent, frequent, frequent_n, repeated, many):
    """A row for every prefix shingle that other sets may share; the bitmap comes along where more than a few may."""
    import pyarrow as pa

    seen = set()
    often, often_n = frequent.value, frequent_n.value
    for batch in slices(batches, "text", SLICE):
        cols = [[] for _ in range(5)]
        for s in shingle_sets(batch.column("text"), width):
            n = len(s)
            if not n or (name := set_id(s)) in seen:
                continue
            seen.add(name)
            length, head = n - needed(n, percent) + 1, _head(n, percent)
            place = find(often, s)
            chosen = _prefix_places(s, place, length)
            use = np.flatnonzero((chosen >= head) | in_bitmap(repeated.value, s[chosen]))
            if not len(use):
                continue
            chosen = chosen[use]
            wide = (chosen >= head) | (place[chosen] >= 0) | in_bitmap(many.value, s[chosen])
            b = _width(n)
            data = bitmap(s, b).to_bytes(b // 8, "big") if wide.any() else None
            for h, p, rank, with_bits in zip(s[chosen], place[chosen].tolist(), use.tolist(), wide.tolist(), strict=True):
                tiles = -(-int(often_n[p]) // TILE) if p >= 0 else 1
                own = (name & (1 << 63) - 1) % tiles
                for other in range(tiles):
                    i, j = min(own, other), max(own, other)
                    cols[0].append(int(signed(np.array([h ^ mix(np.array([i << 32 | j], np.uint64))[0]], np.uint64))[0]) if tiles > 1 else int(signed(np.array([h], np.uint64))[0]))
                    cols[1].append(name)
                    cols[2].append(n)
                    cols[3].append(rank)
                    cols[4].append(data if with_bits else None)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["token", "id", "n", "rank", "bits"])
        if len(seen) > 1_000_000:
            seen.clear()


def _runs(batches, key: str):
    """Rows of each value of ``key`` as lists of tuples, from batches sorted by it."""
    held, at = [], None
    for batch in batches:
        names = [n for n in batch.schema.names if n != key]
        for k, *row in zip(batch.column(key).to_pylist(), *(batch.column(n).to_pylist() for n in names), strict=True):
            if k != at:
                if len(held) > 1:
                    yield held
                held, at = [], k
            held.append(row)
    if len(held) > 1:
        yield held


PAIRS = "a long, b long, n long, m long, passed boolean"


def _tiles(batches, percent):
    """Pairs of sets that may link: passed ones connect what the task has not connected, others still want bitmaps."""
    import pyarrow as pa

    def flush():
        rows = [(*p, True) for p in out] + [(*p, False) for p in asked]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.bool_())], names=["a", "b", "n", "m", "passed"])

    forest, out, asked = Forest(), [], set()
    for run in _runs(batches, "token"):
        sets = []
        for name, n, rank, data in run:  # sorted by n and name
            if not sets or sets[-1][0] != name:
                sets.append((name, n, rank, None if data is None else 8 * len(data), None if data is None else int.from_bytes(data, "big")))
        for i, (x, n, r, bits, a) in enumerate(sets):
            for y, m, q, wide, b in sets[i + 1:]:
                if percent * m > 100 * n:
                    break
                if forest.root(x) == forest.root(y):
                    continue
                if bits and wide:
                    if may_link(a, fold(b, wide, bits), n, m, percent) and forest.join(x, y):
                        out.append((x, y, n, m))
                else:
                    both = min(n - r, m - q)  # this shingle and all after it, if it is the first in common
                    if 100 * both >= percent * (n + m - both):
                        asked.add((x, y, n, m))
        if len(out) + len(asked) > 200_000:
            yield flush()
            out, asked = [], set()
    yield flush()


def _batch(rows):
    """(id, n, data) rows as an Arrow batch."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["id", "n", "data"])


def _bitmaps(batches, width, wanted):
    """Bitmaps of the sets whose names are in a bitmap."""
    rows = []
    for name, s in _chosen(batches, width, wanted):
        b = _width(len(s))
        rows.append((name, len(s), bitmap(s, b).to_bytes(b // 8, "big")))
        if len(rows) >= 2000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _passing(batches, percent):
    """Pairs whose two bitmaps leave room for a link."""
    import pyarrow as pa

    for batch in batches:
        keep = []
        for n, m, a, b in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "bits", "other")), strict=True):
            keep.append(may_link(int.from_bytes(a, "big"), fold(int.from_bytes(b, "big"), 8 * len(b), 8 * len(a)), n, m, percent))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _chosen(batches, width, wanted):
    """(name, shingles) of the sets whose names are in a bitmap, each once a task."""
    seen = set()
    for batch in slices(batches, "text", SLICE):
        for s in shingle_sets(batch.column("text"), width):
            if len(s) and (name := set_id(s)) not in seen and in_bitmap(wanted.value, np.array([name & (1 << 64) - 1], np.uint64))[0]:
                seen.add(name)
                yield name, s
        if len(seen) > 1_000_000:
            seen.clear()


def _arrays(batches, width, wanted):
    """Whole arrays of the sets whose names are in a bitmap."""
    rows = []
    for name, s in _chosen(batches, width, wanted):
        rows.append((name, len(s), s.tobytes()))
        if len(rows) >= 500:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _blocks(batches, percent):
    """Links of a block, as far as they connect; every reported pair was intersected exactly."""
    import pyarrow as pa

    out = []
    for run in _runs(batches, "tile"):
        forest, sets = Forest(), []
        for name, n, data in run:
            if not sets or sets[-1][0] != name:
                s = np.frombuffer(data, np.uint64)
                sets.append((name, n, s, _width(n, 2), bitmap(s, _width(n, 2))))
        for i, (x, n, s, bits, a) in enumerate(sets):
            for y, m, t, wide, b in sets[i + 1:]:
                if percent * m > 100 * n:
                    break
                if forest.root(x) != forest.root(y) and may_link(a, fold(b, wide, bits), n, m, percent) and linked(s, t, percent):
                    forest.join(x, y)
                    out.append((x, y))
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _shared_bitmap(df: DataFrame, hash_column: str) -> np.ndarray:
    """Packed bitmap of 2 ** BITMAP_BITS bits with the leading bits of a column of hashes; its size never grows."""
    part = F.shiftrightunsigned(hash_column, 64 - BITMAP_BITS)
    rows = df.select(part.alias("k")).groupBy(F.shiftright("k", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(k & 63 AS INT)))").alias("bits")).toArrow()
    full = np.zeros(1 << BITMAP_BITS - 6, np.uint64)
    if rows.num_rows:
        full[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return full


def in_bitmap(full: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    k = hashes >> np.uint64(64 - BITMAP_BITS)
    return (full[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63)) & np.uint64(1)).astype(bool)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of its class) for every row of ``docs`` (doc_id, text).

    Words are split at ASCII white space and A-Z are lowered. A text with fewer than ``width`` words is one shingle;
    null and empty texts are the empty set and are linked with nothing, not even with each other. Repeated rows and ids
    belong to the class of their text; a null id takes the least id of its class, or null. Further columns are not read.
    An empty table gives no rows. Shingles and sets are told apart by 64-bit hashes.

    No pair is written for sets that are connected already, so a class with m sets costs about m links.
    """
    spark = docs.sparkSession
    ship(spark)
    context = spark.sparkContext
    texts = docs.select("doc_id", "text")

    def sets(batches):
        import pyarrow as pa

        for batch in slices(batches, "text", SLICE):
            found = [(len(s), set_id(s)) for s in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["doc_id", "n", "id"])

    named = cut(texts.mapInArrow(sets, "doc_id long, n long, id long"), "jaccard-sets")
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    only = docs.select("text")
    heads = only.mapInArrow(lambda b: _heads(b, width, percent, ranges), "part int, hashes binary, counts binary")
    counted = cut(heads.repartition("part").mapInArrow(_counted, "hash long, n long"), "jaccard-heads")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(FREQUENT, total >> FREQUENT_BITS)
    often = sorted((r.hash & (1 << 64) - 1, r.n) for r in counted.where(F.col("n") > least).collect())  # at most 2 ** FREQUENT_BITS rows
    frequent, frequent_n = context.broadcast(np.array([h for h, _ in often], np.uint64)), context.broadcast(np.array([n for _, n in often], np.int64))
    # a shingle counted once may still be shared with a set that chose it without counting it
    late = [cut(only.mapInArrow(lambda b: _late(b, width, percent, frequent), "hash long").distinct(), "jaccard-late")] if often else []
    shared = counted.select("hash")
    for more in late:
        shared = shared.unionAll(more)
    repeated = context.broadcast(_shared_bitmap(shared, "hash"))

    many = context.broadcast(_shared_bitmap(counted.where(F.col("n") > FEW), "hash"))
    rows = only.mapInArrow(lambda b: _prefixes(b, width, percent, frequent, frequent_n, repeated, many), "token long, id long, n long, rank long, bits binary")
    pairs = cut(rows.repartition("token").sortWithinPartitions("token", "n", "id").mapInArrow(lambda b: _tiles(b, percent), PAIRS), "jaccard-pairs")
    asked = cut(pairs.where("NOT passed").select("a", "b", "n", "m").distinct(), "jaccard-asked")
    ends = context.broadcast(_shared_bitmap(asked.select("a").unionAll(asked.select("b")), "a"))
    bits = cut(only.mapInArrow(lambda b: _bitmaps(b, width, ends), "id long, n long, data binary").select("id", F.col("data").alias("bits")).dropDuplicates(["id"]), "jaccard-bitmaps")
    met = asked.join(bits, F.col("a") == F.col("id")).drop("id").join(bits.select(F.col("id").alias("o_id"), F.col("bits").alias("other")), F.col("b") == F.col("o_id"))
    passing = met.select("a", "b", "n", "m", "bits", "other").mapInArrow(lambda b: _passing(b, percent), "a long, b long")
    blocks = cut(components(pairs.where("passed").select("a", "b").unionByName(passing), "jaccard-blocks"), "jaccard-blocks")
    wanted = context.broadcast(_shared_bitmap(blocks, "node"))
    arrays = only.mapInArrow(lambda b: _arrays(b, width, wanted), "id long, n long, data binary")
    sizes = blocks.groupBy(F.col("root").alias("z_root")).agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    dealt = blocks.join(sizes, F.col("root") == F.col("z_root")).withColumn("own", F.pmod("node", "tiles"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tile = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    dealt = cut(dealt.select("node", tile.alias("tile")), "jaccard-tiles")
    met = arrays.join(dealt, F.col("id") == F.col("node")).select("tile", "id", "n", "data")
    links = cut(met.repartition("tile").sortWithinPartitions("tile", "n", "id").mapInArrow(lambda b: _blocks(b, percent), "a long, b long"), "jaccard-links")
    classes = cut(components(links, "jaccard-classes"), "jaccard-classes")
    drop(counted, *late, pairs, asked, bits, blocks, dealt, links)

    # from sets back to documents: the least document of each set, then of each class of sets
    firsts = cut(named.where("n > 0").groupBy(F.col("id").alias("f_id")).agg(F.min("doc_id").alias("f_doc")), "jaccard-firsts")
    of_class = classes.join(firsts, F.col("node") == F.col("f_id")).groupBy(F.col("root").alias("c_root")).agg(F.min("f_doc").alias("c_doc"))
    of_set = classes.join(of_class, F.col("root") == F.col("c_root")).select(F.col("node").alias("g_id"), "c_doc")
    firsts = cut(firsts.join(of_set, F.col("f_id") == F.col("g_id"), "left").select("f_id", F.coalesce("c_doc", "f_doc").alias("first_doc")), "jaccard-class-of-set")
    out = named.join(firsts, (F.col("id") == F.col("f_id")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first_doc")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their class, all columns kept.

    Of rows that repeat an id all stay together; rows with a null id stay. Other columns may have any names.
    """
    return without_ids(docs, lambda: near_duplicates(docs, width, percent).where("doc_id <> component_id").select("doc_id"), "jaccard-copies")
