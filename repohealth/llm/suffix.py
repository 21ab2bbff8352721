"""Removal of repeated strings by suffix arrays that grow column by column over many documents.

Every window of LENGTH bytes belongs to its anchor: the least hash among its strings of GRAM bytes, the leftmost of
equals. The anchor depends on the window's bytes alone, so equal windows have equal anchors at the same place, and the
suffixes to be sorted fall into independent groups. A window has 76 bytes besides its anchor, so at least SIDE of them
follow the anchor or more than SIDE come before it; the anchor with these bytes is the window's key, which equal windows
share. A window whose key occurs once in all documents is unique; only the neighbourhoods of repeated keys are sorted,
one group for each key.

Inside a task the neighbourhoods of a key are aligned on their anchor and the order of their suffixes is built from the right:
each round inserts one symbol for every neighbourhood, a stable sort by that symbol turns the last order into the next
(the symbols in the last order are this round's column of the collection's Burrows-Wheeler transform), and the common
prefix lengths of neighbours follow from range minima of the last ones. Neighbours with a common prefix of LENGTH are
equal windows; all but the first in document order are removed. The rounds are as many as a neighbourhood is long,
whatever the length and number of documents; the external files of the method are the sorted partitions of the exchange,
read once from front to back.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repohealth.llm.common import _BYTE, cut, drop, fresh, mix, row_of, ship, signed, slices, text_buffer
from repohealth.llm.jaccard import _shared_bitmap, in_bitmap

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1  # anchors that a window can choose from
SIDE = (LENGTH - GRAM) // 2  # bytes beside an anchor that enter a key
COLUMNS = SPAN - 1 + LENGTH
HOT = 20_000  # occurrences of a key above which its windows are dealt out one by one
CHUNK = 16_384
SLICE = 1 << 18  # bytes of text that a task works on at a time; their hashes stay in the processor's cache


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of every string of GRAM = 24 bytes, by doubling."""
    h = _BYTE[raw]
    lengths = {1: h}
    for k in (1, 2, 4, 8):
        x = lengths[k]
        lengths[2 * k] = mix(x[:-k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + x[k:]) if len(x) > k else x[:0]
    a, b = lengths[16], lengths[8]
    n = max(0, len(raw) - GRAM + 1)
    return mix(a[:n] * np.uint64(0xD6E8FEB86659FD93) + b[16:16 + n])


def anchors(raw: np.ndarray, offsets: np.ndarray, grams: np.ndarray | None = None):
    """(row, hash, place, first start, last start) of the anchors of all rows; places are in the buffer."""
    n = len(raw) - LENGTH + 1
    if n <= 0:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    grams = gram_hashes(raw) if grams is None else grams
    row = row_of(offsets)
    place = (np.arange(len(raw)) - offsets[:-1][row]).astype(np.uint64)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | place[:len(grams)]
    blocks = -(-len(key) // SPAN) * SPAN
    padded = np.full(blocks, ~np.uint64(0))
    padded[:len(key)] = key
    table = padded.reshape(-1, SPAN)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(row[:n] == row[LENGTH - 1:])
    least = np.minimum(after[starts], before[starts + SPAN - 1])
    at = offsets[:-1][row[starts]] + (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    at = at[first]
    return row[at], grams[at], at, starts[first], starts[last]


def keyed(raw: np.ndarray, offsets: np.ndarray):
    """(row, key, place of the anchor, first start, last start) of all runs of windows with one key, by first start.

    Windows with more than SIDE bytes before the anchor have the key of SIDE bytes and the anchor, the others that of the
    anchor and the SIDE bytes after it.
    """
    grams = gram_hashes(raw)
    row, _, at, first, last = anchors(raw, offsets, grams)
    if not len(at):
        return row, np.empty(0, np.uint64), at, first, last
    left, right = np.flatnonzero(at - first > SIDE), np.flatnonzero(at - last <= SIDE)

    def key(where, a, b, salt):
        p = at[where]
        x = mix(grams[p] * np.uint64(0x9E3779B97F4A7C15) + grams[p + a])
        return mix(x * np.uint64(0xD6E8FEB86659FD93) + grams[p + b] + np.uint64(salt))

    # two strings of GRAM bytes cover the SIDE bytes
    keys = np.concatenate([key(left, -SIDE, -GRAM, 1), key(right, GRAM, SIDE, 2)])
    of = np.concatenate([left, right])
    begin = np.concatenate([first[left], np.maximum(first[right], at[right] - SIDE)])
    stop = np.concatenate([np.minimum(last[left], at[left] - SIDE - 1), last[right]])
    order = np.argsort(begin, kind="stable")
    of, keys, begin, stop = of[order], keys[order], begin[order], stop[order]
    return row[of], keys, at[of], begin, stop


def _counts(batches, ranges: int):
    """Keys of a task by range, with up to two different occurrences and their number."""
    import pyarrow as pa

    def flush(parts):
        hashes, keys = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(hashes, kind="stable")
        hashes, keys = hashes[order], keys[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        low, high, n = np.minimum.reduceat(keys, first), np.maximum.reduceat(keys, first), np.diff(np.append(first, len(hashes)))
        hashes = hashes[first]
        edges = [0, *np.searchsorted(hashes, [np.uint64((r << 64) // ranges) for r in range(1, ranges)]).tolist(), len(hashes)]
        rows = []
        for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            two = low[a:b] != high[a:b]
            rows.append((r, np.concatenate([hashes[a:b], hashes[a:b][two]]).tobytes(), np.concatenate([low[a:b], high[a:b][two]]).tobytes(), np.concatenate([n[a:b], np.zeros(two.sum(), np.int64)]).astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["part", "hashes", "keys", "counts"])

    parts, size, seen = [], 0, set()
    for batch in slices(batches, "text", SLICE):
        ids = batch.column("tid").to_pylist()
        fresh = [k for k, t in enumerate(ids) if not (t in seen or seen.add(t))]
        batch = batch.take(pa.array(fresh, pa.int64())) if len(fresh) < len(ids) else batch
        raw, offsets = text_buffer(batch.column("text"))
        row, hashes, at, _, _ = keyed(raw, offsets)
        tid = batch.column("tid").to_numpy(zero_copy_only=False).view(np.uint64)
        parts.append((hashes, mix(tid[row] ^ mix((at - offsets[row]).astype(np.uint64)))))
        size += len(hashes)
        if size > 4_000_000:
            yield flush(parts)
            parts, size = [], 0
        if len(seen) > 1_000_000:
            seen.clear()
    if size:
        yield flush(parts)


def _repeated(batches):
    """Keys of a range that occur at two places or more, and how often."""
    import pyarrow as pa

    held: dict[int, list] = {}
    for batch in batches:
        for part, *blobs in zip(batch.column("part").to_pylist(), *(batch.column(c) for c in ("hashes", "keys", "counts")), strict=True):
            held.setdefault(part, []).append([np.frombuffer(b.as_buffer(), k).copy() for b, k in zip(blobs, (np.uint64, np.uint64, "<u4"), strict=True)])
    for blocks in held.values():
        hashes, keys, counts = (np.concatenate([b[k] for b in blocks]) for k in range(3))
        if not len(hashes):
            continue
        order = np.argsort(hashes, kind="stable")
        hashes, keys, counts = hashes[order], keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        again = np.minimum.reduceat(keys, first) != np.maximum.reduceat(keys, first)
        yield pa.RecordBatch.from_arrays([pa.array(signed(hashes[first][again])), pa.array(np.add.reduceat(counts, first)[again])], names=["hash", "n"])


STRINGS = "hash long, doc long, tid long, place long, first long, string binary, stop long"


def _strings(batches, repeated, hot):
    """Neighbourhoods of repeated keys; one that an earlier document of the task has wholly is an interval already.

    A row with a string is to be sorted; a row without one says that bytes first to stop are repeated in the document doc.
    It holds for the text only if doc is the first document with that text: copies in other tasks may come earlier.
    """
    import pyarrow as pa

    names = [x.split()[0] for x in STRINGS.split(", ")]
    best: dict[int, int] = {}
    known: dict[tuple[int, bytes], tuple[int, int]] = {}
    for batch in slices(batches, "text", SLICE):
        docs, ids = batch.column("doc").to_pylist(), batch.column("tid").to_pylist()
        raw, offsets = text_buffer(batch.column("text"))
        data = raw.tobytes()
        row, hashes, at, lo, hi = keyed(raw, offsets)
        use = np.flatnonzero(in_bitmap(repeated.value, hashes))
        single = in_bitmap(hot.value, hashes[use]) if hot is not None else np.zeros(len(use), bool)
        fresh = []
        for d, t in zip(docs, ids, strict=True):  # of copies the first that a task sees, and any that comes before it
            ok = t not in best or d < best[t]
            if ok:
                best[t] = d
            fresh.append(ok)
        out = [[] for _ in names]
        last: list[int] = []  # row, text, begin and stop of the interval that may still grow

        def close():
            if last:
                for c, v in zip(out, (None, docs[last[0]], last[1], None, last[2], None, last[3]), strict=True):
                    c.append(v)

        columns = [x[use].tolist() for x in (row, signed(hashes), at, lo, hi)]
        for r, h, p, a, b, each in zip(*columns, single.tolist(), strict=True):
            if not fresh[r]:
                continue
            base, doc = int(offsets[r]), docs[r]
            pieces = [(s, s) for s in range(a, b + 1)] if each else [(a, b)]
            for s, e in pieces:
                string = data[s:e + LENGTH]
                key = h
                if each:
                    key = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)
                name = (key, hashlib.blake2b(string, digest_size=12).digest())
                mine, first = (doc, s - base), known.get(name)
                if first is not None and first < mine:
                    if last and last[0] == r and s - base <= last[3]:
                        last[3] = e + LENGTH - base
                    else:
                        close()
                        last[:] = r, ids[r], s - base, e + LENGTH - base
                else:
                    known[name] = mine
                    for c, v in zip(out, (key, doc, ids[r], p - base, s - base, string, None), strict=True):
                        c.append(v)
        close()
        if out[0]:
            kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
        if len(known) > 150_000:
            known.clear()
        if len(best) > 1_000_000:
            best.clear()


def repeated_windows(strings: list[bytes], anchor: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For every string and column whether the window that starts there also starts at a string of lower rank.

    anchor: place of the anchor in each string. Column SPAN - 1 is that of the anchors. One column is inserted a round.
    """
    m = len(strings)
    size = np.array([len(s) for s in strings])
    begin = SPAN - 1 - anchor
    end = begin + size
    symbols = np.zeros((COLUMNS, m), np.uint8)
    owner = np.repeat(np.arange(m), size)
    column = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[owner]
    symbols[column, owner] = np.frombuffer(b"".join(strings), np.uint8)

    out = np.zeros((SPAN, m), bool)
    order, common = np.arange(m), np.zeros(m, np.uint8)
    for c in range(COLUMNS - 1, -1, -1):
        transform = symbols[c, order]
        there = ((begin <= c) & (c < end))[order]
        by = np.argsort(transform, kind="stable")
        a, b = by[:-1], by[1:]
        alike = np.flatnonzero((transform[a] == transform[b]) & there[a] & there[b])
        longer = np.zeros(m, np.uint8)
        if len(alike):
            # least common prefix between the two in the last order, from minima over powers of two
            low, high = a[alike] + 1, b[alike]
            level = np.frexp((high - low + 1).astype(float))[1] - 1
            minima = [common]
            for k in range(int(level.max())):
                x = minima[-1]
                minima.append(np.minimum(x[:-(1 << k)], x[1 << k:]) if len(x) > 1 << k else x)
            least = np.empty(len(alike), np.uint8)
            for k, x in enumerate(minima):
                of = np.flatnonzero(level == k)
                least[of] = np.minimum(x[low[of]], x[high[of] - (1 << k) + 1])
            longer[alike + 1] = np.minimum(least, LENGTH - 1) + 1
        order, common = order[by], longer
        if c < SPAN and (common >= LENGTH).any():
            group = np.flatnonzero(common < LENGTH)
            first = np.minimum.reduceat(rank[order], group)
            of = np.cumsum(common < LENGTH) - 1
            out[c, order] = rank[order] > first[of]
    return out


def _intervals(batches):
    """Repeated intervals of the neighbourhoods, whose rows come sorted by hash."""
    import pyarrow as pa

    def solve(rows):
        docs, places, firsts = (np.array([r[k] for r in rows]) for k in (0, 2, 3))
        order = np.lexsort((firsts, docs))
        keep = np.empty(len(rows), np.int64)
        keep[order] = np.arange(len(rows))
        # copies that several tasks sent are one: equal text, equal start, so equal rank
        same = {}
        for k in order.tolist():
            keep[k] = same.setdefault((rows[k][1], rows[k][3]), keep[k])
        found = repeated_windows([r[4] for r in rows], places - firsts, keep)
        edge = np.diff(np.pad(found.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        who, start = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        begin = places[who] + start - (SPAN - 1)
        ids = np.array([r[1] for r in rows])[who]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begin, pa.int64()), pa.array(begin + stop - start + LENGTH - 1, pa.int64())], names=["tid", "begin", "stop"])

    held, size, run, at = [], 0, [], None
    for batch in batches:
        for h, *row in zip(*(batch.column(c).to_pylist() for c in ("hash", "doc", "tid", "place", "first", "string")), strict=True):
            if h != at:
                if len(run) > 1:
                    held += run
                if len(held) >= CHUNK:
                    yield solve(held)
                    held = []
                run, at = [], h
            run.append(row)
    if len(run) > 1:
        held += run
    if held:
        yield solve(held)


def repeats(docs: DataFrame) -> DataFrame:
    """tid, begin, stop, judged: repeated intervals of the distinct texts of ``docs``, which may overlap.

    Only the first document of equal texts counts here; its copies are removed whole. An interval with a value in
    ``judged`` was found for that document and counts only if it is the first of its text. ``docs``: doc, tid, text.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = docs.select("tid", "text").mapInArrow(lambda b: _counts(b, ranges), "part int, hashes binary, keys binary, counts binary")
    repeated = cut(counts.repartition("part").mapInArrow(_repeated, "hash long, n long"), "suffix-keys")
    shared = spark.sparkContext.broadcast(_shared_bitmap(repeated, "hash"))
    # a bitmap treats equal windows alike, so keys that it takes for hot by chance are dealt out rightly too
    many = repeated.where(F.col("n") > HOT)
    often = None if many.isEmpty() else spark.sparkContext.broadcast(_shared_bitmap(many, "hash"))
    strings = cut(docs.select("doc", "tid", "text").mapInArrow(lambda b: _strings(b, shared, often), STRINGS), "suffix-strings")
    to_sort = strings.where("string IS NOT NULL").select("hash", "doc", "tid", "place", "first", "string")
    sorted_ = to_sort.repartition("hash").sortWithinPartitions("hash").mapInArrow(_intervals, "tid long, begin long, stop long")
    found = sorted_.withColumn("judged", F.lit(None).cast("long")).unionByName(strings.where("string IS NULL").select("tid", F.col("first").alias("begin"), "stop", F.col("doc").alias("judged")))
    found = cut(found, "suffix-intervals")
    drop(repeated, strings)
    return found


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(batches):
    """The result of each distinct text with repeats."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for tid, text, spans, first in zip(batch.column("tid").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), batch.column("f_doc").to_pylist(), strict=True):
            # first is null where the text has one document only
            holds = [(s["begin"], s["stop"]) for s in spans if first is None or s["judged"] is None or s["judged"] == first]
            data, at, kept, merged = text.as_buffer().to_pybytes(), 0, [], _union(holds)
            for a, b in merged:
                kept.append(data[at:a])
                at = b
            left = b"".join([*kept, data[at:]])
            rows.append((tid, len(data) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["r_tid", "r_removed", "r_spans", "r_sha", "r_text"])


def _texts(batches, wanted):
    """Texts whose id is in a bitmap, each once a task."""
    import pyarrow as pa

    seen: set[int] = set()
    for batch in batches:
        ids = batch.column("tid").to_pylist()
        found = in_bitmap(wanted.value, np.array(ids, np.int64).view(np.uint64)).tolist()
        fresh = [k for k, t in enumerate(ids) if found[k] and not (t in seen or seen.add(t))]
        yield batch.take(pa.array(fresh, pa.int64()))
        if len(seen) > 1_000_000:
            seen.clear()


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with five columns more: __bytes, __removed, __spans, __sha256 and __text, the text that is left.

    Texts are their UTF-8 bytes. A byte is removed when a string of LENGTH bytes that covers it also starts earlier: in a
    document with a smaller id, or before in the same one. Null texts are empty; texts shorter than LENGTH lose nothing;
    overlapping strings count. Rows that share id and text are one document and have one result; of rows that share only
    the id, equal strings at equal places remove each other in neither. A null id comes after all others. All columns
    are kept, whatever their names (a new column whose name is taken gets more underscores). ``__text`` leaves out characters that a removed span cuts in two; ``__sha256`` is that of the exact bytes.
    An empty table gives no rows. Texts are told apart by 64-bit hashes, strings by their bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    # the caller's columns go by number, so that none can have a name used here
    own = [f"c{k}" for k in range(len(docs.columns))]
    lower = [c.lower() for c in docs.columns]
    plain = docs.toDF(*own)
    whole, doc_id = (F.col(own[lower.index(c)]) for c in ("text", "doc_id"))
    text = F.coalesce(whole, F.lit(""))
    keyed = plain.withColumns({"__tid": F.xxhash64(text, F.octet_length(text)), "__doc": F.coalesce(doc_id, F.lit((1 << 63) - 1))})
    # taken before the joins, so that the text itself only goes through them where it is asked for
    keyed = keyed.withColumns({"__n": F.octet_length(text).cast("long"), "__own": F.sha2(text, 256)})
    source = keyed.select(F.col("__doc").alias("doc"), F.col("__tid").alias("tid"), whole.alias("text")).where(F.octet_length("text") >= LENGTH)
    firsts = cut(source.groupBy(F.col("tid").alias("f_tid")).agg(F.min("doc").alias("f_doc"), F.max("doc").alias("f_last")).where("f_doc < f_last").select("f_tid", "f_doc"), "suffix-copies")
    found = repeats(source)
    wanted = spark.sparkContext.broadcast(_shared_bitmap(found, "tid"))
    texts = source.select("tid", "text").mapInArrow(lambda b: _texts(b, wanted), "tid long, text string").dropDuplicates(["tid"])
    spans = found.groupBy(F.col("tid").alias("s_tid")).agg(F.collect_list(F.struct("begin", "stop", "judged")).alias("spans"))
    spans = spans.join(firsts, F.col("s_tid") == F.col("f_tid"), "left")
    done = cut(texts.join(spans, F.col("tid") == F.col("s_tid")).select("tid", "text", "spans", "f_doc").mapInArrow(_removed, "r_tid long, r_removed long, r_spans long, r_sha string, r_text string"), "suffix-results")
    drop(found)
    joined = keyed.join(firsts, F.col("__tid") == F.col("f_tid"), "left").join(done, F.col("__tid") == F.col("r_tid"), "left")
    n, copy = F.col("__n"), F.col("f_doc").isNotNull() & (F.col("__doc") > F.col("f_doc"))
    pick = lambda of_copy, of_result, else_: F.when(copy, of_copy).otherwise(F.coalesce(of_result, else_))
    result = {
        "__bytes": n,
        "__removed": pick(n, F.col("r_removed"), F.lit(0).cast("long")),
        "__spans": pick(F.lit(1).cast("long"), F.col("r_spans"), F.lit(0).cast("long")),
        "__sha256": pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("r_sha"), F.col("__own")),
        "__text": F.when(copy, F.lit("")).otherwise(F.coalesce("r_text", text)),
    }
    return joined.select(*[F.col(k).alias(c) for k, c in zip(own, docs.columns, strict=True)], *[v.alias(fresh(docs, c)) for c, v in result.items()])
