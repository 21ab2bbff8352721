"""Benchmark decontamination: template windows joined by hash, then a check that slots were filled consistently.

Texts become templates: numbers, units and (in a second form) names are typed placeholders. Windows of templates are
joined by hash with those of the benchmark items. A hit pairs the slot values of both windows; over all hits of a document
and an item one item value must stand for one document value and the other way round, else the window does not count.
So a question with other numbers and names is caught, and a chance mixture of matching templates is not.

Windows with few literal tokens, and items of a few tokens, say too little as templates; they are joined by their tokens
as they are, so that a verbatim copy is found whatever an item consists of.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repohealth.llm.common import cut, find, mix, row_of, ship, signed, slices, text_buffer, window_hashes, without_ids, word_hashes

WINDOW = 8  # tokens of a template window
SHORTEST = 5  # items with fewer tokens are found by verbatim copies only; those below WINDOW are one window
LITERALS = 4  # a window with fewer tokens that are not placeholders is found by verbatim copies only
MIN_COVER = 0.5  # share of an item's tokens that a leak covers ...
MIN_TOKENS = 13  # ... or number of its tokens
FILTER_BITS = 22  # of the fixed-size bitmap of item windows that every task gets
SLICE = 1 << 20  # bytes of text that a task works on at a time

NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces "
    "pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day "
    "days week weeks month months year years percent dollar dollars cent cents euro euros mph kmh kph degree degrees meter "
    "meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters watt watts volt volts"
).split()

NUM, UNIT, NAME = (mix(np.array([k], np.uint64))[0] for k in (11, 12, 13))
HITS = "row long, doc_id long, place int, length int, hash long, slots array<long>"


def _fixed(names) -> np.ndarray:
    raw = "".join(names).encode()
    ends = np.cumsum([len(x.encode()) for x in names])
    return np.sort(word_hashes(np.frombuffer(raw, np.uint8), np.concatenate([[0], ends[:-1]]), ends))


_NUMBERS, _UNITS = _fixed(NUMBER_WORDS), _fixed(UNITS)
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\n")] = True


class Template:
    """Tokens of all texts of an Arrow column: their hashes, classes and rows."""

    def __init__(self, column):
        raw, self.offsets = text_buffer(column)
        n = len(raw)
        inside = _ALNUM[raw]
        after, before = np.append(raw[1:], 0), np.concatenate([[0], raw[:-1]]) if n else raw
        # punctuation outside ASCII: U+0080 to U+00BF, and U+2000 to U+203F
        low = np.flatnonzero((raw == 0xC2))
        inside[low] = False
        inside[low[low + 1 < n] + 1] = False
        high = np.flatnonzero((raw == 0xE2) & (after == 0x80))
        for k in range(3):
            inside[high[high + k < n] + k] = False
        digit = _DIGIT[raw]
        inside |= ((raw == 46) | (raw == 44)) & _DIGIT[before] & _DIGIT[after]  # 3.14 and 1,000 are one number
        capital = (raw >= 65) & (raw <= 90)
        latin = (before == 0xC3) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
        lowered = np.where(capital | latin, raw + np.uint8(32), raw).astype(np.uint8)

        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.firsts = np.searchsorted(starts, self.offsets)
        self.row = row_of(self.firsts)
        self.value = word_hashes(lowered, starts, ends)
        digits = np.concatenate([[0], np.cumsum(digit | ~_ALNUM[raw])])
        number = (digits[ends] - digits[starts] == ends - starts) | (find(_NUMBERS, self.value) >= 0)
        unit = find(_UNITS, self.value) >= 0
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        previous = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        begins = np.zeros(len(starts), bool)
        begins[self.firsts[:-1][np.diff(self.firsts) > 0]] = True
        begins |= stops[starts] > stops[previous]
        upper = (capital | np.append(latin[1:], False))[starts] if n else np.zeros(0, bool)
        name = upper & ~begins & ~number & ~unit
        self.plain = np.where(number, NUM, np.where(unit, UNIT, self.value))
        self.named = np.where(name, NAME, self.plain)
        self.slot_plain, self.slot_named = number | unit, number | unit | name

    def windows(self, width: int):
        """(hashes, places of the first token, slots) of the windows of both forms; equal forms are given once.

        Where neither form says enough the tokens themselves are the window, without slots.
        """
        n = len(self.value) - width + 1
        if n <= 0:
            return
        filled = np.concatenate([[0], np.cumsum(self.slot_plain)])
        exact = self.row[:n] == self.row[width - 1:]
        if width >= SHORTEST:
            exact &= width - (filled[width:] - filled[:-width]) < LITERALS
        at = np.flatnonzero(exact)
        yield window_hashes(self.value, width)[at], at, np.zeros(len(self.value), bool)
        if width < SHORTEST:
            return
        for form, slot, other in ((self.plain, self.slot_plain, None), (self.named, self.slot_named, self.slot_plain)):
            filled = np.concatenate([[0], np.cumsum(slot)])
            slots = filled[width:] - filled[:-width]
            good = (self.row[:n] == self.row[width - 1:]) & (width - slots >= LITERALS)
            if other is not None:
                was = np.concatenate([[0], np.cumsum(other)])
                good &= slots > was[width:] - was[:-width]
            at = np.flatnonzero(good)
            yield window_hashes(form, width)[at], at, slot


def _windows(batches, lengths, bitmap, whole_items: bool):
    import pyarrow as pa

    row0 = TaskContext.get().partitionId() << 36
    names = [x.split()[0] for x in HITS.replace("array<long>", "x").split(", ")] + ["tokens"] * whole_items
    for batch in slices(batches, "text", SLICE):
        t = Template(batch.column("text"))
        tokens = np.diff(t.firsts)
        out = [[] for _ in range(5)]
        slots = []
        for width in lengths:
            for hashes, at, slot in t.windows(width):
                if whole_items:  # a short item is a window of its own length, and others have full windows
                    size = tokens[t.row[at]]
                    ok = np.minimum(size, WINDOW) == width
                else:
                    ok = bitmap[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]
                hashes, at = hashes[ok], at[ok]
                for c, x in zip(out, (t.row[at] + row0, t.row[at], at - t.firsts[t.row[at]], np.full(len(at), width), signed(hashes)), strict=True):
                    c.append(x)
                for a in at.tolist():
                    slots.append(signed(t.value[a:a + width][slot[a:a + width]]).tolist())
        if slots:
            row, of, place, width, hashes = (np.concatenate(c) for c in out)
            ids = batch.column("doc_id").cast(pa.int64()).take(pa.array(of))
            cols = [pa.array(row), ids, pa.array(place.astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(hashes), pa.array(slots, pa.list_(pa.int64()))]
            if whole_items:
                cols.append(pa.array(tokens[of]))
            yield pa.RecordBatch.from_arrays(cols, names=names)
        row0 += batch.num_rows


def judged(hits: list[dict]) -> tuple[int, int]:
    """Covered tokens of the item, and slots whose value differs, over the windows that fit the majority's filling."""
    pairs = Counter((a, b) for h in hits for a, b in zip(h["i_slots"], h["slots"], strict=True))
    ranked = sorted(pairs, key=lambda p: (-pairs[p], p))
    to, back = {}, {}
    for a, b in ranked:
        if a not in to and b not in back:
            to[a], back[b] = b, a
    covered, changed = set(), set()
    for h in hits:
        if all(to.get(a) == b for a, b in zip(h["i_slots"], h["slots"], strict=True)):
            covered.update(range(h["i_place"], h["i_place"] + h["length"]))
            changed.update(a for a, b in zip(h["i_slots"], h["slots"], strict=True) if a != b)
    return len(covered), len(changed)


LEAKS = "doc_id long, item_id long, item_tokens long, covered_tokens long, changed_slots long"


def _leaks(batches):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            covered, changed = judged(r["hits"])
            if covered >= MIN_TOKENS or covered >= MIN_COVER * r["tokens"]:
                rows.append((r["doc_id"], r["item_id"], r["tokens"], covered, changed))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=[x.split()[0] for x in LEAKS.split(", ")])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, item_tokens, covered_tokens, changed_slots for every pair of a document and an item it leaks.

    ``docs`` has doc_id and text, ``items`` item_id and text; further columns are not read. Null and empty texts,
    and those without a token, match nothing. Repeated documents and items give a row for each pair; null ids stay null. Empty tables give no
    rows. Whole texts are read once.

    Tasks get a bitmap of fixed size over the items' windows, whatever their number; it only thins out the windows
    before the join, which decides. The lists that the last step reads belong to one document and one item.
    """
    spark = docs.sparkSession
    ship(spark)
    widths = range(1, WINDOW + 1)
    named = items.select(F.col("item_id").alias("doc_id"), "text")
    known = cut(named.mapInArrow(lambda b: _windows(b, widths, None, True), HITS + ", tokens long"), "decontam-items")
    shape = known.agg(F.collect_set(F.col("hash").bitwiseAND((1 << FILTER_BITS) - 1)).alias("bits"), F.collect_set("length").alias("lengths")).first()
    bitmap = np.zeros(1 << FILTER_BITS, bool)
    bitmap[shape.bits] = True
    shared, lengths = spark.sparkContext.broadcast(np.packbits(bitmap)), sorted(shape.lengths)
    found = docs.select("doc_id", "text").mapInArrow(lambda b: _windows(b, lengths, np.unpackbits(shared.value).view(bool), False), HITS)
    i = known.select(
        F.col("row").alias("i_row"), F.col("doc_id").alias("item_id"), F.col("place").alias("i_place"), F.col("hash").alias("i_hash"),
        F.col("length").alias("i_length"), F.col("slots").alias("i_slots"), "tokens",
    )
    hits = found.join(i, (F.col("hash") == F.col("i_hash")) & (F.col("length") == F.col("i_length")) & (F.size("slots") == F.size("i_slots")))
    pairs = hits.groupBy("row", "doc_id", "i_row", "item_id", "tokens").agg(F.collect_list(F.struct("place", "i_place", "length", "slots", "i_slots")).alias("hits"))
    return pairs.select("doc_id", "item_id", "tokens", "hits").mapInArrow(_leaks, LEAKS)


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id leaks no item, all columns kept, whatever their names; null ids always stay."""
    return without_ids(docs, lambda: leaks(docs, items).select("doc_id"), "decontam-leaks")
