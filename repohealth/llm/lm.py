"""Language-model scoring with a weighted backoff automaton.

Words are counted over all training documents and their counts go back to the blocks of documents that contain them.
N-grams of two and more words go the same way: a block sends its own by ranges of hashes, those seen twice or more are
kept, and the counts come back to every block in the order in which it sent them. One block for each kept n-gram reports
it to its context, whose sums come back likewise. Each block then builds the part of the automaton that its documents can
reach. All of this grows with the input; nothing is collected or broadcast but totals.

A state is a context that has arcs; its failure arc leads to the context without its first word and costs the backoff
weight. The root has an arc for every known word and one for all unknown words. One left-to-right traversal carries the
states of all documents of a block at once, a step for each token position.

Smoothing: interpolated Witten-Bell. With k the counts of kept arcs of h, K their sum and T their number,
p(w | h) = (k(h, w) + (c(h) - K + T) p(w | h')) / (c(h) + T); at the root T is V and the last term is uniform over the
V known types and one unknown. Probabilities sum to one in every state.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repohealth.llm.common import crc_mod, cut, cut_shuffled, find, mix, per_row, ship, slices, text_buffer, window_hashes, word_hashes, words

ORDER = 3
SHARE = 0.0  # n-grams below this share of the training tokens are left out; those seen once always are
BLOCK_BYTES = 8 << 20  # of text; a worker takes about 20 times that, smaller blocks send more n-grams twice
STRETCH = 256  # tokens, at least 2 * ORDER
END = mix(np.array([3], np.uint64))[0]  # the token after the last word of a document

FACTS = "block long, n_tokens long, trained_tokens long, doc_id array<long>, held_out array<boolean>, n array<long>, words binary, ids binary"
SENT = "bucket long, kind int, block long, gram binary, n binary, types binary"
ANSWERS = "k_block long, kind int, bucket long, n binary, types binary, new long"
GROUP_TOKENS = 1 << 21  # tokens of the input for each bucket of n-grams
FEWEST = 16  # buckets of small inputs


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes: the first bytes of all numbers, then the second ones and so on."""
    import pyarrow as pa

    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, kind) -> np.ndarray:
    import pyarrow as pa

    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


def token_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts (words in lower case, then the end) and the n + 1 offsets of the texts."""
    raw, offsets = text_buffer(column, lower=True)
    starts, ends, firsts = words(raw, offsets)
    n = np.diff(firsts) + 1
    places = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(places[-1], np.uint64)
    keep = np.ones(len(out), bool)
    keep[places[1:] - 1] = False
    out[~keep] = END
    out[keep] = word_hashes(raw, starts, ends)
    return out, places


def _blocks(batches, size: int):
    """Arrow batches put together or cut to about ``size`` bytes of text."""
    import pyarrow as pa

    held, bytes_held = [], 0
    for part in slices(batches, "text", size):
        held.append(part)
        bytes_held += part.nbytes
        if bytes_held >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, bytes_held = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _facts(batches):
    """One row for each block of documents: its documents, the hashes of its words by number, the numbers of its tokens."""
    import pyarrow as pa

    part = TaskContext.get().partitionId()
    for k, batch in enumerate(_blocks(batches, BLOCK_BYTES)):
        tokens, places = token_hashes(batch.column("text"))
        held_out = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        distinct, ids = np.unique(tokens, return_inverse=True)
        # frequent words get small numbers, which compress well
        by_use = np.argsort(-np.bincount(ids, minlength=len(distinct)), kind="stable")
        number = np.empty(len(distinct), np.uint32)
        number[by_use] = np.arange(len(distinct), dtype=np.uint32)
        n = np.diff(places)
        row = [part << 32 | k, len(tokens), int(n[~held_out].sum()), batch.column("doc_id").cast(pa.int64()), held_out, n, _pack(distinct[by_use]), _pack(number[ids])]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        arrays = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) if pa.types.is_list(t) else pa.array([v], t) for v, t in zip(row, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=_names(FACTS))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct numbers, a place of each, and the number of each item among them."""
    by = np.argsort(x)
    in_order = x[by]
    new = np.append(True, in_order[1:] != in_order[:-1])[:len(x)]
    inverse = np.empty(len(x), np.int32)
    inverse[by] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return in_order[new], by[new], inverse


@dataclass
class Level:
    """Distinct n-grams of a block by hash, the first position of each, its count in training documents, and the n-gram at each position or -1."""

    gram: np.ndarray
    first: np.ndarray
    trained: np.ndarray
    of: np.ndarray


class Block:
    """The facts of a block, and what was answered to it. Numbers kept for each position have 32 bits: a worker's memory follows from them."""

    def __init__(self, facts, answers=None):
        import pyarrow.compute as pc

        self.block = facts["block"][0].as_py()
        lists = {c: facts[c].combine_chunks() for c in ("doc_id", "held_out", "n")}
        lists = {c: pc.list_flatten(v) for c, v in lists.items()}
        self.doc_id, self.held_out = lists["doc_id"], lists["held_out"]
        self.places = np.concatenate([[0], np.cumsum(lists["n"].to_numpy())]).astype(np.int64)
        self.words = _unpack(facts["words"][0].as_py(), np.uint64)
        self.ids = _unpack(facts["ids"][0].as_py(), np.uint32)
        self.x, self.row = self.words[self.ids], np.repeat(np.arange(len(self.places) - 1, dtype=np.int32), np.diff(self.places))
        self.trains = ~self.held_out.to_numpy(zero_copy_only=False).astype(bool)
        self.answers = {}
        if answers is not None:
            answers = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
            for kind, n, types in zip(*(answers[c].to_pylist() for c in ("kind", "n", "types")), strict=True):
                own = self.answers.setdefault(kind, ([], []))
                own[0].append(_unpack(n, np.int64))
                if types is not None:
                    own[1].append(_unpack(types, np.int64))

    def answer(self, kind: int, part: int = 0) -> np.ndarray:
        """Numbers answered to the n-grams that were sent as ``kind``, in their order."""
        return np.concatenate(self.answers.get(kind, ([], []))[part] or [np.empty(0, np.int64)])

    def levels(self, last: int, least: int) -> list[Level]:
        """Levels 1 to ``last``; above pairs, an n-gram is left out when one of the two shorter ones in it is not kept."""
        by = np.argsort(self.words)
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by), dtype=np.int32)
        of = rank[self.ids]
        trains = self.trains[self.row]
        found = [Level(self.words[by], np.empty(0, np.int64), np.bincount(of[trains], minlength=len(by)), of)]
        for k in range(2, last + 1):
            n = max(0, len(self.x) - k + 1)
            fits = self.row[:n] == self.row[k - 1:] if n else np.empty(0, bool)
            if k > 2:
                below = found[-1].of
                kept = (below >= 0) & np.append(np.abs(self.answer(k - 1)) >= least, False)[below]
                fits &= kept[:n] & kept[1:n + 1]
            at = np.flatnonzero(fits).astype(np.int32)
            gram, first, inverse = _distinct(_windows(self.x, k)[at])
            of = np.full(len(self.x), -1, np.int32)
            of[at] = inverse
            found.append(Level(gram, at[first], np.bincount(inverse[trains[at]], minlength=len(gram)), of))
        return found


def _sent(kind: int, block: int, buckets: int, gram: np.ndarray, n: np.ndarray | None = None, types: np.ndarray | None = None):
    """Rows of ``SENT`` for sorted hashes: a row for each bucket, which holds a range of hashes."""
    import pyarrow as pa

    bucket = ((gram >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cuts))

    def parts(x):
        return pa.array([None if x is None else _pack(x[cuts[b]:cuts[b + 1]]) for b in used], pa.binary())

    m = len(used)
    return pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(m, kind, np.int32)), pa.array(np.full(m, block, np.int64)), parts(gram), parts(n), parts(types)], names=_names(SENT))


def _first_levels(order: int, buckets: int):
    """Words and pairs of every block with their counts."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(pa.Table.from_batches([batch.slice(i, 1)]))
                for k, level in enumerate(block.levels(min(order, 2), 1), 1):
                    yield _sent(k, block.block, buckets, level.gram, level.trained)

    return run


def _next_level(k: int, order: int, least: int, buckets: int):
    """n-grams of ``k`` words with their counts, and contexts of k - 2 words: those of the block, and what this block has to report on them.

    Each kept n-gram of k - 1 words is reported by one of its blocks.
    """
    def run(facts, answers):
        import pyarrow as pa

        block = Block(facts, answers)
        levels = block.levels(min(k, order), least)
        out = [_sent(k, block.block, buckets, levels[k - 1].gram, levels[k - 1].trained)] if k <= order else []
        contexts, longer, n = levels[k - 3], levels[k - 2], block.answer(k - 1)
        own = np.flatnonzero(n <= -least)
        prefix = contexts.of[longer.first[own]]
        total, types = np.bincount(prefix, -n[own], len(contexts.gram)).astype(np.int64), np.bincount(prefix, minlength=len(contexts.gram))
        some = np.flatnonzero(types)
        out.append(_sent(2 - k, block.block, buckets, contexts.gram[some], total[some], types[some].astype(np.int64)))
        out.append(_sent(2 - k, block.block, buckets, contexts.gram[np.abs(block.answer(k - 2)) >= least]))
        return pa.Table.from_batches(out)

    return run


def _counted(least: int):
    """Answers to all blocks of a bucket.

    n-grams (kind 1, 2, ...): the count, 0 if it is not kept, negative for the one block that reports it. Contexts (kind
    -1, -2, ...): sum and number of the counts reported.
    """
    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        out = []
        for kind in pc.unique(table["kind"]).to_pylist():
            rows = table.filter(pc.equal(table["kind"], kind))
            asks = rows if kind > 0 else rows.filter(pc.is_null(rows["n"]))
            lists = [_unpack(g, np.uint64) for g in asks["gram"].to_pylist()]
            if not lists:
                continue
            cuts = np.cumsum([len(g) for g in lists])[:-1]
            grams, new = np.concatenate(lists), [0] * len(lists)
            if kind > 0:
                given = np.concatenate([_unpack(n, np.int64) for n in asks["n"].to_pylist()])
                distinct, first, inverse = _distinct(grams)
                n = np.bincount(inverse, given, len(distinct)).astype(np.int64)
                n[n < (1 if kind == 1 else least)] = 0
                answer, types = n[inverse], None
                answer[first] *= -1
                new = [int((a < 0).sum()) for a in np.split(answer, cuts)]
            else:
                told = rows.filter(pc.is_valid(rows["n"]))
                keys, total, number = (np.concatenate([_unpack(v, t) for v in told[c].to_pylist()] or [np.empty(0, t)]) for c, t in (("gram", np.uint64), ("n", np.int64), ("types", np.int64)))
                distinct, inverse = np.unique(keys, return_inverse=True)
                at = find(distinct, grams)
                answer, types = (np.append(np.bincount(inverse, v, len(distinct)).astype(np.int64), 0)[at] for v in (total, number))
            for block, bucket, n, t, m in zip(asks["block"].to_pylist(), asks["bucket"].to_pylist(), np.split(answer, cuts), [None] * len(lists) if types is None else np.split(types, cuts), new, strict=True):
                out.append((block, kind, bucket, _pack(n), None if t is None else _pack(t), m))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=_names(ANSWERS))

    return run


def _windows(hashes: np.ndarray, order: int) -> np.ndarray:
    return window_hashes(hashes, order) if order > 1 else hashes


@dataclass
class Automaton:
    """States 0 (root), 1, ...; arcs sorted by state * number of kept words + word."""

    vocabulary: np.ndarray  # sorted hashes of the kept words
    fail: np.ndarray
    backoff: np.ndarray  # log10 weight of the failure arc
    arc_key: np.ndarray
    arc_cost: np.ndarray
    arc_to: np.ndarray
    entry: np.ndarray  # state after a kept word that was read from the root
    depth: int

    def traverse(self, tokens: np.ndarray, places: np.ndarray, hashes: np.ndarray, root_cost: np.ndarray) -> np.ndarray:
        """log10 probability of every row of ``tokens``, which are places in ``hashes``; root_cost: of each of these.

        Long rows are walked in stretches, all of them at once.
        """
        kept = find(self.vocabulary, hashes)
        n = -(-np.diff(places) // STRETCH)
        starts, ends = np.repeat(places[:-1], n), np.repeat(places[1:], n)
        firsts = starts + STRETCH * (np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n))
        # a state follows from the last ``depth`` words; what is spent on those before a stretch is written over by its neighbour
        begins = np.maximum(firsts - self.depth, starts)
        lengths = np.minimum(firsts + STRETCH, ends) - begins
        by_length = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[by_length], lengths[by_length]
        spent, state = np.zeros(len(tokens)), np.zeros(len(begins), np.int64)
        width = len(self.vocabulary)
        # stretches that still have a token at each position are the first ones
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(lengths) else 0), "right")
        for position, m in enumerate(active.tolist()):
            word = tokens[begins[:m] + position]
            k, s, cost, wait = kept[word], state[:m].copy(), np.zeros(m), np.ones(m, bool)
            for _ in range(self.depth):
                deep = np.flatnonzero(wait & (s > 0))
                if not len(deep):
                    break
                arc = np.where(k[deep] >= 0, find(self.arc_key, s[deep] * width + k[deep]), -1)
                hit, miss = deep[arc >= 0], deep[arc < 0]
                cost[hit] += self.arc_cost[arc[arc >= 0]]
                s[hit] = self.arc_to[arc[arc >= 0]]
                wait[hit] = False
                cost[miss] += self.backoff[s[miss]]
                s[miss] = self.fail[s[miss]]
            rest = np.flatnonzero(wait)
            cost[rest] += root_cost[word[rest]]
            s[rest] = np.where(k[rest] >= 0, self.entry[k[rest]], 0) if width else 0
            spent[begins[:m] + position] = cost
            state[:m] = s
        return _row_sums(spent, places)


def root_probability(count, tokens: int, types: int):
    """p(w) of a word with this training count; 0 is the one unknown type."""
    return (count + types / (types + 1)) / (tokens + types) if tokens else count * 0 + 1.0


def build(kept: list[dict[tuple[int, ...], int]], tokens: int, types: int) -> Automaton:
    """The automaton of n-gram counts: kept[0] words, kept[1] pairs and so on, as tuples of word hashes."""
    vocabulary = np.array(sorted(w for w, in kept[0]), np.uint64)
    place = {int(w): i for i, w in enumerate(vocabulary)}
    contexts = {g[:-1] for grams in kept[1:] for g in grams}
    states = {(): 0} | {g: i for i, g in enumerate(sorted(contexts, key=lambda g: (len(g), g)), 1)}

    def longest(g: tuple[int, ...]) -> int:
        while g not in states:
            g = g[1:]
        return states[g]

    p: dict[tuple[int, ...], float] = {g: float(root_probability(c, tokens, types)) for g, c in kept[0].items()}
    fail, backoff = np.zeros(len(states), np.int64), np.zeros(len(states))
    arcs = []

    def probability(g: tuple[int, ...]) -> float:
        """p of the last word after the others, through failure arcs where g itself is not kept."""
        weight = 1.0
        while g not in p:
            h = g[:-1]
            weight *= weights.get(h, 1.0)
            g = g[1:]
        return weight * p[g]

    weights: dict[tuple[int, ...], float] = {}
    for order in range(1, len(kept)):
        sums: dict[tuple[int, ...], list[int]] = {}
        for g, c in kept[order].items():
            s = sums.setdefault(g[:-1], [0, 0])
            s[0] += c
            s[1] += 1
        for h, (total, n) in sums.items():
            weights[h] = (kept[order - 1][h] - total + n) / (kept[order - 1][h] + n)
        for g, c in kept[order].items():
            h = g[:-1]
            p[g] = c / (kept[order - 1][h] + sums[h][1]) + weights[h] * probability(g[1:])
            arcs.append((states[h] * len(vocabulary) + place[g[-1]], math.log10(p[g]), longest(g[1:] if len(g) == len(kept) else g)))
    for h, s in states.items():
        if h:
            fail[s], backoff[s] = longest(h[1:]), math.log10(weights[h])
    arcs.sort()
    entry = np.array([longest((int(w),)) for w in vocabulary], np.int64)
    key, cost, to = zip(*arcs, strict=True) if arcs else ((), (), ())
    return Automaton(vocabulary, fail, backoff, np.array(key, np.int64), np.array(cost), np.array(to, np.int64), entry, len(kept) - 1)


def of_block(ids: np.ndarray, root: np.ndarray, hashes: np.ndarray, levels: list[dict[str, np.ndarray]]) -> Automaton:
    """The part of the automaton that the texts of a block can reach.

    ids: word number at each position; root: p of every word at the root, by number. levels: for each order n, total and
    types (count, and sum and number of the counts of the kept n-grams one word longer); the first by word number, the
    others by a number of their own, with the one at each position, or -1, as at.
    """
    order = len(levels)
    vocabulary = np.unique(hashes)
    number_in = find(vocabulary, hashes)
    width = len(vocabulary)
    fail, backoff, arcs = [np.zeros(1, np.int64)], [np.zeros(1)], []
    states = 1
    at_position, p, level = ids, root, levels[0]
    down = np.zeros(len(root), np.int64)  # state of the longest context inside the shorter n-gram
    for n in range(1, order + 1):
        if n > 1:
            found = levels[n - 1]["at"]
            at = np.flatnonzero(found >= 0)
            of, first = np.unique(found[at], return_index=True)
            at = at[first]
            entries = len(levels[n - 1]["n"])
            before, after = np.zeros(entries, np.int64), np.zeros(entries, np.int64)
            before[of], after[of] = at_position[at], at_position[at + 1]
            c, t = level["n"][before], level["types"][before]
            longer = levels[n - 1]["n"] / (c + t) + weight[before] * p[after]
            down, start, p, level, at_position = state[after], own[before], longer, levels[n - 1], found
        has = level["types"] > 0 if n < order else np.zeros(len(p), bool)
        own = np.zeros(len(p), np.int64)
        own[has] = states + np.arange(np.count_nonzero(has))
        states += np.count_nonzero(has)
        weight = np.ones(len(p))
        weight[has] = ((level["n"] - level["total"] + level["types"]) / (level["n"] + level["types"]))[has]
        fail.append(down[has])
        backoff.append(np.log10(weight[has]))
        state = np.where(has, own, down)
        if n == 1:
            entry = np.zeros(width, np.int64)
            entry[number_in] = state
        elif len(of):
            arcs.append((start[of] * width + number_in[ids[at + n - 1]], np.log10(p[of]), state[of]))
    key, cost, to = (np.concatenate([a[k] for a in arcs]) if arcs else np.empty(0, kind) for k, kind in enumerate((np.int64, float, np.int64)))
    by = np.argsort(key)
    return Automaton(vocabulary, np.concatenate(fail), np.concatenate(backoff), key[by], cost[by], to[by], entry, order - 1)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, order: int = ORDER, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    The model learns from the rows where ``held_out`` is false (null counts as held out). Null and empty texts are the
    end token alone. Without training rows every score is 0. Repeated rows are scored and learnt each for itself, null
    ids stay null, further columns are not read. An empty table gives no rows.

    Words and n-grams are told apart by 64-bit hashes. Texts are read once for the facts, which are kept in the shared
    folder, a row for each block. What is shuffled are the sorted hashes of a block's n-grams, a row for each block and
    bucket of hashes, the counts that come back in their order, and the facts once for each of order - 1 levels and once
    for the scores. Shuffled files of a level are removed when its answers are written.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    facts = cut(source.mapInArrow(_facts, FACTS), "lm-facts")
    every, tokens = facts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("trained_tokens"), F.lit(0))).first()
    least, buckets = max(2, math.ceil(tokens * share)), FEWEST + every // GROUP_TOKENS

    def answered(sent: DataFrame, label: str) -> DataFrame:
        return cut_shuffled(sent.groupBy("bucket").applyInArrow(_counted(least), ANSWERS), label)

    answers = answered(facts.mapInArrow(_first_levels(order, buckets), SENT), "lm-counts")
    types = answers.where("kind = 1").agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0]
    for k in range(3, order + 2):
        sent = facts.groupBy("block").cogroup(answers.groupBy("k_block")).applyInArrow(_next_level(k, order, least, buckets), SENT)
        answers = answers.unionByName(answered(sent, f"lm-level-{k}"))

    def run(left, right):
        import pyarrow as pa

        block = Block(left, right)
        levels, places, ids = block.levels(order, least), block.places, block.ids
        number = find(levels[0].gram, block.words)
        counted, parts = np.abs(block.answer(1))[number].astype(float), []
        for k, level in enumerate(levels, 1):
            n = np.abs(block.answer(k))
            kept = n >= least
            total, kinds = np.zeros(len(n)), np.zeros(len(n))
            if k < order:
                total[kept], kinds[kept] = block.answer(-k), block.answer(-k, 1)
            if k == 1:
                parts.append({"n": counted, "total": total[number], "types": kinds[number]})
            else:
                at = np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1).astype(np.int32)[level.of]
                parts.append({"at": at, "n": n[kept].astype(float), "total": total[kept], "types": kinds[kept]})
        model = of_block(ids, root_probability(counted, tokens, types), block.words, parts)
        root = np.log10(root_probability(counted, tokens, types))
        base = np.log10((counted + 0.1) / (tokens + 0.1 * (types + 1)))
        return pa.table([
            block.doc_id, block.held_out, pa.array(np.diff(places)), pa.array(per_row(counted[ids] > 0, places)), pa.array(np.full(len(places) - 1, tokens)),
            pa.array(_row_sums(base[ids], places)), pa.array(model.traverse(ids, places, block.words, root)),
        ], names=_names(SCORES))

    return facts.groupBy("block").cogroup(answers.groupBy("k_block")).applyInArrow(run, SCORES)


def _row_sums(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of the rows, each added up by itself; every row has an item."""
    return np.add.reduceat(values, places[:-1]) if len(places) > 1 else np.zeros(0)


def fold(doc_id: Column, n: int = 10) -> Column:
    """The contract's held-out rows: crc32 of the id as text has remainder 0; a null id counts as empty text."""
    return crc_mod(F.coalesce(doc_id.cast("string"), F.lit("")), n) == 0
