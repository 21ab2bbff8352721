"""Packing: concatenate all documents and cut the stream into sequences of a fixed length.

First pass: token ids of every document, with its place inside its partition; the totals of the partitions give every
partition its global offset (one number a partition on the driver). Second pass: each document knows its global start and
is cut where a sequence ends; a document that crosses such an end gives one boundary record for each piece.
"""

from __future__ import annotations

import json
import zlib
from itertools import repeat

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from repohealth.llm.common import cut, ship, slices, text_buffer

SEQUENCE = 4096
END_ID = 2
KNOWN_WORDS = 150_000  # words whose ids a Python worker remembers; a full memory is emptied, results do not change

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# What the shorter way through distinct words relies on; any other tokenizer reads whole texts.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds:
    """Token ids of texts, one look-up for each distinct word of a batch where the tokenizer works word by word.

    It does so if it drops white space, ignores case and splits letters from '.' and ',' (checked when it is loaded);
    then the ids of a text are those of its words in order. Any other tokenizer gets whole texts, as do texts in which
    lower case would make a special token of what is none.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        parts = json.loads(self.tokenizer.to_str())
        norm, pre = parts["normalizer"] or {}, parts["pre_tokenizer"] or {}
        self.by_words = (
            [x["type"] for x in norm.get("normalizers", [])] == NORMALIZERS and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"] == {"Regex": PATTERN})
        self.special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        ending = parts["model"].get("end_of_word_suffix")
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            self.ending[k] = bool(ending) and token.endswith(ending)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.used = np.empty(1 << 16, self.size), np.zeros(1, np.int64), 0

    def _each(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, and how many each has."""
        e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
        return np.asarray(e.ids, self.size), np.bincount(np.asarray(e.word_ids, np.int64), minlength=len(part)) if len(e.ids) else np.zeros(len(part), np.int64)

    def _letters(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters only, read as one text: each is one piece, closed by a token with the word's end."""
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.size)
        ends = np.flatnonzero(self.ending[ids]) + 1
        if len(ends) != len(part) or len(ids) != ends[-1]:  # a letter that falls apart in lower case
            return self._each(part)
        return ids, np.diff(ends, prepend=0)

    def _learn(self, new: list[str]) -> None:
        new = sorted(new, key=str.isalpha)
        letters = sum(map(str.isalpha, new))
        known, ids, lengths = len(self.place), [], []
        self.place.update(zip(new, range(known, known + len(new)), strict=True))
        for group, read in ((new[:len(new) - letters], self._each), (new[len(new) - letters:], self._letters)):
            for k in range(0, len(group), 2000):
                found = read(group[k:k + 2000])
                ids.append(found[0])
                lengths.append(found[1])
        more = np.concatenate(ids)
        while self.used + len(more) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used:self.used + len(more)] = more
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(np.concatenate(lengths))])
        self.used += len(more)

    def _places(self, distinct: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))

    def _whole(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts by the tokenizer itself."""
        found = [np.asarray(self.tokenizer.encode(x.as_py() or "", add_special_tokens=False).ids, self.size) for x in column]
        return np.concatenate([np.empty(0, self.size), *found]), np.cumsum([0, *map(len, found)])

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column and the n + 1 offsets of the texts in them; null is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_words:
            return self._whole(column)
        raw, offsets = text_buffer(column, lower=True)
        text = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw)))
        text = pc.replace_substring_regex(text, r"([a-z])([.,])", r"\1 \2")
        parts = pc.ascii_split_whitespace(text)
        flat = parts.flatten().dictionary_encode()
        begins = np.asarray(parts.offsets) - parts.offsets[0].as_py() if len(parts) else np.zeros(1, np.int64)
        place_of = flat.indices.to_numpy(zero_copy_only=False)
        odd = np.zeros(len(flat.dictionary), bool)
        for token in self.special:
            odd |= pc.match_substring(flat.dictionary, token).to_numpy(zero_copy_only=False)
        if odd.any():
            return self._mixed(column, np.add.reduceat(np.append(odd[place_of], False).astype(int), begins[:-1]) * (np.diff(begins) > 0) > 0)
        distinct = flat.dictionary.to_numpy(zero_copy_only=False)
        of = self._places(distinct)
        lacking = np.flatnonzero((of < 0) & (distinct != ""))
        if self.place and len(self.place) + len(lacking) > KNOWN_WORDS:
            self.clear()
            lacking = np.flatnonzero(distinct != "")
            of[:] = -1
        if len(lacking):
            self._learn(distinct[lacking].tolist())
            of[lacking] = self._places(distinct[lacking])
        index = of[place_of] if len(distinct) else np.empty(0, np.int64)
        lengths = np.where(index >= 0, self.starts[index + 1] - self.starts[index], 0)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(np.where(index >= 0, self.starts[index], 0) - ends[:-1], lengths) + np.arange(ends[-1])
        return self.ids[at], ends[begins]

    def _mixed(self, column, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``whole`` by the tokenizer itself, runs of others by their words."""
        cuts = [0, *(np.flatnonzero(np.diff(whole)) + 1).tolist(), len(whole)]
        found = [self._whole(part) if whole[a] else self.encode(part) for a, b in zip(cuts, cuts[1:], strict=False) for part in [column.slice(a, b - a)]]
        return np.concatenate([ids for ids, _ in found]), np.cumsum(np.concatenate([[0], *(np.diff(o) for _, o in found)]))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer for each Python worker and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """part, place, doc_id, n, ids: a document's ids with the end id, and its place among its partition's ids."""

    def run(batches):
        import pyarrow as pa

        encoder, part, place = word_ids(vocabulary), TaskContext.get().partitionId(), 0
        for rows in slices(batches, "text"):
            ids, offsets = encoder.encode(rows.column("text"))
            n = np.diff(offsets) + 1
            out = np.empty(len(ids) + len(n), "<u4" if encoder.size is np.uint32 else "<u2")
            ends = np.cumsum(n) - 1
            keep = np.ones(len(out), bool)
            keep[ends] = False
            out[keep], out[ends] = ids, end_id
            raw, width = out.tobytes(), out.itemsize
            places = np.concatenate([[0], np.cumsum(n)])
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((places * width).astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(n), part), pa.int32()), pa.array(place + places[:-1]), rows.column("doc_id").cast(pa.int64()), pa.array(n), data,
            ], names=["part", "place", "doc_id", "n", "ids"])
            place += int(places[-1])

    return docs.select("doc_id", "text").mapInArrow(run, "part int, place long, doc_id long, n long, ids binary")


def pack(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of ``sequence`` ids; only the last sequence is not full.

    ``vocabulary`` is the path of a tokenizer file that every executor has. Each row of ``docs`` becomes one or more
    pieces; null and empty texts are the end id alone. Repeated ids and rows are packed each for itself, null ids stay
    null, further columns are not read. An empty table gives no rows. With ``with_ids`` the ids of a piece are returned
    as little-endian unsigned 32-bit numbers.

    Ids are written once to the shared folder between the passes, so that no text is tokenized twice. The driver gets one
    number for each partition of the first pass, whatever the number of documents.
    """
    ship(docs.sparkSession)
    tokens = cut(tokenized(docs, vocabulary, end_id), "packing-ids")
    totals = {r["part"]: r["n"] for r in tokens.groupBy("part").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    base = np.zeros(max(totals, default=0) + 1, np.int64)
    for part, n in totals.items():
        base[part] = n
    base = np.concatenate([[0], np.cumsum(base)])[:-1]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("part", "place", "n")}
            first = base[column["part"]] + column["place"]
            cols: list[list] = [[] for _ in range(7 + with_ids)]
            for doc, n, at, ids in zip(batch.column("doc_id").to_pylist(), column["n"].tolist(), first.tolist(), batch.column("ids"), strict=True):
                raw = np.frombuffer(ids.as_buffer(), f"<u{len(ids.as_buffer()) // n}").astype("<u4").tobytes()
                start = 0
                while start < n:
                    offset = (at + start) % sequence
                    length = min(n - start, sequence - offset)
                    piece = raw[4 * start:4 * (start + length)]
                    row = (doc, start, length, zlib.crc32(piece), n, (at + start) // sequence, offset, piece)
                    for c, value in zip(cols, row, strict=False):
                        c.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), *(pa.array(c, pa.binary()) for c in cols[7:])], names=[*(x.split()[0] for x in PIECES.split(", ")), *["ids"] * with_ids])

    return tokens.mapInArrow(run, PIECES + ", ids binary" * with_ids)
