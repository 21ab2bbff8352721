"""Quality rules: words, symbols and repetition inside a document, and the frequency of lines across documents.

Cross-document rule: lines are normalised (A-Z in lower case, digits as 0, white space as one blank) and hashed; for each
host the documents that contain a line are counted; lines above the limit are removed; a document that keeps too few of
its words is depleted and rejected.

Copies must not make each other's lines look like boilerplate: documents with the same distinct normalised lines count as
one. Near copies that differ in a normalised line count each, as documents with a common template do.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repohealth.llm.common import (
    _BYTE, cut, mix, per_row, powers, row_of, ship, signed, slices, text_buffer, window_hashes, without_ids, word_hashes, words,
)

MIN_DOCUMENTS = 20  # a line is removed in a host when more documents than this ...
MAX_SHARE = 0.1  # ... and more than this share of the host's documents contain it ...
MAX_DOCUMENTS = 1000  # ... or more than this number, however large the host is
MIN_WORDS = 10  # a document with fewer words left ...
MIN_LEFT = 0.2  # ... or a smaller share of its words left is depleted, if lines of it were removed
WINDOW = 5
SLICE = 1 << 20  # bytes of text that a task works on at a time

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48

FACTS = (
    "row long, doc_id long, host long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "content long, lines array<struct<line:long,words:long>>"
)


def _distinct_in_rows(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First item and number of items of every distinct (row, hash), and for each item which of them it is."""
    keys = mix(hashes ^ mix(row.astype(np.uint64)))
    _, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, count, inverse


def measures(column) -> dict[str, np.ndarray]:
    """Base measures of every text of an Arrow column, and its distinct normalised lines with their words."""
    raw, offsets = text_buffer(column)
    starts, ends, firsts = words(raw, offsets)
    n = np.diff(firsts)
    characters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    word_row = row_of(firsts)

    # words inside windows that occur twice or more
    covered = np.zeros(len(starts), bool)
    windows = window_hashes(word_hashes(raw, starts, ends), WINDOW)
    whole = np.flatnonzero(word_row[:len(windows)] == word_row[WINDOW - 1:WINDOW - 1 + len(windows)]) if len(windows) else np.empty(0, np.int64)
    if len(whole):
        _, count, inverse = _distinct_in_rows(windows[whole], word_row[whole])
        for k in range(WINDOW):
            covered[whole[count[inverse] > 1] + k] = True

    # lines with a word: the line of every word, then raw and normalised hashes of these lines
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    line_of = breaks[starts] + word_row  # grows by one at each line end and each new row
    first_word = np.flatnonzero(np.diff(line_of, prepend=-1))
    line_row = word_row[first_word]
    if len(first_word):
        line_ends = np.flatnonzero(raw == 10)
        edges = np.unique(np.concatenate([line_ends + 1, offsets]))  # where a line may begin or have ended
        at = np.searchsorted(edges, starts[first_word], "right") - 1
        begin = edges[at]
        after = np.append(edges, len(raw))[np.minimum(at + 1, len(edges))]
        end = np.where((after > 0) & (raw[after - 1] == 10), after - 1, after)
        place = np.arange(len(raw)) - np.repeat(edges[:-1], np.diff(edges))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * powers(int(place.max()) + 1)[place], dtype=np.uint64)])
        exact = mix((total[end] - total[begin]) ^ mix((end - begin).astype(np.uint64)))
        first, _, _ = _distinct_in_rows(exact, line_row)
        dup_lines = np.bincount(line_row, minlength=len(n)) - np.bincount(line_row[first], minlength=len(n))

        folded = word_hashes(_FOLD[raw], starts, ends)
        in_line = np.arange(len(starts)) - np.repeat(first_word, np.diff(np.append(first_word, len(starts))))
        line_hash = mix(np.add.reduceat(folded * powers(int(in_line.max()) + 1)[in_line], first_word))
        line_words = np.diff(np.append(first_word, len(starts)))
        first, _, inverse = _distinct_in_rows(line_hash, line_row)
        order = np.argsort(line_row[first], kind="stable")
        of_line, of_words = line_hash[first][order], np.bincount(inverse, line_words).astype(np.int64)[order]
        of_row = line_row[first][order]
    else:
        dup_lines, of_line, of_words, of_row = np.zeros(len(n), np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    places = np.searchsorted(of_row, np.arange(len(n) + 1))
    content = per_row(mix(of_line), places)
    return {
        "n_words": n, "word_chars": per_row(characters[ends] - characters[starts], firsts), "n_symbols": per_row(_SYMBOL[raw], offsets),
        "n_dup_lines": dup_lines, "n_repeat_words": per_row(covered, firsts), "content": content,
        "line": signed(of_line), "words": of_words, "places": places,
    }


def _facts(batches):
    import pyarrow as pa
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 36
    for batch in slices(batches, "text", SLICE):
        m = measures(batch.column("text"))
        lines = pa.StructArray.from_arrays([pa.array(m[k]) for k in ("line", "words")], names=["line", "words"])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(row, row + batch.num_rows)), batch.column("doc_id").cast(pa.int64()), batch.column("host"),
            *(pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            pa.array(m["content"].view(np.int64)), pa.ListArray.from_arrays(pa.array(m["places"].astype(np.int32)), lines),
        ], names=[x.strip().split()[0] for x in FACTS.partition(", lines")[0].split(",")] + ["lines"])
        row += batch.num_rows


def judge(
    docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE,
    min_words: int = MIN_WORDS, min_left: float = MIN_LEFT, max_documents: int = MAX_DOCUMENTS,
) -> DataFrame:
    """Measures and verdict for every row of ``docs`` (doc_id, text and a host column).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed, kept. Null
    and empty texts have no words and fail. Null hosts are one host. Repeated rows are judged each for itself and count
    as one document across documents; null ids stay null; further columns are not read. An empty table gives no rows.

    Texts are read once; their facts (measures and line hashes) are kept in the shared folder. A line that a third of
    all documents have is one row a task in the count, and in the join with the removed lines the large side can be
    split. Removed lines are joined, not broadcast by hint.
    """
    ship(docs.sparkSession)
    facts = cut(docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit("\x00"))).alias("host")).mapInArrow(_facts, FACTS), "quality-facts")
    lines = facts.select("row", "host", "content", F.explode("lines").alias("l")).select("row", "host", "content", "l.*")
    hosts = facts.where("n_words > 0").select("host", "content").distinct().groupBy(F.col("host").alias("h_host")).agg(F.count("*").alias("documents"))
    limit = F.greatest(F.lit(float(min_documents)), F.least(F.col("documents") * F.lit(max_share), F.lit(float(max_documents))))
    counts = lines.groupBy("host", "line").agg(F.countDistinct("content").alias("n")).where(F.col("n") > min_documents)
    frequent = cut(
        counts.join(hosts, F.col("host") == F.col("h_host")).where(F.col("n") > limit).select(F.col("host").alias("f_host"), F.col("line").alias("f_line")),
        "quality-lines",
    )
    removed = lines.join(frequent, (F.col("host") == F.col("f_host")) & (F.col("line") == F.col("f_line")))
    removed = removed.groupBy(F.col("row").alias("r_row")).agg(F.sum("words").alias("removed"))
    judged = facts.drop("lines", "host", "content").join(removed, F.col("row") == F.col("r_row"), "left")
    gone = F.coalesce("removed", F.lit(0))
    left = F.col("n_words") - gone
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (gone > 0) & ((left < min_words) | (left < F.col("n_words") * F.lit(min_left)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", gone.alias("n_removed_words"),
        base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"),
    )


def without_rejected(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` whose doc_id no rule rejects, all columns kept, whatever their names; null ids always stay."""
    return without_ids(docs, lambda: judge(docs, **limits).where("NOT kept").select("doc_id"), "quality-rejected")
