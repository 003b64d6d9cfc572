"""Quality rules by suffix-array repetition.

Texts that repeat any short run of words get a suffix array over their words (prefix doubling, all texts of a slice at
once). The longest-common-prefix values of neighbouring suffixes are the depths of its LCP intervals: the larger of a
suffix's two values is the longest substring that starts there and occurs again. The union of these spans is the covered
part of the text, and the largest value its longest repeat; a text passes while both stay within their limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, with_rest
from .words import NOT_SPACE, find_words, gram_hashes, mix, sliced, span_hashes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring bounds."""
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(hashes: np.ndarray, doc: np.ndarray, room: np.ndarray, k: int) -> np.ndarray:
    """Flags of positions whose run of k words occurs again in the same text; room: words from there to the text's end."""
    at = np.flatnonzero(room >= k)
    out = np.zeros(len(hashes), bool)
    if len(at):
        key = mix(gram_hashes(hashes, k)[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(at), bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        out[at[hit]] = True
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Flags of the positions that the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def longest_again(hashes: np.ndarray, doc: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each position the length of the longest run of words that starts there and also elsewhere in its text."""
    n = len(hashes)
    _, rank = np.unique(mix(hashes) ^ mix(doc.astype(np.uint64)), return_inverse=True)
    counts = np.bincount(rank)
    rank = (np.cumsum(counts) - counts)[rank]  # a group's rank is where it starts in the suffix array
    levels, length = [(1, rank)], 1
    while True:
        counts = np.bincount(rank, minlength=n)
        at = np.flatnonzero(counts[rank] > 1)
        if not len(at):
            break
        after = np.where(room[at] > length, rank[np.minimum(at + length, n - 1)], -1)
        order = np.lexsort((after, rank[at]))
        group, after = rank[at][order], after[order]
        fresh = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        place = np.arange(len(at))
        start = np.maximum.accumulate(np.where(fresh, place, 0)) - head[np.searchsorted(head, place, "right") - 1]
        rank = rank.copy()
        rank[at[order]] = group + start
        length *= 2
        levels.append((length, rank))
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    a, b = suffix[:-1], suffix[1:]
    lcp = np.zeros(len(a), np.int64)
    for length, rank in reversed(levels):
        i, j = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        whole = (room[a] - lcp >= length) & (room[b] - lcp >= length) & (doc[a] == doc[b])
        lcp += length * (whole & (rank[i] == rank[j]))
    out = np.zeros(n, np.int64)
    out[b] = lcp
    out[a] = np.maximum(out[a], lcp)
    return out


def _measure(min_repeat: int, max_covered: int, max_repeat: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in sliced(batch.column(1)):
                text = batch.column(1).slice(a, b - a)
                w = find_words(text, lower=False)
                n, offsets, data = w.counts, w.offsets, w.data
                is_word = NOT_SPACE[data]
                chars = sums(is_word & ((data & 0xC0) != 0x80), offsets)
                symbols = sums(SYMBOLS[data], offsets)
                # lines: from each start or newline to the next newline or end
                lines = np.flatnonzero(data == 0x0A)
                line_doc = np.searchsorted(offsets, lines, "right") - 1
                starts = np.concatenate([offsets[:-1], lines + 1])
                ends = np.concatenate([lines, offsets[1:]])
                starts.sort()
                ends.sort()
                docs = np.sort(np.concatenate([np.arange(len(w)), line_doc]))
                filled = np.diff(np.append(0, np.cumsum(is_word))[np.stack([starts, ends])], axis=0)[0] > 0
                key = mix(span_hashes(data, starts, ends)[filled] + docs[filled].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                _, once = np.unique(key, return_index=True)
                dup_lines = np.bincount(docs[filled], minlength=len(w)) - np.bincount(docs[filled][once], minlength=len(w))
                doc = np.repeat(np.arange(len(w)), n)
                room = np.repeat(w.first[1:], n) - np.arange(len(doc))
                again = np.flatnonzero(repeated(w.hashes, doc, room, 8))
                repeat_words = sums(covered(again, np.full(len(again), 8), len(doc)), w.first)
                # the suffix arrays of texts that repeat anything
                some = np.zeros(len(w), bool)
                some[doc[repeated(w.hashes, doc, room, min_repeat)]] = True
                at = np.flatnonzero(some[doc])
                cover, longest = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
                if len(at):
                    most = longest_again(w.hashes[at], doc[at], room[at])
                    np.maximum.at(longest, doc[at], most)
                    long = most >= min_repeat
                    spans = covered(np.flatnonzero(long), most[long], len(at))
                    cover = np.bincount(doc[at], weights=spans, minlength=len(w)).astype(np.int64)
                failed = (n < 20) | (100 * repeat_words > 30 * n)
                kept = ~failed & (100 * cover <= max_covered * n) & (longest <= max_repeat)
                longest = np.where(longest >= min_repeat, longest, 0)
                rest = range(2, batch.num_columns)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), *map(pa.array, (n, chars, symbols, dup_lines, repeat_words, cover, longest, failed, kept)), *[batch.column(i).slice(a, b - a) for i in rest]],
                    [c.split()[0] for c in COLUMNS.split(", ")] + [batch.schema.names[i] for i in rest],
                )

    return run


def quality_rules(docs: DataFrame, min_repeat: int = 5, max_covered: int = 35, max_repeat: int = 100, row: Column | None = None) -> DataFrame:
    """Counts and a verdict for each text; columns doc_id and text are read, others ignored.

    Returns a row per input row (repeated rows too): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (in runs of 8 words found twice), covered_words (in runs of min_repeat words or more found twice),
    longest_repeat (0 if shorter than min_repeat), base_failed (under 20 words, or over 30 % in repeated 8-word runs) and
    kept (not failed, at most max_covered percent covered, no repeat over max_repeat words), and `row`, a column of docs,
    if it is given.
    Null and empty texts have no words and fail. Texts are taken whole. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([row.alias("row")] if row is not None else []))
    return narrow.mapInArrow(_measure(min_repeat, max_covered, max_repeat), with_rest(COLUMNS, narrow))
