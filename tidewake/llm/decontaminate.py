"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ten consecutive words of each item (all words of a shorter one). For each pattern length a
shift table, indexed by a hash of the block of two words that ends at a position, says how far the search may jump
without missing a pattern. Where the shift is 0, the hashes of the pattern's last and first block select a bucket of
patterns, and the bytes of their words are compared with those of the text. All texts of a slice are searched at once,
each cut into stretches whose pointers jump side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import covered, sums
from .runtime import prepare, with_rest
from .words import ALNUM, Words, find_words, gram_hashes, mix, sequence_hashes, signed, sliced, span_hashes

#: Bytes of item text whose patterns are broadcast at once (some seven times as many); larger benchmarks are searched block by block.
BLOCK_BYTES = 8 << 20
#: Words of a stretch that one pointer runs through, and pairs of place and pattern that are compared at once.
STRETCH, COMPARED = 512, 1 << 18
NO_ITEMS = hashlib.sha256(b"").hexdigest()


@dataclass
class Patterns:
    """Distinct windows of one length, in order of their buckets."""

    length: int
    shift: np.ndarray  # by the low bits of a block's hash
    buckets: np.ndarray  # sorted hashes of last and first block
    first: np.ndarray  # windows of bucket i: first[i] to first[i + 1]
    start: np.ndarray  # of a window, in the words of the items
    item_first: np.ndarray  # items of window i: items[item_first[i] : item_first[i + 1]]
    items: np.ndarray

    @classmethod
    def build(cls, length: int, words: Words, other: np.ndarray, start: np.ndarray, items: np.ndarray) -> Patterns:
        """start, items: of all windows; other: second hashes of the words, which tell windows apart as well."""
        own, check = gram_hashes(words.hashes, length)[start], gram_hashes(other, length)[start]
        blocks = gram_hashes(words.hashes, block_of(length))
        bucket = both_ends(blocks[start + length - block_of(length)], blocks[start])
        order = np.lexsort((items, check, own, bucket))
        own, check, bucket, start, items = own[order], check[order], bucket[order], start[order], items[order]
        fresh = np.append(True, (own[1:] != own[:-1]) | (check[1:] != check[:-1]))
        twice = np.append(False, ~fresh[1:] & (items[1:] == items[:-1]))
        shift = np.full(1 << max(10, (2 * len(start)).bit_length()), length - block_of(length) + 1, np.uint8)
        for at in range(length - block_of(length) + 1):  # shifts fall as blocks come nearer to the window's end
            shift[(blocks[start + at] & np.uint64(len(shift) - 1)).astype(np.int64)] = length - block_of(length) - at
        keys, first = np.unique(bucket[fresh], return_index=True)
        number = np.cumsum(fresh)[~twice] - 1
        return cls(length, shift, keys, np.append(first, fresh.sum()), start[fresh].astype(np.int32), np.searchsorted(number, np.arange(fresh.sum() + 1)), items[~twice].astype(np.int32))

    def search(self, words: Words, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and window numbers of all occurrences within a text; data, starts, ends: of the items' words."""
        m, first = self.length, words.first
        begin, end = first[:-1] + m - 1, first[1:]
        begin, end = begin[begin < end], end[begin < end]
        parts = (end - begin + STRETCH - 1) // STRETCH
        stop = np.repeat(end, parts)
        at = np.repeat(begin, parts) + STRETCH * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        stop = np.minimum(stop, at + STRETCH)
        blocks, found = gram_hashes(words.hashes, block_of(m)), []
        mask = np.uint64(len(self.shift) - 1)
        while len(at):
            jump = self.shift[(blocks[at - block_of(m) + 1] & mask).astype(np.int64)]
            if (jump == 0).any():
                found.append(at[jump == 0] - m + 1)
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        place = np.concatenate([*found, np.zeros(0, np.int64)])
        key = both_ends(blocks[place + m - block_of(m)], blocks[place])
        bucket = np.minimum(np.searchsorted(self.buckets, key), len(self.buckets) - 1)
        place, bucket = place[self.buckets[bucket] == key], bucket[self.buckets[bucket] == key]
        n = self.first[bucket + 1] - self.first[bucket]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for cut in np.split(np.arange(len(place)), np.searchsorted(np.cumsum(n), np.arange(COMPARED, n.sum() if len(n) else 0, COMPARED))):
            k = n[cut]
            which = np.repeat(self.first[bucket[cut]] - np.cumsum(k) + k, k) + np.arange(k.sum())
            where = np.repeat(place[cut], k)
            same = equal_words(words, where, data, starts, ends, self.start[which], m)
            out.append((where[same], which[same]))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def block_of(length: int) -> int:
    return min(2, length)


def both_ends(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mix(last + (first << np.uint64(1)))


def equal_words(words: Words, at: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words from each place are, byte by byte, those of the items from each start."""
    a, b = (x[:, None] + np.arange(m) for x in (at, start))
    size = words.ends[a] - words.starts[a]
    same = (size == ends[b] - starts[b]).all(1)
    a, b, size = a[same], b[same], size[same]
    if not len(a):
        return same
    each = size.ravel()
    step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    differ = words.data[np.repeat(words.starts[a].ravel(), each) + step] != data[np.repeat(starts[b].ravel(), each) + step]
    whole = size.sum(1)
    same[same] = ~np.logical_or.reduceat(differ, np.cumsum(whole) - whole)
    return same


def build_patterns(texts: pa.Array, window: int) -> tuple:
    """(bytes, starts and ends of the items' words, Patterns of each length as plain tuples); item numbers are positions in texts."""
    words = find_words(texts, ALNUM)
    other, n = span_hashes(words.data, words.starts, words.ends, 0x5EC0), words.counts
    lengths = np.minimum(n, window)
    patterns = []
    for m in np.unique(lengths[lengths > 0]).tolist():
        own = np.flatnonzero(lengths == m)
        k = n[own] - m + 1
        start = np.repeat(words.first[own] - np.cumsum(k) + k, k) + np.arange(k.sum())
        patterns.append(tuple(vars(Patterns.build(m, words, other, start, np.repeat(own, k))).values()))
    return words.data, words.starts.astype(np.int32), words.ends.astype(np.int32), patterns


def _scan(table, blocks: int, number: int):
    """Rows (doc_id, text, any others) and what is found in them; of one block among several places and items instead of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (data, starts, ends, patterns), ids = table.value
        patterns = [Patterns(*x) for x in patterns]
        for batch in batches:
            for a, b in sliced(batch.column(1)):
                words = find_words(batch.column(1).slice(a, b - a), ALNUM)
                places, lengths, docs, items = [], [], [], []
                for p in patterns:
                    at, which = p.search(words, data, starts, ends)
                    places.append(at)
                    lengths.append(np.full(len(at), p.length))
                    n = p.item_first[which + 1] - p.item_first[which]
                    docs.append(np.repeat(np.searchsorted(words.first, at, "right") - 1, n))
                    items.append(p.items[np.repeat(p.item_first[which] - np.cumsum(n) + n, n) + np.arange(n.sum())])
                empty = [np.zeros(0, np.int64)]
                hit = covered(np.concatenate(places + empty), np.concatenate(lengths + empty), len(words.hashes))
                pairs = np.unique(np.concatenate(docs + empty) * (len(ids) + 1) + np.concatenate(items + empty))
                own: dict[int, set[str]] = {}
                for i, x in zip((pairs // (len(ids) + 1)).tolist(), (pairs % (len(ids) + 1)).tolist()):
                    own.setdefault(i, set()).add(ids[x])
                n_hit = sums(hit, words.first)
                doc = batch.column(0).slice(a, b - a).cast(pa.int64())
                rest = [batch.column(i).slice(a, b - a) for i in range(2, batch.num_columns)]
                names = [batch.schema.names[i] for i in range(2, batch.num_columns)]
                if blocks == 1:
                    named = [sorted(own.get(i, ())) for i in range(len(words))]
                    digests = pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() if x else NO_ITEMS for x in named], pa.string())
                    found = [pa.array(n_hit), pa.array([len(x) for x in named], pa.int64()), digests, pa.array(n_hit > 0)]
                    yield pa.RecordBatch.from_arrays([doc, pa.array(words.counts), *found, *rest], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *names])
                    continue
                place = np.flatnonzero(hit)
                at = np.searchsorted(place, words.first)
                place = (place - np.repeat(words.first[:-1], np.diff(at))).astype(np.int32)
                full = [
                    doc, pa.array(signed(sequence_hashes(words.hashes, words.first))), pa.array(words.counts),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(place)), pa.array([sorted(own.get(i, ())) for i in range(len(words))], pa.list_(pa.string())),
                ]
                out = pa.RecordBatch.from_arrays([*full, *rest], ["doc_id", "key", "n_words", "places", "items", *names])
                yield out if number == 0 else out.filter(pa.array(n_hit > 0))

    return run


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
SCANNED = "doc_id long, key long, n_words long, places array<int>, items array<string>"


def _united(scans: list[DataFrame], kept: list[str]) -> DataFrame:
    """The first block's rows, of which there is one for each document, with what the others found."""
    same = ["doc_id", "key", "check"]
    more = scans[1]
    for scan in scans[2:]:
        more = more.unionAll(scan)
    # sets: repeated rows bring the same places, which are merged before the shuffle
    more = more.groupBy(*same).agg(F.flatten(F.collect_set("places")).alias("more_places"), F.flatten(F.collect_set("items")).alias("more_items")).withColumnsRenamed({c: f"_{c}" for c in same})
    all_of = lambda c, kind: F.array_distinct(F.concat(c, F.coalesce(f"more_{c}", F.array().cast(f"array<{kind}>"))))
    whole = scans[0].join(more, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("key") == F.col("_key")) & F.col("check").eqNullSafe(F.col("_check")), "left")
    n_hit, items = F.size(all_of("places", "int")).cast("long"), F.array_sort(all_of("items", "string"))
    return whole.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *kept)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, row: Column | None = None) -> DataFrame:
    """Which words of each text stand in a window of any benchmark item, and of which items.

    Takes doc_id and text of docs, item_id and text of benchmark; other columns are ignored. Returns a row per row of
    docs (repeated rows too): doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted item_ids, comma-joined; of
    the empty string if there are none), contaminated, and `row`, a column of docs, if it is given. Null and empty texts
    have no words. Items with a null item_id or no words have no windows; an item_id that comes with several texts counts
    once. Empty tables give no rows, or rows without hits. At most block_bytes of item text are broadcast at a time: a
    larger benchmark is searched in blocks and the findings of a document are united.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *([row.alias("row")] if row is not None else []))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    kept = ["row"] if row is not None else []
    if blocks > 1:
        narrow = narrow.withColumn("check", F.xxhash64("text"))
    scans = []
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).toArrow()
        table = spark.sparkContext.broadcast((build_patterns(own.column("text").combine_chunks(), window), own.column("id").to_pylist()))
        texts = narrow if k == 0 else narrow.drop("row")
        scans.append(texts.mapInArrow(_scan(table, blocks, k), with_rest("doc_id long, " + FOUND if blocks == 1 else SCANNED, texts)))
    return scans[0] if blocks == 1 else _united(scans, kept)
