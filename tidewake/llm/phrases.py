"""Phrase collocations: suffix automata of shards count phrases, counts are reduced globally, cuts are scored exactly.

A shard is some megabytes of texts. Its generalised suffix automaton, cut off at a bounded depth, is held as arrays: the
states are the classes of substrings that end at the same places (endpos), found by refining the classes of one depth by
the word in front; a class's suffix link is the class that it refines, its endpos count the number of places. (That is the
automaton's link tree built depth by depth with sorts in numpy, not word by word; transitions aren't needed to enumerate.)

Counts of phrases that can't be frequent are never sent: a phrase occurs at most as often as any part of it. Words are
counted first, then pairs of frequent words, then triples of such pairs, by hashes; what is frequent becomes a bitmap of
fixed size, which may let others pass but never holds back a frequent one. What passes is then counted by its own words.

Nearly every task meets a frequent phrase and sends a count of it. A task for each split of the input would make that splits
times phrases, the square of the corpus; so from triples on there is a task a core, which adds up the counts of its splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import prepare, workspace, written
from .words import _GOLD, column_bytes, find_words, mix, sliced

_B = np.arange(256)
SEPARATOR = np.isin(_B, list(b".,;:!?\n\x0b\x0c\r"))
WORD = ~(SEPARATOR | np.isin(_B, list(b" \t")))
#: Bytes of text of a shard (or one longer text); its arrays take some thirty times as much.
SHARD = 1 << 20
#: Bits of the bitmaps, as a power of two: 8 MB each.
BITMAP = 26
#: Rows of a batch of counts, and bytes of counts that a task holds: they are added up then, and sent if more than half is left.
ROWS, HELD = 1 << 16, 32 << 20
_HALF, _LOW = np.uint64(32), np.uint64((1 << 32) - 1)
#: Salted groups that a language's best phrases are first taken from.
SALTS = 64


@dataclass
class Shard:
    """Words of a shard: their dense numbers (by language and word), pieces and languages."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word: np.ndarray  # number of the word at each place
    hashes: np.ndarray  # of each number's word and language
    run: np.ndarray  # words of the piece up to this place, itself included
    lang: np.ndarray  # of each place


def shard_of(langs: pa.Array, texts: pa.Array, kinds: np.ndarray) -> Shard:
    """kinds: a hash of each language, by the number in langs."""
    words = find_words(texts, WORD)
    row = np.repeat(np.arange(len(words)), words.counts)
    lang = langs.to_numpy(zero_copy_only=False)[row]
    cut = np.concatenate([[0], np.cumsum(SEPARATOR[words.data], dtype=np.int32)])[words.starts]
    place = np.arange(len(row))
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (cut[1:] != cut[:-1])
    run = place - np.maximum.accumulate(np.where(fresh, place, 0)) + 1 if len(row) else place
    hashes, number = np.unique(mix(words.hashes ^ kinds[lang]), return_inverse=True)
    return Shard(words.data, words.starts, words.ends, number, hashes, run, lang)


def refined(state: np.ndarray, ends: np.ndarray, front: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States one word deeper at the places `ends`: their numbers there, endpos counts and a place of each.

    state: of each of those places, the shallower state (the suffix link); front: the word in front of it; size: of words.
    """
    _, at, number, n = np.unique(state.astype(np.int64) * size + front, return_index=True, return_inverse=True, return_counts=True)
    return number, n, ends[at]


def passing(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bitmap has each hash's bit: its first bits name a word of 64 bits, six more the bit."""
    return (bitmap[hashes >> np.uint64(70 - BITMAP)] >> (hashes >> np.uint64(32) & np.uint64(63))) & np.uint64(1) > 0


def phrase_hashes(shard: Shard, ends: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the last `depth` words up to each of these places."""
    total = shard.hashes[shard.word[ends]]
    for k in range(1, depth):
        total = mix(total * _GOLD + shard.hashes[shard.word[ends - k]])
    return total


def enumerated(shard: Shard, bitmaps: list[np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, a place of each state, endpos counts) of the automaton's states that pass the bitmaps, one for each of the first depths.

    A phrase is looked at where both the one without its last and the one without its first word passed.
    """
    ends, state = np.arange(len(shard.word)), shard.word
    good = np.ones(len(shard.word), bool)
    n = np.bincount(state, minlength=len(shard.hashes))
    at = np.empty(len(shard.hashes), np.int64)
    at[state] = ends
    for depth in range(1, longest + 1):
        if depth > 1:
            deep = (shard.run[ends] >= depth) & good[ends - 1]
            ends, state = ends[deep], state[deep]
            state, n, at = refined(state, ends, shard.word[ends - depth + 1], len(shard.hashes))
        if depth <= len(bitmaps):
            passed = passing(bitmaps[depth - 1], phrase_hashes(shard, at, depth))
            here = passed[state]
            ends, state = ends[here], state[here]
            yield depth, at[passed], n[passed]
        else:
            yield depth, at, n
        good = np.zeros(len(shard.word), bool)
        good[ends] = True


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, list]]:
    """Shards of rows (lang, text), with the names of their languages: as many batches as have SHARD bytes, cut where they have more."""

    def made(held: list[pa.RecordBatch]) -> Iterator[tuple[Shard, list]]:
        whole = pa.Table.from_batches(held).combine_chunks()
        langs, texts = (whole.column(k).combine_chunks() for k in range(2))
        for a, b in sliced(texts, SHARD):
            named = langs.slice(a, b - a).dictionary_encode()
            names = named.dictionary.to_pylist()
            kinds = find_words(pa.array(["=" + x for x in names]), np.ones(256, bool), lower=False).hashes
            yield shard_of(named.indices, texts.slice(a, b - a), kinds), names

    held, size = [], 0
    for batch in batches:
        more = len(column_bytes(batch.column(1))[0])
        if held and size + more > SHARD:
            yield from made(held)
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield from made(held)


def added_up(counts: Iterator, total: Callable[[list], pa.Table | np.ndarray]) -> Iterator:
    """Tables or arrays of counts, as few as HELD bytes allow; total adds up a list of them, which it may empty."""
    held, size = [], 0
    for part in counts:
        held.append(part)
        size += part.nbytes
        del part
        if size > HELD:
            held = [total(held)]
            size = held[0].nbytes
            if size > HELD // 2:
                yield held.pop()
                size = 0
    if held:
        yield total(held)


def phrase_sums(held: list[pa.Table]) -> pa.Table:
    """Tables (lang, phrase, n) with the n of like phrases added up."""
    sums = pa.concat_tables(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
    held.clear()
    pa.default_memory_pool().release_unused()  # else the worker keeps it, also for the steps after this one
    return sums.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])


def packed(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes' upper 32 bits with counts below them. 2^32 - 1 stands for all counts from there on: only `least` is asked for."""
    return hashes & ~_LOW | np.minimum(n.astype(np.uint64), _LOW)


def hash_sums(held: list[np.ndarray]) -> np.ndarray:
    """Packed counts with those of like hashes added up, in order: in place, as a table of groups would need several times the room."""
    every = np.concatenate(held)
    held.clear()
    every.sort()
    size = 0
    for k in range(0, len(every), ROWS):
        part = every[k : k + ROWS]
        key = part >> _HALF
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.add.reduceat(part & _LOW, first)
        if size and every[size - 1] >> _HALF == key[0]:
            size -= 1
            n[0] += every[size] & _LOW
        every[size : size + len(first)] = packed(part[first], n)
        size += len(first)
    return every[:size].copy()


def _hash_counts(bitmaps, depth: int):
    """Rows (lang, text) to counts of phrases of so many words by hash (32 bits: like ones pass the bitmap together), exact below 2^32 - 1."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for shard, _ in _shards(batches):
            *_, (_, at, n) = enumerated(shard, [b.value for b in bitmaps], depth)
            yield packed(phrase_hashes(shard, at, depth), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sums in added_up(found(batches), hash_sums):
            for k in range(0, len(sums), ROWS):
                part = sums[k : k + ROWS]
                hashes = (part >> _HALF).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_pydict({"hash": hashes, "n": (part & _LOW).view(np.int64)})

    return run


def phrase_texts(shard: Shard, ends: np.ndarray, depth: int) -> pa.Array:
    """The last `depth` words up to each of these places, joined by spaces."""
    at = (ends[:, None] - np.arange(depth - 1, -1, -1)).ravel()
    space = np.arange(len(at)) % depth < depth - 1
    size = shard.ends[at] - shard.starts[at] + space
    stop = np.cumsum(size)
    data = shard.data[np.arange(size.sum()) + np.repeat(shard.starts[at] - stop + size, size)]
    data[stop[space] - 1] = 32
    return pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(np.append(0, stop[depth - 1 :: depth]).astype(np.int32)), pa.py_buffer(data)])


def _phrase_counts(bitmaps, longest: int):
    """Rows (lang, text) to counts of phrases, those of a task's shards added up; the empty phrase counts all words of its language."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for shard, names in _shards(batches):
            named = pa.array(names, pa.string())
            yield pa.table({"lang": named, "phrase": pa.array([""] * len(names), pa.string()), "n": np.bincount(shard.lang, minlength=len(names))})
            for depth, at, n in enumerated(shard, [b.value for b in bitmaps], longest):
                for k in range(0, len(at), ROWS):
                    part = at[k : k + ROWS]
                    yield pa.table({"lang": named.take(pa.array(shard.lang[part])), "phrase": phrase_texts(shard, part, depth), "n": n[k : k + ROWS]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sums in added_up(found(batches), phrase_sums):
            yield from sums.to_batches(ROWS)

    return run


def bitmap(counts: DataFrame, least: int) -> np.ndarray:
    """The bitmap of hashes that occur so often; put together on Spark, so no more than its words reach the driver."""
    frequent = counts.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    cells = frequent.groupBy(F.shiftrightunsigned("hash", 38 - BITMAP).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, hash & 63))").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return out


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, filters: int = 3) -> DataFrame:
    """(lang, phrase, n) of all phrases up to `longest` words that occur `least` times or more, and n of the empty one: all words.

    filters: depths that are counted by hash before, each by its own pass over the texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    few = rows.coalesce(spark.sparkContext.defaultParallelism)
    bitmaps = []
    for depth in range(1, min(filters, longest) + 1):
        counts = (few if depth > 2 else rows).mapInArrow(_hash_counts(tuple(bitmaps), depth), "hash int, n long")
        if depth <= 2:  # a split's counts are added up already: the JVM needn't hold them to do so again before the shuffle
            counts = counts.repartition("hash")
        bitmaps.append(spark.sparkContext.broadcast(bitmap(counts, min(least, int(_LOW)))))
    found = few.mapInArrow(_phrase_counts(bitmaps, longest), "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def cut_score() -> Column:
    """floor(1000 a every / (l r)), in decimals of 38 digits: exact up to 10^15 words and for every count among them."""
    return F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(16, 0)) * cast(every as decimal(16, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, best: int = 2000) -> DataFrame:
    """Each language's best phrases: those that occur far more often than their parts by themselves would meet.

    Takes text and lang (null: `und`); other columns play no part. Texts are lower-cased (A-Z) and split at `.,;:!?` and
    line ends into pieces, those at spaces and tabs into words. A phrase of 2 to `longest` words that occurs a >= least
    times scores floor(1000 a n / (l r)) at the cut of its words that makes this least (of like ones the earliest), where l
    and r count both parts and n all words of the language. A phrase within a longer one that occurs as often is dropped.
    Returns lang, rank, phrase, a, l, r, n, score; ranks go by score, a, both descending, and phrase. Null and empty texts
    have no words, repeated rows count as often as they come, an empty table gives no rows. All counts are exact.
    """
    spark = docs.sparkSession
    prepare(spark)
    counts = written(phrase_counts(docs, least, longest), f"{workspace(spark)}/counts")
    known, every = counts.where("phrase != ''"), counts.where("phrase = ''").select("lang", F.col("n").alias("every"))
    split = known.withColumn("w", F.split("phrase", " ")).where("size(w) > 1")
    # a one word shorter part that occurs as often: the longer phrase's suffix link, or the same in front
    parts = split.where("size(w) > 2").select("lang", "n", F.explode(F.array(F.slice("w", 1, F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1))).alias("part"))
    within = parts.groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("n").alias("longer"))
    left = split.join(within, ["lang", "phrase"], "left").where("longer is null or longer < n")
    cuts = left.select("lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    part = lambda p, n: known.select("lang", F.col("phrase").alias(p), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(every, "lang")
    cuts = cuts.withColumn("score", cut_score())
    lowest = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("score", "a", "l", "r", F.col("every").alias("n")), F.struct("score", "k")).alias("c")).select("lang", "phrase", "c.*")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    lowest = lowest.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = lowest.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_k") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
