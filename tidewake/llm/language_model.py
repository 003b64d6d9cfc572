"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability given its history is that of its class given the history, times that of the token in its class
given the history. Tokens are ranked by frequency; class k holds the ranks from 2^k on, the last class all tokens that
aren't in the broadcast table, by the bits of their hashes. Each softmax is a tree of two-way choices (over classes a
Huffman tree, within a class the bits of rank or hash), so it is normalised at the cost of the choices of one token. A
choice's log-odds are those of the unigram rates plus three hashed weights: of the choice with the last token, with the
one before it (a skip feature) and with both.

The weights are trained by distributed gradient updates: each round all tasks sum, for each weight, how often its choice
went right and how often the model expected it to; the difference of the two is the gradient. A weight moves by the log of
their ratio (iterative scaling), so what it learns depends neither on how the corpus is split nor on its size. What lies
below the choices, a token's share of its last set, is its smoothed unigram rate: a text's log-probability is its unigram
score plus what the history adds to each choice.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import most_frequent, prepare, workspace, written
from .words import Words, find_words, mix, sequence_hashes, signed, sliced

#: Hash of the token that ends each text; words are hashed by other means.
END = 0x5EED0FE4D
#: Tokens of the broadcast table (some 30 bytes each), and tokens that a task counts before it passes counts on.
TOP, LOAD = 1 << 20, 4_000_000
#: Bits of a hash that choose among the tokens beyond the table.
OTHER_BITS = 12
#: The weight table has 2^20 weights up to 2^27 training tokens, twice as many for four times the tokens, and at most 2^24,
#: which bounds the memory of a task.
LEAST_BITS, MOST_BITS, TOKENS_BITS = 20, 24, 27
#: Counts that both sides of a weight's ratio get, so that a weight seen once moves little.
DAMP = 1.0
BATCH, ROUNDS, CHUNKS, TREE = 1 << 16, 2, 64, 64
FEATURES = 3
_ODD, _STEP = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1)


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's words and then its end, and the bounds of the texts."""
    n = len(words)
    out = np.full(len(words.hashes) + n, END, np.uint64)
    out[np.arange(len(words.hashes)) + np.repeat(np.arange(n), words.counts)] = words.hashes
    return out, words.first + np.arange(n + 1)


def histories(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Three feature hashes (of 32 bits) for each token, by the two tokens before it in its text."""
    last, skip = np.zeros(len(token), np.uint64), np.zeros(len(token), np.uint64)
    last[1:], skip[2:] = token[:-1], token[:-2]
    last[bounds[:-1]] = skip[bounds[:-1]] = 1
    second = bounds[:-1] + 1
    skip[second[second < bounds[1:]]] = 1
    one, two = mix(last ^ np.uint64(0xA1)), mix(skip ^ np.uint64(0xB2))
    return np.stack([(x >> np.uint64(32)).astype(np.uint32) for x in (one, two, mix(one + (two << np.uint64(1))))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(n)], ["token", "n"])

    for batch in batches:
        for a, b in sliced(batch.column(0)):
            held.append(tokens(find_words(batch.column(0).slice(a, b - a)))[0])
            size += len(held[-1])
        if size > LOAD:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


def _log_odds(mass: np.ndarray) -> np.ndarray:
    """Of a complete tree over masses (2^k of them), the log-odds of the right half at each inner node, from the root on."""
    out = []
    while len(mass) > 1:
        out.append(np.log(mass[1::2] + 1e-9) - np.log(mass[::2] + 1e-9))
        mass = mass[::2] + mass[1::2]
    return np.concatenate(out[::-1] + [np.zeros(0)])


def huffman(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and bits on the way to each class (rows padded with 0), its length, and the log-odds of each node's bit 1."""
    heap = [(float(m), i, [i]) for i, m in enumerate(mass)]
    heapq.heapify(heap)
    ways: list[list[tuple[int, int]]] = [[] for _ in mass]
    odds: list[float] = []
    while len(heap) > 1:
        (a, _, left), (b, i, right) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in enumerate((left, right)):
            for c in side:
                ways[c].append((len(odds), bit))
        odds.append(float(np.log(b + 1e-9) - np.log(a + 1e-9)))
        heapq.heappush(heap, (a + b, i + len(mass), left + right))
    length = np.array([len(w) for w in ways], np.int64)
    nodes, bits = np.zeros((len(mass), max(1, length.max())), np.int64), np.zeros((len(mass), max(1, length.max())), np.int64)
    for c, way in enumerate(ways):
        for d, (node, bit) in enumerate(reversed(way)):
            nodes[c, d], bits[c, d] = node, bit
    return nodes, bits, length, np.array(odds + [0.0])


def vocabulary(token: np.ndarray, n: np.ndarray, others: np.ndarray, total: float) -> tuple:
    """What the tasks need of the unigram model, as plain arrays.

    token, n: the table; others: masses of the other tokens by the first bits of their hashes; total: the mass of all.
    """
    order = np.lexsort((token, -n))
    token, n = token[order], n[order]
    levels = len(token).bit_length()
    mass = np.zeros(1 << levels)
    mass[1 : len(n) + 1] = n + 0.1
    classes = [mass[1 << k : 2 << k] for k in range(levels)] + [others]
    # inner nodes of class k are numbered from 2^k, those of the last class and of the classes' tree after all others
    odds = np.zeros((1 << levels) + len(others))
    for k, own in enumerate(classes):
        of = _log_odds(own)
        odds[1 << k : (1 << k) + len(of)] = of
    nodes, bits, length, top = huffman(np.array([c.sum() for c in classes]))
    order = np.argsort(token)
    return token[order], (order + 1).astype(np.int32), n[order], total, levels, nodes + len(odds), bits, length, np.concatenate([odds, top]).astype(np.float32)


class Table:
    """The vocabulary in a task, with an index by the first bits of the hashes."""

    def __init__(self, v: tuple):
        self.token, self.rank, self.n, self.total, self.levels, self.nodes, self.bits, self.length, self.odds = v
        self.shift = np.uint64(63 - max(1, len(self.token).bit_length()))
        bucket = (self.token >> self.shift).astype(np.int64)
        self.first = np.append(0, np.cumsum(np.bincount(bucket, minlength=1 << (64 - int(self.shift))))).astype(np.int32)
        self.fullest = int(np.diff(self.first).max())
        #: What a choice costs by the unigram rates alone: of the left side (bit 0), then of the right.
        self.loss = np.logaddexp(0, np.stack([self.odds, -self.odds]))

    def look_up(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ranks of tokens, both 0 for those that aren't in the table."""
        n, rank = np.zeros(len(token), np.int64), np.zeros(len(token), np.int64)
        bucket = (token >> self.shift).astype(np.int64)
        at, end, left = self.first[bucket], self.first[bucket + 1], np.arange(len(token))
        for _ in range(self.fullest):
            some = at < end
            if not some.all():
                at, end, left = at[some], end[some], left[some]
            hit = self.token[at] == token[left]
            n[left[hit]], rank[left[hit]] = self.n[at[hit]], self.rank[at[hit]]
            at, end, left = at[~hit] + 1, end[~hit], left[~hit]
        return n, rank

    def choices(self, token: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray, np.ndarray]]:
        """First the order of the tokens for what follows; then step by step (which of the ordered tokens, node, bit) of a two-way choice."""
        code = np.where(rank > 0, rank, (token >> np.uint64(64 - OTHER_BITS)).astype(np.int64) | (1 << OTHER_BITS))
        depth = np.frexp(code)[1].astype(np.int64) - 1
        cls = np.where(rank > 0, depth, self.levels)
        order = np.argsort(-depth, kind="stable")
        yield order
        code, depth, cls = code[order], depth[order], cls[order]
        base = (1 << cls) - 1
        for j, m in enumerate(np.searchsorted(-depth, -np.arange(int(depth.max(initial=0))), "left").tolist()):
            after = code[:m] >> (depth[:m] - j - 1)
            yield slice(0, m), base[:m] + (after >> 1), after & 1
        length = self.length[cls]
        for j in range(self.nodes.shape[1]):
            some = np.flatnonzero(length > j)
            if len(some) == len(cls):  # a slice spares copies
                yield slice(0, len(cls)), self.nodes[:, j][cls], self.bits[:, j][cls]
            elif len(some):
                own = cls[some]
                yield some, self.nodes[:, j][own], self.bits[:, j][own]


def slots(features: np.ndarray, node: np.ndarray, weight_bits: int) -> np.ndarray:
    """Three places in the weight table for each choice."""
    place = features.astype(np.uint32, copy=False) ^ (node.astype(np.uint32) * _STEP)
    place *= _ODD
    place >>= np.uint32(32 - weight_bits)
    return place.astype(np.int64)


def _gather(model, first_round: bool):
    """Sums over a task's texts for each weight: of what is expected of its choices, in the first round also how many there are and go right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, weights, weight_bits = model.value
        table = Table(v)
        size = 1 << weight_bits
        # one array takes both sums: real parts what is expected, imaginary ones the number of choices and 2^26 for each that goes right
        sums = np.zeros(size, np.complex128 if first_round else np.float64)
        right, n = np.zeros((2, size if first_round else 0))
        for batch in batches:
            for a, b in sliced(batch.column(0)):
                token, bounds = tokens(find_words(batch.column(0).slice(a, b - a)))
                rank, features = table.look_up(token)[1], histories(token, bounds)
                for at in range(0, len(token), BATCH):
                    cut = slice(at, at + BATCH)
                    steps = table.choices(token[cut], rank[cut])
                    own = features[:, cut][:, next(steps)]
                    for which, node, bit in steps:
                        place, x = slots(own[:, which], node, weight_bits), table.odds[node]
                        if weights is not None:
                            x = x + weights[place[0]] + weights[place[1]] + weights[place[2]]
                        p = (1 / (1 + np.exp(-x))).astype(np.float64)
                        if first_round:
                            p = p + 1j * (1.0 + bit * float(1 << 26))
                        for k in range(FEATURES):
                            np.add.at(sums, place[k], p)
                if first_round:  # a slice has too few choices to reach 2^26
                    more = np.flatnonzero(sums.imag)
                    right[more] += sums.imag[more] // (1 << 26)
                    n[more] += sums.imag[more] % (1 << 26)
                    sums.imag[more] = 0
        expected = sums.real
        total = np.stack([expected, right, n] if first_round else [expected]).astype(np.float32)
        group = TaskContext.get().partitionId() // TREE
        parts = [np.ascontiguousarray(c).tobytes() for c in np.split(total, CHUNKS, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([group] * CHUNKS, pa.int32()), pa.array(parts, pa.binary())], ["chunk", "part", "total"])

    return run


TOTAL = "chunk int, part int, total binary"


def _sum(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(group["total"].iloc[0]) // 4)
    for c in group["total"]:
        total += np.frombuffer(c, np.float32)
    return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "part": [group["part"].iloc[0]], "total": [total.astype(np.float32).tobytes()]})


def _sums(texts: DataFrame, v: tuple, weights: np.ndarray | None, weight_bits: int) -> np.ndarray:
    """The sums of _gather over all texts, added up as a tree: no group has more than TREE parts of a chunk."""
    model = texts.sparkSession.sparkContext.broadcast((v, weights, weight_bits))
    sums, parts = texts.mapInArrow(_gather(model, weights is None), TOTAL), texts.rdd.getNumPartitions()
    while True:
        sums, parts = sums.groupBy("chunk", "part").applyInPandas(_sum, TOTAL), -(-parts // TREE)
        if parts <= 1:
            break
        sums = sums.withColumn("part", F.floor(F.col("part") / TREE).cast("int"))
    found = {r.chunk: np.frombuffer(r.total, np.float32) for r in sums.collect()}
    model.unpersist()
    rows = 3 if weights is None else 1
    return np.concatenate([found[k].reshape(rows, -1) for k in range(CHUNKS)], 1).astype(float) if found else np.zeros((rows, 1 << weight_bits))


def train(texts: DataFrame, v: tuple, rounds: int, weight_bits: int) -> np.ndarray:
    """The weight table after some rounds over all texts.

    Each choice has three weights, so a round adds a third of the log-ratio of what went right to what was expected, less
    that of what went left. A weight that no choice has stays 0.
    """
    weights = np.zeros(1 << weight_bits)
    for k in range(rounds):
        if k == 0:
            expected, right, n = _sums(texts, v, None, weight_bits)
        else:
            expected = _sums(texts, v, weights.astype(np.float32), weight_bits)[0]
        up, down = (right + DAMP) / (expected + DAMP), (np.maximum(n - right, 0) + DAMP) / (np.maximum(n - expected, 0) + DAMP)
        weights += np.log(up / down) / FEATURES
    return weights.astype(np.float32)


def gains(table: Table, weights: np.ndarray, weight_bits: int, token: np.ndarray, rank: np.ndarray, features: np.ndarray) -> np.ndarray:
    """What the history adds to the log-probability of each token."""
    out = np.zeros(len(token))
    for at in range(0, len(token), BATCH):
        cut = slice(at, at + BATCH)
        steps = table.choices(token[cut], rank[cut])
        order = next(steps)
        own, more = features[:, cut][:, order], np.zeros(len(order))
        for which, node, bit in steps:
            place = slots(own[:, which], node, weight_bits)
            x = table.odds[node] + weights[place[0]] + weights[place[1]] + weights[place[2]]
            np.negative(x, out=x, where=bit > 0)
            more[which] += table.loss[bit, node] - np.log(1 + np.exp(np.minimum(x, 80)))
        out[at + order] = more
    return out


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, weights, weight_bits = model.value
        table = Table(v)
        for batch in batches:
            for a, b in sliced(batch.column(2)):
                words = find_words(batch.column(2).slice(a, b - a))
                token, bounds = tokens(words)
                n, rank = table.look_up(token)
                gain = gains(table, weights, weight_bits, token, rank, histories(token, bounds))
                base = np.where(n > 0, np.log10((n + 0.1) / table.total), 0)
                add = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every text has at least its end
                # tokens beyond the table with their counts, text by text
                rare = np.flatnonzero(n == 0)
                owner = np.searchsorted(bounds, rare, "right") - 1
                order = np.lexsort((token[rare], owner))
                rare, owner = token[rare][order], owner[order]
                fresh = np.ones(len(rare), bool)
                fresh[1:] = (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1])
                start = np.flatnonzero(fresh)
                lists = pa.array(np.searchsorted(owner[start], np.arange(b - a + 1)).astype(np.int32))
                other = pa.ListArray.from_arrays(lists, pa.array(signed(rare[start])))
                counts = pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(start, len(rare)))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(signed(sequence_hashes(words.hashes, words.first))),
                        pa.array(np.diff(bounds)), pa.array(add((n > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(gain) / np.log(10)),
                        other, counts,
                    ],
                    [c.split()[0] for c in SCORED.split(", ")],
                )

    return run


SCORED = "doc_id long, held_out boolean, key long, n_tokens long, n_top long, base double, gain double, other array<long>, counts array<long>"


def score_texts(docs: DataFrame, folds: int = 10, held_out: int = 0, rounds: int = ROUNDS, top: int = TOP) -> DataFrame:
    """Log10 probability of each whole text under a model learned from texts whose crc32(doc_id) modulo folds isn't held_out.

    Reads doc_id and text, other columns are ignored. Tokens are runs of non-space characters, A-Z in lower case, and an
    end. Returns a row per input row (repeated rows too): doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (smoothed unigrams), score (the model's). Null and empty texts are an end alone. Rows with a null doc_id are scored as
    held out. Without training texts both scores are those of a uniform vocabulary of one. An empty table gives no rows.
    Counts cover all training texts; at most `top` tokens are broadcast, and the counts of the others are joined.
    """
    spark = docs.sparkSession
    prepare(spark)
    home = workspace(spark)
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held_out, F.lit(True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", fold)
    texts = docs.where("not held_out").select("text")
    counts = written(texts.mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), f"{home}/counts")
    train_tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = train_tokens + 0.1 * (distinct + 1)
    table = written(most_frequent(counts, top), f"{home}/table")
    rows = table.toArrow()
    token, n = rows.column("token").to_numpy().astype(np.int64).view(np.uint64), rows.column("n").to_numpy().astype(np.int64)
    # masses of all tokens by the first bits of their hashes, less those of the table, and the share of unseen ones
    others = np.full(1 << OTHER_BITS, 0.1 / (1 << OTHER_BITS))
    for r in counts.groupBy(F.shiftrightunsigned("token", 64 - OTHER_BITS).alias("bits")).agg(F.sum(F.col("n") + 0.1).alias("mass")).collect():
        others[r.bits] += r.mass
    others = np.maximum(others - np.bincount((token >> np.uint64(64 - OTHER_BITS)).astype(np.int64), n + 0.1, 1 << OTHER_BITS), 1e-6)
    v = vocabulary(token, n, others, total)
    weight_bits = min(MOST_BITS, LEAST_BITS + max(0, train_tokens.bit_length() - TOKENS_BITS + 1) // 2)
    # a task reads some times the bytes that it sends: partitions grow with the weight table
    partitions = texts.rdd.getNumPartitions() >> (weight_bits - LEAST_BITS)
    weights = train(texts.coalesce(max(1, partitions)) if weight_bits > LEAST_BITS else texts, v, rounds, weight_bits)
    scored = docs.select("doc_id", "held_out", "text").mapInArrow(_score(spark.sparkContext.broadcast((v, weights, weight_bits))), SCORED)
    scored = written(scored.withColumn("row", F.xxhash64("doc_id", "key")), f"{home}/scored")
    # tokens beyond the table: repeated rows bring theirs several times, so sums are divided by how often a row came
    other = scored.select("row", F.inline(F.arrays_zip("other", "counts")).alias("token", "m"))
    rate = lambda n: F.log10((F.coalesce(n, F.lit(0)) + F.lit(0.1)) / F.lit(float(total)))
    other = other.join(counts, "token", "left").groupBy("row").agg(F.sum(F.col("m") * rate(F.col("n"))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("known"))
    times = F.count("*").over(Window.partitionBy("row"))
    whole = scored.withColumn("times", times).join(other, "row", "left")
    base = F.col("base") + F.coalesce(F.col("more") / F.col("times"), F.lit(0.0))
    known = F.col("n_top") + F.coalesce((F.col("known") / F.col("times")).cast("long"), F.lit(0).cast("long"))
    return whole.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))
