"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct words, hashed, each weighing one by the root of their number, and one level of each
statistic of its structure and of its numeric metadata. Every feature has a weight and a few factors; a pair of features
weighs the product of their factors. All pairs of a text are summed in linear time: half of the squared sum less the sum
of squares, factor by factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import labelled_sample, prepare
from .words import NOT_SPACE, find_words, sliced

#: Hashed words, as a power of two; levels of each statistic; factors of each feature.
BITS, LEVELS, FACTORS = 18, 24, 8
#: Bytes of text handled at once.
SLICE = 2 << 20
#: Labelled rows that are fitted on at most (those of the lowest hashes), tasks that read them, texts that must have a feature.
SAMPLE, TASKS, LEAST_TEXTS = 12_000, 8, 4

_B = np.arange(256)
#: Kinds of bytes whose shares of a text are statistics.
SHARES = {
    "symbols": np.isin(_B, list(b"#*$%&|<>")), "stops": np.isin(_B, list(b".,;:!?")), "capitals": (_B >= 65) & (_B <= 90), "digits": (_B >= 48) & (_B <= 57),
    "spaces": ~NOT_SPACE, "line ends": _B == 10, "beyond ASCII": _B >= 128, "shouts": _B == 33,
}
STATISTICS = (*SHARES, "bytes", "words", "word length", "distinct words", "repeated lines", "words a line")


@dataclass
class Features:
    """Features of a few texts: text i has those from first[i] to first[i + 1]."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _distinct(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each of n rows."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return np.bincount(row[fresh], minlength=n)


def _log_level(values: np.ndarray) -> np.ndarray:
    """A level for each octave; 0 for 0 and less, or what isn't known."""
    known = np.where(np.isfinite(values) & (values >= 1), values, 0.5)
    return np.clip(np.floor(np.log2(known)) + 1, 0, LEVELS - 1).astype(np.int64)


def _share_level(share: np.ndarray) -> np.ndarray:
    """Levels of shares from 0 to 1: 0 for none, then by half octaves, the last for all."""
    level = LEVELS - 1 + np.ceil(2 * np.log2(np.maximum(share, 1e-9)))
    return np.where(share > 0, np.clip(level, 1, LEVELS - 1), 0).astype(np.int64)


def features(texts: pa.Array, metadata: list[np.ndarray]) -> Features:
    """Word features and levels of all statistics of each text, then of each metadata column."""
    words = find_words(texts)
    n, sizes, raw = len(words), np.diff(words.offsets), find_words(texts, _B != 10, lower=False)
    row = np.repeat(np.arange(n), words.counts)
    index = (words.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    pair = np.unique((row << BITS) | index)
    owner, index = pair >> BITS, pair & ((1 << BITS) - 1)
    distinct = np.bincount(owner, minlength=n)
    held = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kind[raw.data])])[raw.offsets])
    some = np.maximum(sizes, 1)
    lines = np.repeat(np.arange(n), raw.counts)
    levels = [_share_level(held(kind) / some) for kind in SHARES.values()]
    letters = np.bincount(row, words.ends - words.starts, minlength=n)
    levels += [_log_level(sizes), _log_level(words.counts), _log_level(letters / np.maximum(words.counts, 1) * 2), _share_level(_distinct(row, words.hashes, n) / np.maximum(words.counts, 1))]
    levels += [_share_level((raw.counts - _distinct(lines, raw.hashes, n)) / np.maximum(raw.counts, 1)), _log_level(words.counts / np.maximum(raw.counts, 1))]
    levels += [_log_level(x) for x in metadata]
    own = np.stack([(1 << BITS) + k * LEVELS + level for k, level in enumerate(levels)], 1)
    # words and levels of each text side by side
    count = distinct + own.shape[1]
    first = np.concatenate([[0], np.cumsum(count)])
    at = first[owner] + np.arange(len(owner)) - np.concatenate([[0], np.cumsum(distinct)])[owner]
    tail = (first[:-1] + distinct)[:, None] + np.arange(own.shape[1])
    where, value = np.empty(first[-1], np.int64), np.ones(first[-1], np.float32)
    where[at], value[at] = index, 1 / np.sqrt(distinct[owner])
    where[tail] = own
    return Features(where, value, first)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # a row for each feature

    def margins(self, found: Features) -> np.ndarray:
        """Bias, weights, and half of (the squared sum less the sum of squares) of factors, for each text."""
        used = self.known(found)
        owner, index, value, n = found.owner[used], found.index[used], found.value[used], len(found.first) - 1
        total = self.bias + np.bincount(owner, self.weights[index] * value, minlength=n)
        for f in range(self.factors.shape[1]):
            part = self.factors[index, f] * value
            total += (np.bincount(owner, part, minlength=n) ** 2 - np.bincount(owner, part * part, minlength=n)) / 2
        return total

    def known(self, found: Features) -> np.ndarray:
        return self.weights[found.index] != 0


def size_of(n_metadata: int) -> int:
    return (1 << BITS) + (len(STATISTICS) + n_metadata) * LEVELS


def untrained(y: np.ndarray, size: int) -> Machine:
    """The bias alone, from the number of labels of both classes."""
    return Machine(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.zeros(size), np.zeros((size, FACTORS), np.float32))


def fit(found: Features, y: np.ndarray, size: int, least_texts: int = LEAST_TEXTS, rounds: int = 12, batch: int = 256, rate: float = 0.02, ridge: float = 1e-4) -> Machine:
    """Logistic loss by gradient steps with momentum over shuffled batches (Adam), from a fixed seed."""
    used, index, texts = np.unique(found.index, return_inverse=True, return_counts=True)
    chance, model = np.random.default_rng(1), untrained(y, size)
    if not (texts >= least_texts).any() or y.min() == y.max():
        return model
    k = len(used)
    theta = np.concatenate([np.zeros((k, 1)), chance.normal(0, 0.05, (k, FACTORS))], 1)
    keep = texts >= least_texts
    theta[~keep] = 0
    bias, speed, spread, step = model.bias, np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(rounds):
        for ids in np.array_split(chance.permutation(len(y)), max(1, -(-len(y) // batch))):
            n = np.diff(found.first)[ids]
            at = np.repeat(found.first[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            at, owner = at[keep[index[at]]], np.repeat(np.arange(len(ids)), n)[keep[index[at]]]
            own, value = index[at], found.value[at].astype(np.float64)
            part = theta[own] * value[:, None]
            begin = np.searchsorted(owner, np.arange(len(ids)))
            full = np.append(begin[1:], len(owner)) > begin
            sums, squares = np.zeros((len(ids), 1 + FACTORS)), np.zeros((len(ids), 1 + FACTORS))
            if len(owner):
                sums[full] = np.add.reduceat(part, begin[full], axis=0)
                squares[full] = np.add.reduceat(part * part, begin[full], axis=0)
            margin = bias + sums[:, 0] + (sums[:, 1:] ** 2 - squares[:, 1:]).sum(1) / 2
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[ids]) / len(ids)
            # a factor's slope is its feature's value times the sum of all others
            slope = sums[owner] - part
            slope[:, 0] = 1
            slope *= (error[owner] * value)[:, None]
            order = np.argsort(own, kind="stable")
            mine, edge = np.unique(own[order], return_index=True)
            g = np.add.reduceat(slope[order], edge, axis=0) + ridge * theta[mine]
            step += 1
            speed[mine] = 0.9 * speed[mine] + 0.1 * g
            spread[mine] = 0.99 * spread[mine] + 0.01 * g * g
            theta[mine] -= rate * (speed[mine] / (1 - 0.9**step)) / (np.sqrt(spread[mine] / (1 - 0.99**step)) + 1e-8)
            bias -= rate * error.sum()
    model.bias = float(bias)
    model.weights[used], model.factors[used] = theta[:, 0], theta[:, 1:]
    return model


def _featured(n_metadata: int):
    """Rows (label, text, metadata...) to (label, index, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in sliced(batch.column(1), SLICE):
                part = batch.slice(a, b - a)
                own = features(part.column(1), _numbers(part, 2, n_metadata))
                bounds = pa.array(own.first.astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(bounds, pa.array(own.index.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(own.value))], ["label", "index", "value"])

    return run


def _numbers(batch: pa.RecordBatch, at: int, n: int) -> list[np.ndarray]:
    return [batch.column(at + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(n)]


def train(texts: DataFrame, n_metadata: int, least_texts: int = LEAST_TEXTS) -> Machine:
    """texts: a bounded sample of rows (label, text, metadata...)."""
    rows = texts.repartition(TASKS).mapInArrow(_featured(n_metadata), "label int, index array<int>, value array<float>").toArrow()
    y, size = rows.column("label").to_numpy().astype(np.float64), size_of(n_metadata)
    if not len(y) or y.min() == y.max():
        return untrained(y, size)
    index, value = (rows.column(c).combine_chunks() for c in ("index", "value"))
    first = np.concatenate([[0], np.cumsum(index.value_lengths().to_numpy(zero_copy_only=False))])
    found = Features(index.flatten().to_numpy(zero_copy_only=False).astype(np.int64), value.flatten().to_numpy(zero_copy_only=False), first)
    return fit(found, y, size, least_texts)


def _score(model, n_metadata: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights, factors = model.value
        machine = Machine(bias, weights, factors)
        for batch in batches:
            for a, b in sliced(batch.column(2), SLICE):
                part = batch.slice(a, b - a)
                margin = machine.margins(features(part.column(2), _numbers(part, 3, n_metadata)))
                score = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata: tuple[str, ...] = (), folds: int = 4, held_out: int = 2, threshold: float = 0.7, sample: int = SAMPLE, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """Score each whole text; learn from labels of rows whose crc32(doc_id) modulo folds isn't held_out.

    Takes doc_id, text and the numeric columns `metadata` of docs, doc_id and `label` (0 or 1) of labels. Returns a row per
    row of docs (repeated rows too): doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from the
    threshold on). Null and empty texts have the statistics of an empty text, null metadata a level of its own; a null
    doc_id is scored and never learned from; contradictory labels count as 0. Without labels of both classes the score is
    the same for all. The fit sees at most `sample` labelled texts, chosen by hash of doc_id, and features that least_texts
    of them have.
    """
    spark = docs.sparkSession
    prepare(spark)
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held_out, F.lit(False))
    numbers = [F.col(f"`{c}`").cast("double").alias(f"m{k}") for k, c in enumerate(metadata)]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *numbers).withColumn("held_out", fold)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(~fold & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    known = labelled_sample(known.groupBy("doc_id").agg(F.min("label").alias("label")), sample)
    columns = [f"m{k}" for k in range(len(metadata))]
    machine = train(narrow.where("not held_out").join(F.broadcast(known), "doc_id").select("label", "text", *columns), len(metadata), least_texts)
    model = spark.sparkContext.broadcast((machine.bias, machine.weights.astype(np.float32), machine.factors.astype(np.float32)))
    return narrow.select("doc_id", "held_out", "text", *columns).mapInArrow(_score(model, len(metadata), threshold), "doc_id long, held_out boolean, score double, predicted int")
