"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams it contains, present or not. Over a bounded sample of labelled
texts, each feature gets r, the log of the ratio of its smoothed rates in toxic and other texts; a logistic regression
is then fitted on features scaled by r. All texts are scored whole, in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import labelled_sample, prepare
from .words import LOWER, column_bytes, sliced

ORDERS = (3, 4, 5, 6)
BITS = 20
#: Bytes of text whose n-grams are held at once: some 60 bytes for each.
SLICE = 1 << 20
#: Labelled rows that are fitted on at most (those of the lowest hashes), and tasks that read them.
SAMPLE, TASKS = 12_000, 8
#: Features kept for the regression (those whose scaled counts tell the classes apart best), the labelled texts that must
#: have one, and the least size of its r: n-grams as common in both classes say nothing.
FEATURES, LEAST_TEXTS, LEAST_R = 20_000, 4, 1.0


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, A-Z in lower case, and the bounds of each text."""
    data, offsets = column_bytes(column)
    data = LOWER[data]
    start = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(start, len(data)))
    point = data[start].astype(np.uint32)
    long = size > 1
    point[long] &= (0x7F >> size[long]).astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        point[more] = (point[more] << np.uint32(6)) | (data[start[more] + k] & 0x3F)
    return point, np.searchsorted(start, offsets)


def features(point: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once and in order; wanted: flags of the features to return."""
    size = np.diff(bounds)
    kind = np.uint32 if len(size) <= 1 << (32 - BITS) else np.int64  # narrow pairs take half the room and sort faster
    room = np.repeat(bounds[1:].astype(np.int32), size) - np.arange(len(point), dtype=np.int32)
    doc = np.repeat(np.arange(len(size)).astype(kind) << kind(BITS), size)
    out = []
    total = np.zeros(len(point), np.uint32)
    for k in range(1, max(ORDERS) + 1):
        total = total[: len(point) - k + 1] * np.uint32(0x01000193) + (point[k - 1 :] + np.uint32(1)) * np.uint32(0x85EBCA6B)
        if k in ORDERS:
            h = (total ^ (total >> np.uint32(15))) * np.uint32(0xC2B2AE35 + 2 * k)
            h = h >> np.uint32(32 - BITS)
            good = room[: len(h)] >= k
            if wanted is not None:
                good &= wanted[h]
            out.append(doc[: len(h)][good] | h[good])
    pair = np.concatenate(out)
    pair.sort()
    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    return (pair >> kind(BITS)).astype(np.int64), (pair & kind((1 << BITS) - 1)).astype(np.int64)


def _rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, text) to counts of texts with each feature, by class; feature -1 has all texts."""
    counts, texts = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for a, b in sliced(batch.column(1), SLICE):
            toxic = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
            doc, own = features(*characters(batch.column(1).slice(a, b - a)))
            for k in range(2):
                counts[k] += np.bincount(own[toxic[doc] == k], minlength=1 << BITS)
                texts[k] += (toxic == k).sum()
    met = np.flatnonzero(counts.any(0))
    clean, toxic = np.concatenate([texts[:, None], counts[:, met]], 1)
    for at in range(0, len(met) + 1, 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, met)[part].astype(np.int32)), pa.array(clean[part]), pa.array(toxic[part])], ["feature", "clean", "toxic"])


def _presence(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in sliced(batch.column(1), SLICE):
                doc, own = features(*characters(batch.column(1).slice(a, b - a)), wanted.value)
                parts = np.split(own.astype(np.int32), np.searchsorted(doc, np.arange(1, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(parts, pa.list_(pa.int32()))], ["toxic", "own"])

    return run


def fit(place: np.ndarray, owner: np.ndarray, y: np.ndarray, scale: np.ndarray, ridge: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression over present features scaled by r, by accelerated gradient descent; weights include r.

    place, owner: features and the texts that have them.
    """
    value = scale[place]
    used, place = np.unique(place, return_inverse=True)
    n = len(y)
    forward = lambda v: np.bincount(owner, value * v[place], minlength=n)
    back = lambda e: np.bincount(place, value * e[owner], minlength=len(used))
    top = np.ones(len(used))
    for _ in range(20):  # the largest curvature, by power iteration
        top = back(forward(top))
        top /= max(np.linalg.norm(top), 1e-12)
    rate = 3.5 * n / max(np.linalg.norm(forward(top)) ** 2, n)
    w = v = np.zeros(len(used))
    b = c = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    for t in range(1, steps + 1):
        error = 1 / (1 + np.exp(-np.clip(c + forward(v), -30, 30))) - y
        w, old, b, old_b = v - rate * (back(error) + ridge * v) / n, w, c - rate * error.mean(), b
        v, c = w + (t - 1) / (t + 2) * (w - old), b + (t - 1) / (t + 2) * (b - old_b)
    weights = np.zeros(len(scale))
    weights[used] = w * scale[used]
    return weights, b


def bias_of(texts: list[int]) -> float:
    """The margin of texts of which nothing is known, by the number of texts of both classes."""
    return float(np.log((texts[1] + 1) / (texts[0] + 1)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, kept: int = FEATURES, least_texts: int = LEAST_TEXTS, least_r: float = LEAST_R) -> tuple[np.ndarray, float]:
    """Weights of all hashed features and the bias, from at most `sample` labelled texts; zeros without labels."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = labelled_sample(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), sample)
    texts = docs.join(F.broadcast(known), "doc_id").select("toxic", "text").repartition(TASKS)
    rates = texts.mapInArrow(_rates, "feature int, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    summed = rates.where(f"feature = -1 or clean + toxic >= {int(least_texts)}").toArrow()
    feature, *counts = (summed.column(c).to_numpy() for c in ("feature", "clean", "toxic"))
    total = [int(c[feature == -1].sum()) for c in counts]
    if min(total) == 0:
        return np.zeros(1 << BITS), bias_of(total)
    clean, toxic = (np.zeros(1 << BITS, np.int64) for _ in range(2))
    for each, c in zip((clean, toxic), counts):
        each[feature[feature >= 0]] = c[feature >= 0]
    p, q = (toxic + 1) / (total[1] + 2), (clean + 1) / (total[0] + 2)
    r = np.log(p / q)
    worth = np.where((clean + toxic >= least_texts) & (np.abs(r) >= least_r), np.abs(r) * np.sqrt(p + q), 0)
    wanted = np.zeros(1 << BITS, bool)
    wanted[np.argsort(-worth, kind="stable")[:kept]] = True
    wanted &= worth > 0
    if not wanted.any():
        return np.zeros(1 << BITS), bias_of(total)
    rows = texts.mapInArrow(_presence(spark.sparkContext.broadcast(wanted)), "toxic int, own array<int>").toArrow()
    own = rows.column("own").combine_chunks()
    owner = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
    return fit(own.flatten().to_numpy(zero_copy_only=False), owner, rows.column("toxic").to_numpy().astype(float), np.where(wanted, r, 0))


def _score(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        wanted = weights != 0
        for batch in batches:
            for a, b in sliced(batch.column(2), SLICE):
                doc, own = features(*characters(batch.column(2).slice(a, b - a)), wanted)
                total = bias + np.bincount(doc, weights[own], minlength=b - a)
                score = 1 / (1 + np.exp(-np.clip(total, -60, 60)))
                predicted = pa.array((score >= threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(score), predicted], ["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7, sample: int = SAMPLE, kept: int = FEATURES, least_texts: int = LEAST_TEXTS, least_r: float = LEAST_R) -> DataFrame:
    """Score each whole text; learn from labels of rows whose crc32(doc_id) modulo folds isn't held_out.

    Takes doc_id and text of docs, doc_id and toxic of labels. Returns a row per row of docs (repeated rows too):
    doc_id, held_out, score (0 to 1), predicted (1 from the threshold on). Null and empty texts get the bias alone; a
    null doc_id is scored and never learned from; contradictory labels count as toxic. Without labels of both classes
    the score is the same for all. The fit sees at most `sample` labelled texts, chosen by hash of doc_id, and of their
    n-grams the `kept` best of those that least_texts of them have and whose log-count ratio is least_r or more; where
    none does, all texts get the bias.
    """
    spark = docs.sparkSession
    prepare(spark)
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held_out, F.lit(False))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", fold)
    model = train(narrow.where("not held_out").select("doc_id", "text"), labels.where(~fold), sample, kept, least_texts, least_r)
    return narrow.select("doc_id", "held_out", "text").mapInArrow(_score(spark.sparkContext.broadcast(model), threshold), "doc_id long, held_out boolean, score double, predicted int")
