"""Packing into optimal length buckets.

The global histogram of lengths goes to the driver: D distinct lengths take D * (D - 1) / 2 tokens or more, so a corpus of
5 billion tokens has at most 100,000. Dynamic programming over it chooses the bucket boundaries that minimise padding,
exactly, so each bucket ends with the length of its longest text. Each text joins the smallest bucket that holds it,
and batches of a fixed token budget form inside each bucket: a batch has as many rows as fit when all are padded to the
bucket's length. Ranks within a bucket come from counts by slice, so a bucket may hold any share of the texts.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import bounded, prepare, workspace, written

#: Rows of a slice of a bucket that one task ranks.
SLICE = 50_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Of ascending lengths those that end a bucket, so that padding every text to its bucket's end costs least.

    In whole numbers, so exact, with a number of steps in proportion to buckets times lengths.
    """
    n, size = len(lengths), [int(x) for x in lengths]
    if not n:
        return []
    total = [0, *accumulate(int(c) for c in counts)]
    cost = [size[i] * total[i + 1] for i in range(n)]  # one bucket for the first i + 1 lengths, real tokens left out: they're the same for all
    back = []
    for _ in range(1, min(buckets, n)):
        # cost[i] = min over j < i of cost[j] + size[i] * (total[i + 1] - total[j + 1]): each j is a line over size[i], whose
        # slope falls with j, so the lines that are least somewhere follow one another as size[i] grows
        better, lasts, lines, at = cost[:], [-1] * n, [], 0
        for i in range(1, n):
            slope, base = -total[i], cost[i - 1]
            while len(lines) - at > 1:
                (u, x, _), (v, y, _) = lines[-2:]
                if (base - x) * (u - v) > (y - x) * (u - slope):
                    break
                lines.pop()
            lines.append((slope, base, i - 1))
            while at + 1 < len(lines) and lines[at + 1][0] * size[i] + lines[at + 1][1] <= lines[at][0] * size[i] + lines[at][1]:
                at += 1
            least = lines[at][0] * size[i] + lines[at][1] + size[i] * total[i + 1]
            if least < cost[i]:
                better[i], lasts[i] = least, lines[at][2]
        back.append(lasts)
        cost = better
    out, i = [size[-1]], n - 1
    for lasts in reversed(back):
        if lasts[i] >= 0:
            i = lasts[i]
            out.append(size[i])
    return sorted(out)


def pack(docs: DataFrame, length: Column, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """Batches of texts of like length; `length` is an expression over the columns of docs, doc_id is kept.

    Returns a row per input row (repeated rows too): doc_id, n_tokens (the length), bucket (its padded length), batch
    (number within the bucket, from 0), slot (place in the batch, from 0). Rows of a batch times bucket stay within budget;
    a text that alone exceeds it is a batch by itself. Null lengths count as 0; texts of length 0 form the bucket 0, with
    budget rows a batch. Rows with a null doc_id come first in their slice. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"), F.monotonically_increasing_id().alias("row"))
    own = written(own, f"{workspace(spark)}/lengths")
    seen = sorted((r["n_tokens"], r["count"]) for r in own.groupBy("n_tokens").count().collect())
    ends = boundaries(np.array([c for c, _ in seen]), np.array([k for _, k in seen]), buckets)
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= e, F.lit(e)) for e in ends]) if ends else F.lit(0)
    slices = max(1, sum(k for _, k in seen) // SLICE)
    placed = own.withColumn("bucket", bucket.cast("long")).withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)))
    # a slice that one doc_id fills is cut further, by row
    full = placed.groupBy("slice").count().where(F.col("count") > 2 * SLICE).select("slice", F.ceil(F.col("count") / SLICE).alias("parts"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("parts")))
    placed = placed.join(bounded(full), "slice", "left").withColumn("part", part)
    counts = placed.groupBy("bucket", "slice", "part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("bucket").orderBy("slice", "part")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("bucket", "slice", "part").orderBy("doc_id", "n_tokens")) - 1
    ranked = placed.withColumn("rank", rank).join(before, ["bucket", "slice", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket", F.lit(1))))
    return ranked.select("doc_id", "n_tokens", "bucket", F.floor(F.col("rank") / rows).alias("batch"), (F.col("rank") % rows).alias("slot"))


def word_count(text: Column) -> Column:
    """Runs of non-space characters; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
