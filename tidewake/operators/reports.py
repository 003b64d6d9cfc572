"""Counts and summaries for manifests, reports and plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATUM = ("ship_group", "speed_bin", "motion_bin")


def strata_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*STRATUM).agg(F.count("*").alias("n"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark plans a group limit before the exchange."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def split_report(df: DataFrame) -> DataFrame:
    """Per split: samples, vessels, segments, and how many samples each stratum bin has, as maps.

    Bins are counted first and gathered then, so a split's rows never meet in one task.
    """
    out = df.groupBy("split").agg(F.count("*").alias("samples"), F.count_distinct("mmsi").alias("vessels"), F.count_distinct("segment_id").alias("segments"))
    for c in STRATUM:
        counts = df.groupBy("split", c).agg(F.count("*").alias("n")).groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(c))
        out = out.join(counts, "split")
    return out


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, *keys: str) -> DataFrame:
    """Counts in equal bins of values clipped to [low, high]; the last bin is closed."""
    v = F.greatest(F.lit(low), F.least(F.lit(high), F.col(column)))
    return df.groupBy(*keys, F.least(F.lit(bins - 1), F.floor((v - low) / ((high - low) / bins)).cast("int")).alias("bin")).agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(key).pivot(column, values).count().fillna(0)


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The frame, with an error on use if a key comes twice."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"repeated key {keys}")).cast("boolean")).otherwise(True)).drop("_n")


def stratum_means(df: DataFrame) -> DataFrame:
    """Mean quality and difficulty of each stratum, to 4 decimals."""
    return df.groupBy(*STRATUM).agg(F.count("*").alias("n"), *[F.round(F.avg(f"{c}_score"), 4).alias(f"mean_{c}") for c in ("quality", "difficulty")])


def environment_summary(env: DataFrame, *keys: str) -> DataFrame:
    """Samples, those with each kind of way in reach, and mean and median least distances."""
    kinds = ("shoreline", "waterfront")
    return env.groupBy(*keys).agg(
        F.count("*").alias("num_samples"), *[F.count_if(F.col(f"has_{k}_in_patch") > 0).alias(f"{k}_positive") for k in kinds],
        *[F.avg(f"min_{k}_dist_m").alias(f"mean_min_{k}_dist_m") for k in kinds], *[F.median(f"min_{k}_dist_m").alias(f"median_min_{k}_dist_m") for k in kinds],
    )


def log_maxima(df: DataFrame, *columns: str) -> DataFrame:
    """The largest log(1 + value) of each column, negative values as 0; 1 for an empty table."""
    return df.agg(*[F.coalesce(F.max(F.log1p(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)))), F.lit(1.0)).alias(c) for c in columns])


CONTEXT_ORDER = ("has_waterfront_in_patch", "has_shoreline_in_patch", "shoreline_segment_count", "waterfront_segment_count")


def context_examples(env: DataFrame, n: int = 1, positive: bool = True) -> DataFrame:
    """The first n samples of each split by context, richest first, ties by sample_id; positive: with any, if the split has one.

    The order puts samples with context first, so a split without any falls back to all of its samples by itself.
    """
    out = top_per_group(env, ["split"], [*[F.desc(c) for c in CONTEXT_ORDER], F.col("sample_id")], n)
    if not positive or n == 1:
        return out
    some = (F.col(CONTEXT_ORDER[0]) > 0) | (F.col(CONTEXT_ORDER[1]) > 0)
    any_in_split = F.max(some).over(Window.partitionBy("split"))
    return out.withColumn("_any", any_in_split).where(some | ~F.col("_any")).drop("_any")


def top_rows(df: DataFrame, order: list[Column], n: int = 20) -> DataFrame:
    """The first n rows; Spark keeps n rows of each partition and merges those."""
    return df.orderBy(*order).limit(n)


def stable_sample(df: DataFrame, n: int, key: str = "sample_id") -> DataFrame:
    """n rows that a hash of their key picks: the same ones on every run and partitioning."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def override_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows with the right side's values where it has the key, new columns added; unmatched rows keep their own."""
    other = right.select(key, F.struct(*[c for c in right.columns if c != key]).alias("_r"))
    df = left.join(other, key, "left")
    here = F.col("_r").isNotNull()
    kept = [F.when(here, F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) if c != key and c in right.columns else F.col(c) for c in left.columns]
    return df.select(*kept, *[F.col(f"_r.{c}").alias(c) for c in right.columns if c not in left.columns])
