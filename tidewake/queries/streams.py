"""Queries of the stream operators: the messages as a stream of uneven batches with rows that come late."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import shared_folder, stage
from ..registry import query
from ..streaming import runs, tracks
from . import chain
from .fixtures import settled
from .samples import WINDOWS, window_facts
from .tracks import SEGMENTED, SUMMARY, segment_facts

#: Shares of the whole time at which batches end, and how late a row comes at most.
CUTS, LATE_S = (0.07, 0.5, 0.55), 300
#: A vessel whose only message, long after all others, lets the watermark pass them.
LAST = 0


def batches(df: DataFrame) -> list[DataFrame]:
    """Rows in four uneven batches by time; half of those of a batch's last minutes come with the next one. Then a closing row."""
    us = F.unix_micros("timestamp_utc")
    low, high = df.agg(F.min(us), F.max(us)).first()
    ends = [int(low + c * (high - low)) for c in CUTS]
    number = sum((us > e).cast("int") for e in ends)
    late = sum(((us <= e) & (us > e - LATE_S * 1_000_000)).cast("int") for e in ends)
    number = number + F.when((late > 0) & (F.pmod(F.xxhash64("mmsi", "timestamp_utc"), F.lit(2)) == 0), 1).otherwise(0)
    df = df.withColumn("_batch", number)
    closing = df.where(us == high).limit(1).withColumns({"mmsi": F.lit(LAST).cast("long"), "timestamp_utc": F.timestamp_micros(F.lit(high + 86_400_000_000))})
    parts = [df.where(F.col("_batch") == k).drop("_batch") for k in range(len(ends) + 1)]
    return [*parts, closing.drop("_batch"), closing.drop("_batch").withColumn("timestamp_utc", F.timestamp_micros(F.lit(high + 2 * 86_400_000_000)))]


def streamed(spark: SparkSession, d: str, name: str, df: DataFrame, plan) -> DataFrame:
    home = f"{shared_folder(spark)}/tidewake-stream-{name}-{uuid.uuid4().hex}"
    return stage(spark, name, d, lambda: runs.fed(spark, batches(df), plan, home).where(F.col("mmsi") != LAST))


@query(SEGMENTED)
def stream_segments(spark, d):
    rows = chain.clean(spark, d).select("mmsi", "timestamp_utc", "_ingest_order", "lat", "lon", "sog", "shiptype_soft_cap_knots")
    df = streamed(spark, d, "stream_segments", rows, tracks.segment_stream)
    return segment_facts(df)


@query(SUMMARY)
def stream_segment_ends(spark, d):
    rows = chain.clean(spark, d).select("mmsi", "timestamp_utc", "_ingest_order", "lat", "lon", "sog", "shiptype_soft_cap_knots")
    return settled(streamed(spark, d, "stream_segment_ends", rows, tracks.segment_ends))


@query(WINDOWS)
def stream_windows(spark, d):
    df = streamed(spark, d, "stream_windows", chain.long_enough(spark, d).select("mmsi", "segment_id", *tracks.ROW), tracks.window_stream)
    return window_facts(df)
