"""The stages of ingest that work on streams: cleaning as it is, dedup and sessions by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest
from ..plans.config import DEFAULT, Thresholds


def clean_stream(raw: DataFrame, dialect: str | None = None, limits: Thresholds = DEFAULT) -> DataFrame:
    """Standardised, filtered and speed-capped messages; no state."""
    return ingest.speed_filter(ingest.basic_filter(ingest.standardize(raw, dialect, limits=limits)), limits)


def dedup_stream(messages: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """The first message of each vessel and time within the watermark; a stream can't rank later ones against it."""
    return messages.withWatermark("timestamp_utc", lateness).dropDuplicatesWithinWatermark(["mmsi", "timestamp_utc"])


def sessions(messages: DataFrame, gap: str = "10 minutes", lateness: str | None = None) -> DataFrame:
    """Segments by time gaps alone: vessel, start, end and number of points, once the watermark has passed them.

    lateness sets a watermark; leave it out for a stream that has one, as dedup_stream's does.
    """
    grouped = (messages.withWatermark("timestamp_utc", lateness) if lateness else messages).groupBy("mmsi", F.session_window("timestamp_utc", gap).alias("w"))
    return grouped.agg(F.count("*").alias("num_points"), F.min("timestamp_utc").alias("start_time"), F.max("timestamp_utc").alias("end_time")).drop("w")
