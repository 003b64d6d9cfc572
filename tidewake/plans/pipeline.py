"""The whole cleaning chain from raw rows to labelled samples as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import ingest, samples, tracks
from .config import DEFAULT, Thresholds


def clean_messages(raw: DataFrame, dialect: str | None = None, keep: str = "most_missing", limits: Thresholds = DEFAULT) -> DataFrame:
    """raw has all-text columns and _ingest_order, which breaks ties between rows of one vessel and time."""
    df = ingest.dedup_messages(ingest.basic_filter(ingest.standardize(raw, dialect, limits=limits)), keep=keep)
    return tracks.co_located(ingest.speed_filter(df, limits))


def regular_tracks(clean: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    moving = tracks.underway(tracks.segment_tracks(clean, limits), limits)
    return tracks.long_segments(tracks.reject_anomalies(tracks.resample(tracks.fill_short_gaps(moving, limits), limits), limits), limits)


def forecast_samples(tracks_20s: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    return samples.label_samples(samples.make_windows(tracks_20s, limits), limits)
