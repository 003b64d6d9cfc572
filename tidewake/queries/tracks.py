"""Queries of the track operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracks
from ..registry import query
from . import chain
from .fixtures import settled


SEGMENTED = chain.sql("SELECT mmsi, us AS timestamp_utc, segment_id, reason AS segment_break_before, dt AS dt_to_prev_seconds, round(implied, 4) AS implied_speed FROM seg", "seg")
SUMMARY = chain.sql("SELECT mmsi, segment_id, min(us) AS start_time, max(us) AS end_time, count(*) AS num_points FROM seg GROUP BY 1, 2", "seg")


def segment_facts(df):
    df = df.withColumn("implied_speed", F.round("implied_speed_from_prev_knots", 4))
    return settled(df, keep=("mmsi", "timestamp_utc", "segment_id", "segment_break_before", "dt_to_prev_seconds", "implied_speed"))


@query(SEGMENTED)
def segment_tracks(spark, d):
    return segment_facts(chain.segmented(spark, d))


@query(SUMMARY)
def segment_summary(spark, d):
    return settled(tracks.segment_summary(chain.segmented(spark, d)))


@query(chain.sql("SELECT reason, count(*) AS n FROM seg GROUP BY 1", "seg", ).replace("SELECT reason,", "SELECT reason AS segment_break_before,"))
def break_reasons(spark, d):
    return chain.segmented(spark, d).groupBy("segment_break_before").agg(F.count("*").alias("n"))


@query(chain.sql("SELECT segment_id, CAST(anchor_s AS DOUBLE) AS longest_s FROM runs_a", "runs_a"))
def longest_runs(spark, d):
    return tracks.longest_runs(chain.segmented(spark, d), tracks.anchored(), "longest_s").select("segment_id", "longest_s")


@query(chain.sql("SELECT segment_id, count(*) FILTER (still) AS still_rows FROM flagged GROUP BY 1", "flagged"))
def low_displacement(spark, d):
    return chain.segmented(spark, d).withColumn("still", tracks.low_displacement()).groupBy("segment_id").agg(F.count_if("still").alias("still_rows"))


@query(chain.sql("""SELECT segment_id, mmsi, n AS num_points, t0 AS start_time, t1 AS end_time, duration AS duration_seconds, round(end_to_end, 3) AS end_to_end_m, CAST(anchor_s AS DOUBLE) AS longest_anchor_s, CAST(low_s AS DOUBLE) AS longest_low_s,
  still AS has_low_displacement, excluded FROM labels""", "labels"))
def segment_labels(spark, d):
    names = {"longest_anchor_or_moored_seconds": "longest_anchor_s", "longest_low_speed_seconds": "longest_low_s", "has_low_displacement_20min_window": "has_low_displacement", "exclude_from_underway_only": "excluded"}
    df = tracks.segment_labels(chain.segmented(spark, d)).withColumnsRenamed(names).withColumn("end_to_end_m", F.round("end_to_end_displacement_m", 3)).drop("end_to_end_displacement_m")
    return settled(df)


@query(chain.sql("SELECT mmsi, segment_id, us AS timestamp_utc FROM underway", "underway"))
def underway_only(spark, d):
    return settled(chain.underway(spark, d), keep=("mmsi", "segment_id", "timestamp_utc"))


@query(chain.sql("SELECT segment_id, us AS timestamp_utc, gap_class AS gap_class_before FROM gapped", "gapped"))
def gap_classes(spark, d):
    return settled(tracks.with_gaps(chain.underway(spark, d)), keep=("segment_id", "timestamp_utc", "gap_class_before"))


@query(chain.sql("SELECT count(*) FILTER (NOT filled AND gap_class = 'short') AS short_gaps, count(*) FILTER (gap_class = 'medium') AS medium_gaps, count(*) FILTER (gap_class = 'long') AS long_gaps, count(*) FILTER (filled) AS inserted_points FROM gapfilled", "gapfilled"))
def gap_counts(spark, d):
    c, real = F.col("gap_class_before"), ~F.col("is_interpolated_obs")
    return chain.gapfilled(spark, d).agg(F.count_if(real & (c == "short")).alias("short_gaps"), F.count_if(c == "medium").alias("medium_gaps"), F.count_if(c == "long").alias("long_gaps"), F.count_if(~real).alias("inserted_points"))


POINT = "round(lat, 10) AS lat, round(lon, 10) AS lon, round(sog, 4) AS sog, round(cog, 4) AS cog, round(heading, 4) AS heading"


def _point(df):
    return df.withColumns({c: F.round(c, 4) for c in ("sog", "cog", "heading")})


@query(chain.sql(f"SELECT segment_id, us AS timestamp_utc, {POINT}, gap_class AS gap_class_before, filled AS is_interpolated_obs FROM gapfilled", "gapfilled"))
def fill_short_gaps(spark, d):
    return settled(_point(chain.gapfilled(spark, d)), keep=("segment_id", "timestamp_utc", "lat", "lon", "sog", "cog", "heading", "gap_class_before", "is_interpolated_obs"), digits=10)


@query(chain.sql(f"SELECT segment_id, us AS timestamp_utc, {POINT}, gap_class AS gap_class_before, grid_interp AS is_grid_interpolated_point, gap_imputed AS is_gap_imputed_point FROM resampled", "resampled"))
def resample_20s(spark, d):
    return settled(_point(chain.resampled(spark, d)), keep=("segment_id", "timestamp_utc", "lat", "lon", "sog", "cog", "heading", "gap_class_before", "is_grid_interpolated_point", "is_gap_imputed_point"), digits=10)


@query(chain.sql("SELECT segment_id, CAST(max(piece) AS BIGINT) AS pieces, count(*) AS n FROM pieces GROUP BY 1", "pieces"))
def resplit_120(spark, d):
    return tracks.resplit(chain.gapfilled(spark, d), 120.0).groupBy("segment_id").agg(F.max("_piece").alias("pieces"), F.count("*").alias("n"))


@query(chain.sql("SELECT segment_id, count(*) AS n, count(*) FILTER (spike) AS spikes FROM spiked GROUP BY 1", "spiked"))
def median_filter_flags(spark, d):
    return tracks.anomaly_flags(chain.resampled(spark, d)).groupBy("segment_id").agg(F.count("*").alias("n"), F.count_if("_spike").alias("spikes"))


@query(chain.sql("SELECT segment_id, us AS timestamp_utc FROM reviewed", "reviewed"))
def anomaly_resplit(spark, d):
    return settled(chain.reviewed(spark, d), keep=("segment_id", "timestamp_utc"))


@query(chain.sql("SELECT segment_id, count(*) AS n, min(us) AS start_time, max(us) AS end_time FROM kept GROUP BY 1", "kept"))
def min_length(spark, d):
    return settled(chain.long_enough(spark, d).groupBy("segment_id").agg(F.count("*").alias("n"), F.min("timestamp_utc").alias("start_time"), F.max("timestamp_utc").alias("end_time")))
