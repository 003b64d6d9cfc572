"""Queries of the sample operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.arrays import at, total
from ..operators import samples
from ..plans.config import thresholds_of
from ..registry import query
from . import chain
from .fixtures import settled


WINDOWS = chain.sql("""SELECT sample_id, any_value(mmsi) AS mmsi, any_value(segment_id) AS segment_id, count(*) AS points, min(us) AS start_time, max(us) AS end_time, round(sum(round_even(sog * 1e4, 0) / 1e4), 5) AS sum_sog,
  count(*) FILTER (gap_imputed) AS imputed, count(*) FILTER (grid_interp) AS grid_interpolated FROM points GROUP BY 1""", "points")


def window_facts(df):
    n = lambda c: F.size(F.filter(c, lambda v: v)).cast("long")
    return settled(df.select("sample_id", "mmsi", "segment_id", F.size("lat").cast("long").alias("points"), at(F.col("timestamps"), 0).alias("start_time"), at(F.col("timestamps"), -1).alias("end_time"),
        F.when(F.exists("sog", F.isnotnull), F.round(total(F.filter("sog", F.isnotnull)), 5)).alias("sum_sog"), n("gap_imputed").alias("imputed"), n("grid_interp").alias("grid_interpolated")))


@query(WINDOWS)
def sliding_windows(spark, d):
    return window_facts(chain.windows(spark, d))


@query(chain.sql("SELECT segment_id, CAST(count(*) AS BIGINT) AS windows FROM starts GROUP BY 1", "starts"))
def window_counts(spark, d):
    return chain.windows(spark, d).groupBy("segment_id").agg(F.count("*").alias("windows"))


@query(chain.sql("SELECT sample_id, CASE WHEN step < 30 THEN 'hist' ELSE 'fut' END AS phase, CAST(step % 30 AS BIGINT) AS step, round(x, 3) AS x_m, round(y, 3) AS y_m, gap_imputed, grid_interp AS grid_interpolated FROM placed", "placed"))
def preview_rows(spark, d):
    return samples.preview(chain.labelled(spark, d)).withColumns({"x_m": F.round("x_m", 3), "y_m": F.round("y_m", 3), "step": F.col("step").cast("long")})


@query(chain.sql("SELECT sample_id, round(x, 3) AS x_m, round(y, 3) AS y_m FROM placed WHERE step = 59", "placed"))
def local_xy(spark, d):
    return chain.labelled(spark, d).select("sample_id", F.round(at(F.col("fut_x"), -1), 3).alias("x_m"), F.round(at(F.col("fut_y"), -1), 3).alias("y_m"))


@query(chain.sql("""SELECT sample_id, round(sum(round_even(sin(2 * pi() * ((us // 1000000) % 86400) / 86400) * 1e6, 0) / 1e6), 4) AS tod_sin, round(sum(round_even(cos(2 * pi() * ((us // 1000000) % 86400) / 86400) * 1e6, 0) / 1e6), 4) AS tod_cos,
  round(sum(round_even(sin(2 * pi() * ((us // 86400000000 + 3) % 7) / 7) * 1e6, 0) / 1e6), 4) AS dow_sin, round(sum(round_even(cos(2 * pi() * ((us // 86400000000 + 3) % 7) / 7) * 1e6, 0) / 1e6), 4) AS dow_cos FROM points WHERE step < 30 GROUP BY 1""", "points"))
def time_features(spark, d):
    s = lambda c: F.round(total(F.col(c)), 4)
    return chain.labelled(spark, d).select("sample_id", s("hist_time_of_day_sin").alias("tod_sin"), s("hist_time_of_day_cos").alias("tod_cos"), s("hist_day_of_week_sin").alias("dow_sin"), s("hist_day_of_week_cos").alias("dow_cos"))


@query(chain.sql("SELECT sample_id, round(ih, 6) AS interp_hist, round(if, 6) AS interp_fut, round(it, 6) AS interp_total, round(gh, 6) AS grid_hist, round(gf, 6) AS grid_fut, round(gt, 6) AS grid_total FROM measured", "measured"))
def interp_ratios(spark, d):
    names = {f"{a}_ratio_{s}": f"{b}_{s}" for a, b in (("interp", "interp"), ("grid_interp", "grid")) for s in ("hist", "fut", "total")}
    return settled(chain.labelled(spark, d).select("sample_id", *[F.col(k).alias(v) for k, v in names.items()]))


@query(chain.sql("SELECT sample_id, hist_ok AS hist_gap_ok, fut_ok AS fut_gap_ok FROM samples", "samples"))
def gap_ok(spark, d):
    return chain.labels(spark, d, "sample_id", "hist_gap_ok", "fut_gap_ok")


@query(chain.sql("SELECT sample_id, mmsi, segment_id, ship_class, hist_end AS hist_end_ts, pred_end AS pred_end_ts, round(hd, 1) AS hist_displacement, round(fd, 1) AS fut_displacement, core AS core_eligible, full_ok AS full_eligible, tier AS quality_tier FROM samples", "samples"))
def quality_tier(spark, d):
    df = chain.labelled(spark, d).withColumns({"hist_displacement": F.round("hist_displacement_m", 1), "fut_displacement": F.round("fut_displacement_m", 1)})
    return settled(df, keep=("sample_id", "mmsi", "segment_id", "ship_class", "hist_end_ts", "pred_end_ts", "hist_displacement", "fut_displacement", "core_eligible", "full_eligible", "quality_tier"))


@query(chain.sql("SELECT tier AS quality_tier, count(*) AS samples, round(avg(ih), 6) AS mean_interp_ratio_hist, round(avg(if), 6) AS mean_interp_ratio_fut, round(avg(it), 6) AS mean_interp_ratio_total, round(avg(gt), 6) AS mean_grid_interp_ratio_total FROM samples GROUP BY 1", "samples"))
def tier_summary(spark, d):
    return settled(samples.tier_summary(chain.labelled(spark, d)))


SPLIT = "CASE CAST((CAST('0x' || md5(CAST(mmsi AS VARCHAR)) AS UHUGEINT)) % 10 AS INT) WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END"


@query(f"SELECT mmsi, {SPLIT} AS split FROM (SELECT DISTINCT 219001000 + user_id AS mmsi FROM events)")
def md5_split(spark, d):
    df = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") + 219001000).alias("mmsi")).distinct()
    return df.withColumn("split", text.split_of(F.col("mmsi")))


@query(chain.sql(f"SELECT version, {SPLIT} AS split, count(*) AS n FROM (SELECT mmsi, 'core' AS version FROM samples WHERE core UNION ALL SELECT mmsi, 'full' FROM samples WHERE full_ok) GROUP BY 1, 2", "samples"))
def export_counts(spark, d):
    return samples.export_versions(chain.labelled(spark, d)).groupBy("version", "split").agg(F.count("*").alias("n"))


@query(chain.sql("SELECT count(*) AS samples, round(avg(ih), 6) AS interp_ratio_hist, round(avg(if), 6) AS interp_ratio_fut, round(avg(it), 6) AS interp_ratio_total, round(avg(gt), 6) AS grid_interp_ratio_total FROM samples", "samples"))
def summary_merge(spark, d):
    means = ["interp_ratio_hist", "interp_ratio_fut", "interp_ratio_total", "grid_interp_ratio_total"]
    parts = chain.labelled(spark, d).groupBy(F.pmod("mmsi", F.lit(64)).alias("part")).agg(F.count("*").alias("samples"), *[F.avg(c).alias(c) for c in means])
    return settled(samples.merge_summaries(parts, ["samples"], means, "samples"))


@query(chain.sql("""SELECT sample_id, round(sum(vx), 5) AS sum_vx, round(sum(abs(vy)), 5) AS sum_abs_vy, round(sum(abs(vx - coalesce(pvx, vx))), 5) AS sum_abs_ax FROM (SELECT sample_id, step, vx, vy, lag(vx) OVER w2 AS pvx FROM
  (SELECT sample_id, step, coalesce(x - lag(x) OVER w, 0) AS vx, coalesce(y - lag(y) OVER w, 0) AS vy FROM placed WHERE step < 30 WINDOW w AS (PARTITION BY sample_id ORDER BY step)) WINDOW w2 AS (PARTITION BY sample_id ORDER BY step)) GROUP BY 1""", "placed"))
def kinematics(spark, d):
    df = samples.kinematics(chain.labelled(spark, d))
    part = lambda k, f: total(F.transform("hist", lambda r: f(r[k])))
    return df.select("sample_id", F.round(part(2, lambda v: v), 5).alias("sum_vx"), F.round(part(3, F.abs), 5).alias("sum_abs_vy"), F.round(part(4, F.abs), 5).alias("sum_abs_ax"))


@query(chain.sql("SELECT segment_id, count(*) AS windows FROM ordered WHERE i % 10 = 0 AND i + 45 <= n GROUP BY 1", "ordered"))
def configured_windows(spark, d):
    """Windows by thresholds of a configuration file's form: 30 and 15 rows at every tenth."""
    limits = thresholds_of({"thresholds": {"sliding_window_fut_points": 15, "sliding_window_step_points": 10}})
    return samples.make_windows(chain.long_enough(spark, d), limits).groupBy("segment_id").agg(F.count("*").alias("windows"))
