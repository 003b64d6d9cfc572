"""Forecast samples: sliding windows, labels, splits, export versions, kinematic views. Arrays stay native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.arrays import at, displacement, ratio
from ..plans.config import DEFAULT, Thresholds
from .tracks import SEGMENT, along, seconds


#: Columns of a window's rows.
ROW = ("timestamp_utc", "lat", "lon", "sog", "cog", "heading", "is_gap_imputed_point", "is_grid_interpolated_point", "is_interpolated_point", "gap_class_before", "ship_type")


def make_windows(df: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Windows of hist + fut rows at every window_step-th row of a segment, as arrays in order of time.

    Rows are gathered in blocks of a step, each row once, and a window is put together from its blocks and those after it.
    """
    size, step = limits.hist_points + limits.fut_points, limits.window_step
    df = df.withColumns({"_i": F.row_number().over(along()) - 1, "_count": F.count("*").over(Window.partitionBy(*SEGMENT))}).where(F.col("_count") >= size)
    blocks = df.groupBy(*SEGMENT, F.floor(F.col("_i") / step).alias("_block")).agg(F.array_sort(F.collect_list(F.struct(*ROW))).alias("_rows"))
    ahead = Window.partitionBy(*SEGMENT).orderBy("_block").rowsBetween(0, -(-size // step) - 1)
    df = blocks.withColumn("_w", F.slice(F.flatten(F.collect_list("_rows").over(ahead)), 1, size)).where(F.size("_w") == size)
    return named_windows(df.withColumn("_i", F.col("_block") * step))


def named_windows(df: DataFrame) -> DataFrame:
    """Windows as columns of arrays, from rows (mmsi, segment_id, _i: number of the first row, _w: rows in order of time)."""
    field = lambda c: F.transform("_w", lambda r: r[c])
    rounded = lambda c, k: F.transform("_w", lambda r: geo.half_even(r[c], k)).alias(c)
    kind = at(F.col("_w"), -1)["ship_type"]
    return df.select(
        F.format_string("%s_%05d", "segment_id", "_i").alias("sample_id"), "mmsi", "segment_id", kind.alias("ship_type"), text.ship_class(kind).alias("ship_class"),
        field("timestamp_utc").alias("timestamps"), rounded("lat", 7), rounded("lon", 7), rounded("sog", 4), rounded("cog", 4), rounded("heading", 4),
        field("is_gap_imputed_point").alias("gap_imputed"), field("is_grid_interpolated_point").alias("grid_interp"), field("is_gap_imputed_point").alias("interp"), field("gap_class_before").alias("gap_class"),
    )


def cyclical(values: Column, period: float) -> tuple[Column, Column]:
    turn = lambda v: F.coalesce(v, F.lit(0.0)) * (6.283185307179586 / period)
    return F.transform(values, lambda v: geo.half_even(F.sin(turn(v)), 6)), F.transform(values, lambda v: geo.half_even(F.cos(turn(v)), 6))


def label_samples(windows: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Local coordinates about the last history point, cyclic features, ratios, displacements, eligibility and tier."""
    h, f = limits.hist_points, limits.fut_points
    hist, fut = lambda c: F.slice(c, 1, h), lambda c: F.slice(c, h + 1, f)
    lat0, lon0 = F.get("lat", F.lit(h - 1)), F.get("lon", F.lit(h - 1))
    df = windows.withColumns({"_x": F.transform("lon", lambda v: geo.half_even(geo.local_x(v, lat0, lon0), 3)), "_y": F.transform("lat", lambda v: geo.half_even(geo.local_y(v, lat0), 3))})
    df = df.withColumns({"hist_x": hist("_x"), "hist_y": hist("_y"), "fut_x": fut("_x"), "fut_y": fut("_y")})
    stamp = hist("timestamps")
    day = F.transform(stamp, lambda t: (F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))).cast("double"))
    cycles = {
        "cog": cyclical(hist("cog"), 360.0), "heading": cyclical(hist("heading"), 360.0), "time_of_day": cyclical(day, 86_400.0),
        "day_of_week": cyclical(F.transform(stamp, lambda t: F.weekday(t).cast("double")), 7.0),
    }
    deltas = F.zip_with(F.slice("timestamps", 2, h + f - 1), F.slice("timestamps", 1, h + f - 1), seconds)
    # the step from history to future belongs to neither side
    sides = {"hist_gap_ok": F.array_max(F.slice(deltas, 1, h - 1)) <= limits.max_gap_s, "fut_gap_ok": F.array_max(F.slice(deltas, h + 1, f - 1)) <= limits.max_gap_s}
    ratios = {f"{name}_{side}": ratio(part(column)) for name, column in (("interp_ratio", "gap_imputed"), ("grid_interp_ratio", "grid_interp")) for side, part in (("hist", hist), ("fut", fut), ("total", F.col))}
    df = df.withColumns(sides | ratios | {"hist_displacement_m": displacement("hist_x", "hist_y"), "fut_displacement_m": displacement("fut_x", "fut_y")})
    full = F.col("hist_gap_ok") & F.col("fut_gap_ok") & (F.col("hist_displacement_m") >= limits.min_displacement_m) & (F.col("fut_displacement_m") >= limits.min_fut_displacement_m)
    core = F.col("full_eligible") & (F.col("interp_ratio_hist") <= limits.core_interp_hist) & (F.col("interp_ratio_fut") <= limits.core_interp_fut) & (F.col("interp_ratio_total") <= limits.core_interp_total)
    df = df.withColumn("full_eligible", full).withColumn("core_eligible", core)
    return df.select(
        "sample_id", "mmsi", "segment_id", "ship_type", "ship_class", text.ship_type_id(F.col("ship_type")).alias("ship_type_id"),
        F.get("timestamps", F.lit(h - 1)).alias("hist_end_ts"), at(F.col("timestamps"), -1).alias("pred_end_ts"), "hist_x", "hist_y", "fut_x", "fut_y",
        F.transform(hist("sog"), lambda v: F.coalesce(v, F.lit(0.0))).alias("hist_sog"),
        *[c.alias(f"hist_{k}_{n}") for k, pair in cycles.items() for n, c in zip(("sin", "cos"), pair)],
        hist("gap_imputed").alias("hist_interp"), fut("gap_imputed").alias("fut_interp"), hist("grid_interp").alias("hist_grid_interp"), fut("grid_interp").alias("fut_grid_interp"),
        *ratios, *sides, "hist_displacement_m", "fut_displacement_m", "core_eligible", "full_eligible",
        F.when(F.col("core_eligible"), "core").when(F.col("full_eligible"), "full").otherwise("drop").alias("quality_tier"),
    )


def export_versions(samples: DataFrame) -> DataFrame:
    """Each sample once in every version that it is eligible for, with its split; core is part of full."""
    versions = F.array_compact(F.array(F.when(F.coalesce("core_eligible", F.lit(False)), "core"), F.when(F.coalesce("full_eligible", F.lit(False)), "full")))
    return samples.withColumn("split", text.split_of(F.col("mmsi"))).withColumn("version", F.explode(versions))


def tier_summary(samples: DataFrame) -> DataFrame:
    names = [c for c in ("interp_ratio_hist", "interp_ratio_fut", "interp_ratio_total", "grid_interp_ratio_total") if c in samples.columns]
    return samples.groupBy("quality_tier").agg(F.count("*").alias("samples"), *[F.avg(c).alias(f"mean_{c}") for c in names])


def merge_maps(parts: DataFrame, column: str) -> DataFrame:
    """(key, n): values of a map column summed by key over rows of partial summaries."""
    return parts.select(F.explode(column).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))


def merge_summaries(parts: DataFrame, counts: list[str], means: list[str], weight: str) -> DataFrame:
    """One row from rows of partial summaries: sums of counts and weighted means."""
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], *[(F.sum(F.col(m) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))).alias(m) for m in means])


def kinematics(samples: DataFrame) -> DataFrame:
    """History as rows (x, y, vx, vy, ax, ay), future as (x, y), and the placeholder of absent neighbours."""
    # all from neighbouring places: an array made by another transform would be made again for each element that is taken from it
    v = lambda c, i: F.when((i == 0) & (F.size(c) > 0), 0.0).otherwise(F.get(c, i) - F.get(c, i - 1))
    a = lambda c, i: F.when((i == 0) & (F.size(c) > 0), 0.0).otherwise(v(c, i) - v(c, i - 1))
    point = lambda side, i: [F.get(f"{side}_{c}", i) for c in "xy"]
    hist = F.transform("hist_x", lambda _, i: F.array(*point("hist", i), *[f(f"hist_{c}", i) for f in (v, a) for c in "xy"]))
    fut = F.transform("fut_x", lambda _, i: F.array(*point("fut", i)))
    placeholder = F.array_repeat(F.array(F.array_repeat(F.lit(1e9), 6)), 60)
    return samples.select("sample_id", hist.alias("hist"), fut.alias("fut"), placeholder.alias("neighbours"))


def preview(samples: DataFrame) -> DataFrame:
    """A row per point of each sample: phase, step, place and flags."""
    def side(phase: str) -> DataFrame:
        parts = F.arrays_zip(F.col(f"{phase}_x").alias("x_m"), F.col(f"{phase}_y").alias("y_m"), F.col(f"{phase}_interp").alias("gap_imputed"), F.col(f"{phase}_grid_interp").alias("grid_interpolated"))
        return samples.select("sample_id", F.lit(phase).alias("phase"), F.posexplode(parts).alias("step", "_p")).select("sample_id", "phase", "step", "_p.*")

    return side("hist").unionByName(side("fut"))
