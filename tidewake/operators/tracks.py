"""Track segments: sessionise, label, fill gaps, resample, reject anomalies.

All windows are keyed by (mmsi, segment_id) or mmsi alone, so that one exchange on mmsi serves the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import geo, text
from ..plans.config import DEFAULT, KNOTS_PER_MPS, Thresholds

SEGMENT = ("mmsi", "segment_id")


def in_time() -> WindowSpec:
    """Rows of a segment by microseconds, which frames of a range need; all windows of one stage share its sort."""
    return Window.partitionBy(*SEGMENT).orderBy(F.unix_micros("timestamp_utc"))


def along(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or SEGMENT)).orderBy("timestamp_utc")


def seconds(a: Column, b: Column) -> Column:
    """From b to a."""
    return (F.unix_micros(a) - F.unix_micros(b)) / 1e6


def co_located(df: DataFrame) -> DataFrame:
    """All rows of a vessel in one partition: the one exchange of the chain, kept by stage tables in buckets."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mmsi")


def segment_tracks(df: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Cut each vessel's messages where time or the implied speed jumps.

    Of rows of one vessel and time the first by _ingest_order counts; without that column, the one of least latitude.
    """
    w = along("mmsi")
    first = F.row_number().over(Window.partitionBy("mmsi", "timestamp_utc").orderBy(*[F.col(c) for c in ("_ingest_order",) if c in df.columns] or [F.col("lat")])) == 1
    df = df.withColumn("_first", first).where("_first").drop("_first")
    prev = lambda c: F.lag(c).over(w)
    df = df.withColumns({"_t": prev("timestamp_utc"), "_lat": prev("lat"), "_lon": prev("lon"), "_sog": prev("sog"), "_cap": prev("shiptype_soft_cap_knots")})
    dt = seconds(F.col("timestamp_utc"), F.col("_t"))
    implied = geo.haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) / dt * KNOTS_PER_MPS
    zero, cap = lambda c: F.coalesce(F.col(c), F.lit(0.0)), lambda c: F.coalesce(F.col(c), F.lit(limits.hard_cap_knots))
    most = F.greatest(limits.implied_speed_factor * F.greatest(zero("_sog"), zero("sog")), F.greatest(cap("_cap"), cap("shiptype_soft_cap_knots")) + limits.implied_speed_margin_knots)
    df = df.withColumns({"dt_to_prev_seconds": dt, "implied_speed_from_prev_knots": implied, "_most": most})
    reason = F.when(F.col("_t").isNull(), "start").when(F.col("dt_to_prev_seconds") > limits.segment_gap_s, "time_gap").when(F.col("implied_speed_from_prev_knots") > F.col("_most"), "implied_speed").otherwise("continue")
    df = df.withColumn("segment_break_before", reason)
    number = F.sum((F.col("segment_break_before") != "continue").cast("int")).over(w) - 1
    return df.withColumn("segment_id", F.format_string("%d_%06d", "mmsi", number)).drop("_t", "_lat", "_lon", "_sog", "_cap", "_most")


def segment_summary(df: DataFrame) -> DataFrame:
    span = (F.min("timestamp_utc").alias("start_time"), F.max("timestamp_utc").alias("end_time"), F.count("*").alias("num_points"))
    return df.groupBy(*SEGMENT).agg(*span)


def longest_runs(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """Per segment the longest time between first and last row of a run of rows whose flag is true; 0 if none."""
    df = df.select(*SEGMENT, "timestamp_utc", F.coalesce(flag, F.lit(False)).alias("_flag"))
    df = df.withColumn("_turned", F.coalesce(F.col("_flag") != F.lag("_flag").over(in_time()), F.lit(True)))
    return df.withColumn("_s", _since("_flag", "_turned")).groupBy(*SEGMENT).agg(F.max("_s").alias(name))


def _since(flag: str, turned: str) -> Column:
    """Seconds since the flag last turned, where it is true."""
    began = F.last(F.when(F.col(turned), F.col("timestamp_utc")), ignorenulls=True).over(in_time().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(F.col(flag), seconds(F.col("timestamp_utc"), began)).otherwise(0.0)


def low_displacement(limits: Thresholds = DEFAULT) -> Column:
    """True where the first row that is a window's length later lies within the displacement limit.

    Rows of a segment are at most segment_gap_s apart, so that row comes within so much after the window: the frame ends there.
    """
    first = limits.low_displacement_window_s * 1_000_000
    w = in_time().rangeBetween(first, first + int(limits.segment_gap_s * 1_000_000))
    later = F.first(F.struct("lat", "lon")).over(w)
    return F.coalesce(geo.haversine_m(F.col("lat"), F.col("lon"), later["lat"], later["lon"]) < limits.low_displacement_m, F.lit(False))


def anchored() -> Column:
    return F.coalesce(F.lower("nav_status").rlike("anchor|moored"), F.lit(False))


def _with_runs(df: DataFrame, limits: Thresholds) -> DataFrame:
    """_sa and _sl: seconds into an anchored or slow run; _still: hardly moved for a window's length. One sort for all."""
    low = F.coalesce(F.col("sog") < limits.low_speed_knots, F.lit(False))
    df = df.withColumns({"_anchor": anchored(), "_low": low})
    turned = lambda c: F.coalesce(F.col(c) != F.lag(c).over(in_time()), F.lit(True))
    df = df.withColumns({"_ta": turned("_anchor"), "_tl": turned("_low"), "_still": low_displacement(limits)})
    return df.withColumns({"_sa": _since("_anchor", "_ta"), "_sl": _since("_low", "_tl")})


def _excluded(anchor_s: Column, low_s: Column, still: Column, limits: Thresholds) -> Column:
    return (anchor_s >= limits.anchor_run_s) | (low_s >= limits.low_speed_run_s) | still


def segment_labels(df: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Per segment: size, span, displacement, longest anchored and slow runs, low displacement, and whether to exclude it."""
    df = _with_runs(df, limits)
    end = lambda f: f(F.struct("lat", "lon"), "timestamp_utc")
    per = df.groupBy(*SEGMENT).agg(
        F.count("*").alias("num_points"), F.min("timestamp_utc").alias("start_time"), F.max("timestamp_utc").alias("end_time"),
        end(F.min_by).alias("_a"), end(F.max_by).alias("_b"), F.max("_still").alias("has_low_displacement_20min_window"),
        F.max("_sa").alias("longest_anchor_or_moored_seconds"), F.max("_sl").alias("longest_low_speed_seconds"),
    )
    per = per.withColumn("duration_seconds", seconds(F.col("end_time"), F.col("start_time")))
    per = per.withColumn("end_to_end_displacement_m", geo.haversine_m(F.col("_a.lat"), F.col("_a.lon"), F.col("_b.lat"), F.col("_b.lon"))).drop("_a", "_b")
    return per.withColumn("exclude_from_underway_only", _excluded(F.col("longest_anchor_or_moored_seconds"), F.col("longest_low_speed_seconds"), F.col("has_low_displacement_20min_window"), limits))


def underway(df: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Rows of segments that segment_labels doesn't exclude, by windows over the segment instead of a join with its labels."""
    most = lambda c: F.max(c).over(Window.partitionBy(*SEGMENT))
    out = _with_runs(df, limits).withColumn("_out", _excluded(most("_sa"), most("_sl"), most("_still"), limits))
    return out.where("not _out").select(*df.columns)


def underway_only(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels.where("exclude_from_underway_only").select(*SEGMENT), list(SEGMENT), "left_anti")


def gap_class(dt: Column, limits: Thresholds = DEFAULT) -> Column:
    return F.when(dt.isNull(), "start").when(dt <= limits.step_s, "none").when(dt <= limits.short_gap_s, "short").when(dt <= limits.medium_gap_s, "medium").otherwise("long")


def with_gaps(df: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    dt = seconds(F.col("timestamp_utc"), F.lag("timestamp_utc").over(along()))
    return df.withColumn("gap_class_before", gap_class(dt, limits))


MOVING = ("timestamp_utc", "lat", "lon", "sog", "cog", "heading")


def _blend(alpha: Column, limits: Thresholds) -> dict[str, Column]:
    """Values between a row and the next (struct _n) at the share alpha."""
    n = lambda c: F.col(f"_n.{c}")
    line = lambda c: (1 - alpha) * F.col(c) + alpha * n(c)
    return {
        "lat": line("lat"), "lon": line("lon"), "sog": geo.guarded_interp(F.col("sog"), n("sog"), alpha, limits.sog_interp_diff_knots),
        "cog": geo.circular_interp(F.col("cog"), n("cog"), alpha), "heading": geo.circular_interp(F.col("heading"), n("heading"), alpha),
    }


def _later(us: Column) -> Column:
    return F.timestamp_micros(us)


def fill_short_gaps(df: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Points every step inside gaps up to the short limit; other columns are those of the row before.

    A row and the points after it come from one pass: number 0 is the row itself.
    """
    df = with_gaps(df, limits).withColumn("_n", F.lead(F.struct(*MOVING)).over(along()))
    us, dt = F.unix_micros("timestamp_utc"), seconds(F.col("_n.timestamp_utc"), F.col("timestamp_utc"))
    step = limits.step_s * 1_000_000
    last = F.when((dt > limits.step_s) & (dt <= limits.short_gap_s), F.ceil(dt / limits.step_s).cast("int") - 1).otherwise(0)
    df = df.withColumn("_k", F.explode(F.sequence(F.lit(0), last)))
    own, alpha = F.col("_k") == 0, F.col("_k") * limits.step_s / dt
    between = _blend(alpha, limits) | {"timestamp_utc": _later(us + F.col("_k") * step), "gap_class_before": F.lit("short")}
    return df.withColumns({c: F.when(own, F.col(c)).otherwise(v) for c, v in between.items()} | {"is_interpolated_obs": ~own}).drop("_n", "_k")


def resplit(df: DataFrame, gap_s: float) -> DataFrame:
    """Number of the piece within its segment, as _piece, a new one after each gap over gap_s."""
    fresh = F.coalesce((seconds(F.col("timestamp_utc"), F.lag("timestamp_utc").over(along())) > gap_s).cast("int"), F.lit(0))
    return df.withColumn("_fresh", fresh).withColumn("_piece", F.sum("_fresh").over(along())).drop("_fresh")


def resample(df: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """A grid of whole steps within pieces without gaps over the short limit; pieces of one row go before numbering."""
    df = resplit(df, limits.short_gap_s)
    df = df.withColumn("_size", F.count("*").over(Window.partitionBy(*SEGMENT, "_piece"))).where("_size >= 2")
    df = df.withColumn("_number", F.dense_rank().over(Window.partitionBy(*SEGMENT).orderBy("_piece")) - 1)
    w = Window.partitionBy(*SEGMENT, "_piece").orderBy("timestamp_utc")
    df = df.withColumn("_n", F.lead(F.struct(*MOVING)).over(w))
    step, us = limits.step_s * 1_000_000, F.unix_micros("timestamp_utc")
    end = F.coalesce(F.unix_micros(F.col("_n.timestamp_utc")) - 1, us)
    low, high = F.ceil(us / step).cast("long"), F.floor(end / step).cast("long")
    df = df.where(low <= high).withColumn("_g", F.explode(F.sequence(low, high))).withColumn("_g", F.col("_g") * step)
    exact = F.col("_g") == us
    alpha = (F.col("_g") - us) / (F.unix_micros(F.col("_n.timestamp_utc")) - us)
    values = {c: F.when(exact, F.col(c)).otherwise(v) for c, v in _blend(alpha, limits).items()}
    flags = {
        "is_resampled_point": F.lit(True), "is_grid_interpolated_point": ~exact,
        "is_gap_imputed_point": exact & F.coalesce(F.col("is_interpolated_obs"), F.lit(False)), "is_interpolated_point": exact & F.coalesce(F.col("is_interpolated_obs"), F.lit(False)),
    }
    df = df.withColumns(values | flags | {"timestamp_utc": _later(F.col("_g")), "segment_id": F.format_string("%s_r%02d", "segment_id", F.col("_number"))})
    return df.drop("_g", "_n", "_number", "_size", "_piece")


def anomaly_flags(df: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """_size, and _spike: rows off the median of three by more than the offset while moving faster than the cap allows."""
    w = along()
    side = lambda f: f(F.struct("timestamp_utc", "lat", "lon")).over(w)
    df = df.withColumns({"_p": side(F.lag), "_q": side(F.lead), "_size": F.count("*").over(Window.partitionBy(*SEGMENT)), "_type": F.first("ship_type").over(w)})
    middle = lambda c: F.col(f"_p.{c}") + F.col(c) + F.col(f"_q.{c}") - F.greatest(F.col(f"_p.{c}"), F.col(c), F.col(f"_q.{c}")) - F.least(F.col(f"_p.{c}"), F.col(c), F.col(f"_q.{c}"))
    off = geo.haversine_m(F.col("lat"), F.col("lon"), middle("lat"), middle("lon"))
    speed = lambda o: geo.haversine_m(F.col("lat"), F.col("lon"), F.col(f"{o}.lat"), F.col(f"{o}.lon")) / F.abs(seconds(F.col("timestamp_utc"), F.col(f"{o}.timestamp_utc"))) * KNOTS_PER_MPS
    cap = F.coalesce(text.class_value(text.ship_class(F.col("_type")), limits.caps), F.lit(limits.hard_cap_knots))
    inner = F.col("_p").isNotNull() & F.col("_q").isNotNull() & (F.col("_size") >= 3)
    spike = inner & (off > limits.anomaly_offset_m) & (F.greatest(speed("_p"), speed("_q")) > cap + limits.anomaly_margin_knots)
    return df.withColumn("_spike", F.coalesce(spike, F.lit(False))).drop("_p", "_q", "_type")


def reject_anomalies(df: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Without spikes, cut again at gaps; segments of less than three points pass as they are."""
    df = resplit(anomaly_flags(df, limits).where("not _spike"), limits.anomaly_gap_s)
    named = F.when(F.col("_size") < 3, F.col("segment_id")).otherwise(F.format_string("%s_c%02d", "segment_id", "_piece"))
    return df.withColumn("segment_id", named).drop("_spike", "_size", "_piece")


def long_segments(df: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Rows of segments with enough points over enough time."""
    w = Window.partitionBy(*SEGMENT)
    df = df.withColumns({"_n": F.count("*").over(w), "_s": seconds(F.max("timestamp_utc").over(w), F.min("timestamp_utc").over(w))})
    return df.where((F.col("_n") >= limits.min_points) & (F.col("_s") >= limits.min_duration_s)).drop("_n", "_s")
