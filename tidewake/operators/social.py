"""Interaction features: vessel states with their histories, nearest neighbours at one time, closest approaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .asof import asof_join
from .tracks import SEGMENT, along

STATE = ("lat", "lon", "sog", "cog", "heading")
#: Metres of a degree of latitude, of longitude at the equator, in the plane that distances are taken in.
DEGREE_LAT_M, DEGREE_LON_M = 110_540.0, 111_320.0


def _cells(radius_m: float, lat: str, lon: str, around: bool) -> Column:
    """Cells (band, column) of about the radius that a place is in, or all nine around it.

    A band's columns are wide enough at its edge nearest to a pole, so two places within the radius are never farther
    apart than neighbouring cells of the first one's band.
    """
    height = radius_m * 1.01 / DEGREE_LAT_M
    band = F.floor(F.col(lat) / height)

    def column(b: Column) -> Column:
        edge = F.least(F.greatest(F.abs(b * height), F.abs((b + 1) * height)), F.lit(89.9))
        return F.floor(F.col(lon) / (radius_m * 1.01 / (DEGREE_LON_M * F.cos(F.radians(edge)))))

    if not around:
        return F.struct(band.alias("band"), column(band).alias("column"))
    return F.array(*[F.struct((band + y).alias("band"), (column(band + y) + x).alias("column")) for y in (-1, 0, 1) for x in (-1, 0, 1)])


def _numbered(points: DataFrame, history: int) -> DataFrame:
    return points.select("timestamp_utc", *SEGMENT, "ship_type", *STATE, (F.row_number().over(along()) - 1).alias("_i")).withColumn("_block", F.floor(F.col("_i") / history))


def _at_times(numbered: DataFrame, times: DataFrame, history: int) -> DataFrame:
    return numbered.join(times.select("timestamp_utc").distinct(), "timestamp_utc", "left_semi").where(F.col("_i") >= history - 1)


def states(points: DataFrame, times: DataFrame, history: int = 30) -> DataFrame:
    """The rows of snapshots without their histories, for which nothing is gathered."""
    return _at_times(_numbered(points, history), times, history).select("timestamp_utc", *SEGMENT, "ship_type", *STATE)


def snapshots(points: DataFrame, times: DataFrame, history: int = 30) -> DataFrame:
    """State and trailing history of each row with enough of it, at the wanted times only.

    Rows of a segment are numbered and lie in blocks of `history` rows, so a history is in two blocks at most: the wanted
    ends look up their blocks by number, and lists are gathered for those alone.
    """
    numbered = _numbered(points, history)
    ends = _at_times(numbered, times, history)
    wanted = ends.select(*SEGMENT, F.col("_i").alias("_end"), F.explode(F.array_distinct(F.array(F.floor((F.col("_i") - (history - 1)) / history), F.col("_block")))).alias("_block"))
    held = numbered.join(wanted.select(*SEGMENT, "_block").distinct(), [*SEGMENT, "_block"], "left_semi")
    blocks = held.groupBy(*SEGMENT, "_block").agg(F.array_sort(F.collect_list(F.struct("_i", *STATE))).alias("_rows"))
    past = wanted.join(blocks, [*SEGMENT, "_block"]).groupBy(*SEGMENT, "_end").agg(F.array_sort(F.collect_list(F.struct("_block", "_rows"))).alias("_b"))
    rows = F.flatten(F.transform("_b", lambda b: b["_rows"]))
    past = past.select(*SEGMENT, F.col("_end").alias("_i"), F.filter(rows, lambda r: r["_i"].between(F.col("_end") - (history - 1), F.col("_end"))).alias("_h"))
    return ends.join(past, [*SEGMENT, "_i"]).select("timestamp_utc", "mmsi", "segment_id", "ship_type", *STATE, *[_field("_h", c).alias(f"hist_{c}") for c in STATE])


def _field(rows: str, name: str) -> Column:
    """One field of each struct of an array."""
    return F.transform(rows, lambda r: r[name])


def neighbours(targets: DataFrame, snaps: DataFrame, radius_m: float = 3000.0) -> DataFrame:
    """(sample_id, distance, relative place and speed, approach, rank, total) of other vessels near a target at its time.

    targets: sample_id, mmsi, segment_id, hist_end_ts. Times are divided into cells of about the radius, and a neighbour is
    in its own cell and the eight around it, so one busy time doesn't meet in one task. Only ids and states are copied; a
    neighbour's other columns can be joined by (timestamp_utc, n_mmsi, n_segment_id).
    """
    own = targets.select("sample_id", "mmsi", "segment_id", F.col("hist_end_ts").alias("timestamp_utc"))
    own = own.join(snaps.select("timestamp_utc", "mmsi", "segment_id", *STATE), ["timestamp_utc", "mmsi", "segment_id"]).withColumn("_cell", _cells(radius_m, "lat", "lon", False))
    other = snaps.select("timestamp_utc", *[F.col(c).alias(f"n_{c}") for c in ("mmsi", "segment_id", "ship_type", *STATE)]).withColumn("_cell", F.explode(_cells(radius_m, "n_lat", "n_lon", True)))
    x, y = geo.planar_x(F.col("n_lon"), F.col("lat"), F.col("lon")), geo.planar_y(F.col("n_lat"), F.col("lat"))
    df = own.join(other, ["timestamp_utc", "_cell"]).where(F.col("mmsi") != F.col("n_mmsi")).withColumns({"_x": x, "_y": y}).withColumn("distance_m", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))).where(F.col("distance_m") <= radius_m)
    (vx, vy), (nx, ny) = geo.velocity(F.col("sog"), F.col("cog")), geo.velocity(F.col("n_sog"), F.col("n_cog"))
    df = df.withColumns({"rel_vx": nx - vx, "rel_vy": ny - vy})
    cpa, tcpa = geo.approach(F.col("_x"), F.col("_y"), F.col("rel_vx"), F.col("rel_vy"))
    w = Window.partitionBy("sample_id")
    df = df.withColumns({"cpa_m": cpa, "tcpa_s": tcpa, "total": F.count("*").over(w), "rank": F.row_number().over(w.orderBy("distance_m", "n_mmsi", "n_segment_id"))})
    return df.drop("_cell", "_x", "_y")


def nearest(df: DataFrame, k: int = 8) -> DataFrame:
    return df.where(F.col("rank") <= k)


def density_bin(n: Column) -> Column:
    return F.when(n >= 7, "dense").when(n >= 4, "medium").when(n >= 1, "sparse").otherwise("isolated")


def social_features(targets: DataFrame, snaps: DataFrame, radius_m: float = 3000.0, k: int = 8, flag_from: int = 3) -> DataFrame:
    """Each target with its state, neighbour arrays in order of distance and their summary; empty where there is no state.

    snaps of states have no histories, and then neighbours have none: nothing of the kind is joined, gathered or kept.
    """
    same, histories = ("timestamp_utc", "n_mmsi", "n_segment_id"), "hist_lat" in snaps.columns
    near = nearest(neighbours(targets, snaps, radius_m), k)
    if histories:
        near = near.join(snaps.select("timestamp_utc", F.col("mmsi").alias("n_mmsi"), F.col("segment_id").alias("n_segment_id"), *[F.col(f"hist_{c}").alias(f"n_hist_{c}") for c in STATE]), list(same))
    rel_x = F.transform("n_hist_lon", lambda v: geo.planar_x(v, F.col("lat"), F.col("lon")))
    rel_y = F.transform("n_hist_lat", lambda v: geo.planar_y(v, F.col("lat")))
    fields = {
        "mmsi": F.col("n_mmsi"), "segment_id": F.col("n_segment_id"), "ship_type": F.col("n_ship_type"), "distance_m": F.col("distance_m"), "rel_hist_x": rel_x, "rel_hist_y": rel_y, "hist_sog": F.col("n_hist_sog"),
        "hist_cog": F.col("n_hist_cog"), "hist_heading": F.col("n_hist_heading"), "rel_vx_mps": F.col("rel_vx"), "rel_vy_mps": F.col("rel_vy"), "cpa_m": F.col("cpa_m"), "tcpa_s": F.col("tcpa_s"),
    }
    if not histories:
        fields = {n: c for n, c in fields.items() if "hist_" not in n}
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("rank"), *[c.alias(n) for n, c in fields.items()])))
    each = near.groupBy("sample_id").agg(rows.alias("_r"), F.first("total").alias("_total"), F.min("distance_m").alias("min_neighbor_distance_m"), F.avg("distance_m").alias("mean_neighbor_distance_m"), F.min("cpa_m").alias("min_cpa_m"), F.min(F.abs("tcpa_s")).alias("min_abs_tcpa_s"))
    each = each.select("sample_id", *[_field("_r", n).alias(f"neighbor_{n}") for n in fields], "_total", *each.columns[3:])
    state = snaps.select(F.col("timestamp_utc").alias("hist_end_ts"), "mmsi", "segment_id", F.col("lat").alias("target_global_lat"), F.col("lon").alias("target_global_lon"), *[F.col(c).alias(f"target_{c}_hist_end") for c in STATE[2:]])
    df = targets.join(state, ["hist_end_ts", "mmsi", "segment_id"], "left").join(each, "sample_id", "left")
    total = F.coalesce("_total", F.lit(0)).cast("long")
    empty = {f"neighbor_{n}": F.coalesce(f"neighbor_{n}", F.array().cast(dict(df.dtypes)[f"neighbor_{n}"])) for n in fields}
    return df.withColumns(empty | {
        "neighbor_count_total": total, "neighbor_count_used": F.least(total, F.lit(k)), "neighbor_density_bin": density_bin(total),
        "social_context_available": F.col("target_global_lat").isNotNull().cast("int"), "interaction_candidate": (total >= flag_from).cast("int"),
    }).drop("_total")


def social_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count("*").alias("samples"), F.sum("social_context_available").alias("available"), F.sum("interaction_candidate").alias("candidates"), F.count_if(F.col("neighbor_count_total") > 0).alias("with_neighbours"),
        F.avg("neighbor_count_total").alias("mean_count"), *[F.count_if(F.col("neighbor_density_bin") == b).alias(b) for b in ("isolated", "sparse", "medium", "dense")],
    )


def nearest_in_time(points: DataFrame, targets: DataFrame) -> DataFrame:
    """The row of each target's segment that is nearest to its time; ties go to the earlier one. Targets without any are left out."""
    df = asof_join(targets.select("sample_id", *SEGMENT, "hist_end_ts"), points, list(SEGMENT), "hist_end_ts", "timestamp_utc", ["lat", "lon"], "nearest")
    return df.where("match is not null").select("sample_id", "match.*")


def nearby_tracks(target: DataFrame, snaps: DataFrame, points: DataFrame, radius_m: float = 2000.0, last: int = 15) -> DataFrame:
    """For each target the last points, up to its time, of other segments that are near at that time.

    snaps are rows of points. A segment's points are numbered once and the wanted numbers looked up, so no past is read whole.
    """
    own = target.select("sample_id", "mmsi", "segment_id", F.col("hist_end_ts").alias("timestamp_utc")).join(snaps.select("timestamp_utc", "mmsi", "segment_id", "lat", "lon"), ["timestamp_utc", "mmsi", "segment_id"])
    own = own.withColumn("_cell", _cells(radius_m, "lat", "lon", False))
    other = snaps.select("timestamp_utc", F.col("segment_id").alias("n_segment_id"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon")).withColumn("_cell", F.explode(_cells(radius_m, "n_lat", "n_lon", True)))
    near = own.join(other, ["timestamp_utc", "_cell"]).where((F.col("segment_id") != F.col("n_segment_id")) & (F.hypot(geo.planar_x(F.col("n_lon"), F.col("lat"), F.col("lon")), geo.planar_y(F.col("n_lat"), F.col("lat"))) <= radius_m))
    near = near.select("sample_id", F.col("n_segment_id").alias("segment_id"), F.col("timestamp_utc").alias("hist_end_ts")).distinct()
    numbered = points.select("segment_id", "timestamp_utc", "lat", "lon", F.row_number().over(Window.partitionBy("segment_id").orderBy("timestamp_utc")).alias("_i"))
    ends = near.join(numbered.select("segment_id", F.col("timestamp_utc").alias("hist_end_ts"), F.col("_i").alias("_end")), ["segment_id", "hist_end_ts"])
    wanted = ends.select("sample_id", "segment_id", "_end", F.explode(F.sequence(F.lit(1), F.least(F.lit(last), F.col("_end")))).alias("back")).withColumn("_i", F.col("_end") - F.col("back") + 1)
    return wanted.join(numbered, ["segment_id", "_i"]).select("segment_id", "sample_id", "timestamp_utc", "lat", "lon", "back")


def left_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], required: bool = False) -> DataFrame:
    """Left join of tables with unique keys, taking new columns only; required: an error where the right side is missing."""
    from .reports import assert_unique

    new = [c for c in right.columns if c not in left.columns or c in keys]
    df = assert_unique(left, *keys).join(assert_unique(right.select(*new), *keys).withColumn("_here", F.lit(True)), keys, "left")
    if required:
        df = df.where(F.when(F.col("_here").isNull(), F.raise_error(F.lit(f"missing rows for {keys}")).cast("boolean")).otherwise(True))
    return df.drop("_here")


