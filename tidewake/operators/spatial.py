"""Map context: ways near samples, clipped to a square about each anchor, as features and rasters; scene and region groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, grids
from ..plans.config import EARTH_RADIUS_M
from ..plans.stages import shared_folder, ship_code

#: Tag values of the two way categories.
SHORE_WATERWAYS, FRONT_STRUCTURES = ("riverbank", "dock", "canal"), ("pier", "breakwater", "groyne", "quay")
LABELS = {1: ("shoreline", "waterfront"), 2: ("natural_boundary", "manmade_boundary")}


def classify_way(tags: Column, version: int = 1) -> Column:
    """(category, subtype) by the first matching tag; null for other ways."""
    shore, front = LABELS[version]
    made = lambda category, subtype: F.struct(F.lit(category).alias("category"), subtype.alias("subtype"))
    return (
        F.when(tags["natural"] == "coastline", made(shore, F.lit("coastline"))).when(tags["waterway"].isin(*SHORE_WATERWAYS), made(shore, tags["waterway"]))
        .when(tags["man_made"].isin(*FRONT_STRUCTURES), made(front, tags["man_made"])).when(tags["landuse"] == "port", made(front, F.lit("port_boundary")))
    )


def parse_ways(elements: DataFrame, version: int = 1) -> DataFrame:
    """(osm_id, category, subtype, geom) of elements (type, id, tags, geometry): classified ways of two nodes or more."""
    kind = classify_way(F.col("tags"), version)
    ways = elements.where((F.col("type") == "way") & (F.size("geometry") >= 2)).withColumn("_kind", kind).where("_kind is not null")
    return ways.select(F.col("id").alias("osm_id"), "_kind.category", "_kind.subtype", F.col("geometry").alias("geom"))


def tile_corner(v: Column, deg: float) -> Column:
    return F.floor(v / deg) * F.lit(deg)


def tile_id(lat: Column, lon: Column, deg: float = 0.25) -> Column:
    return F.format_string("%+08.3f_%+09.3f", tile_corner(lat, deg).cast("double"), tile_corner(lon, deg).cast("double"))


def recover_anchors(samples: DataFrame, points: DataFrame, deg: float = 0.25, order: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """anchor_lat, anchor_lon and tile_id of each sample from the point at the end of its history; an error if one is missing.

    Of several points of one segment and time the last by `order` counts (such as the number of a row in its file).
    """
    last = F.max_by(F.struct("lat", "lon"), F.struct(*order)).alias("_at")
    at = points.groupBy("mmsi", "segment_id", F.col("timestamp_utc").alias("hist_end_ts")).agg(last).select("mmsi", "segment_id", "hist_end_ts", F.col("_at.lat").alias("anchor_lat"), F.col("_at.lon").alias("anchor_lon"))
    df = samples.join(at, ["mmsi", "segment_id", "hist_end_ts"], "left")
    known = F.coalesce("anchor_lat", F.raise_error(F.concat(F.lit("no anchor for "), "sample_id")).cast("double"))
    return df.withColumn("anchor_lat", known).withColumn("tile_id", tile_id(F.col("anchor_lat"), F.col("anchor_lon"), deg))


def way_segments(ways: DataFrame) -> DataFrame:
    """(osm_id, category, subtype, la, lo, lb, lp): each way's segments between neighbouring nodes."""
    pairs = F.transform(F.slice("geom", F.lit(2), F.greatest(F.size("geom") - 1, F.lit(0))), lambda q, i: F.struct(F.get("geom", i).alias("p"), q.alias("q")))
    parts = ways.select("osm_id", "category", "subtype", F.explode(pairs).alias("_s"))
    return parts.select("osm_id", "category", "subtype", F.col("_s.p.lat").alias("la"), F.col("_s.p.lon").alias("lo"), F.col("_s.q.lat").alias("lb"), F.col("_s.q.lon").alias("lp"))


def by_cells(segments: DataFrame, radius_m: float, deg: float, y: str = "_y", x: str = "_x", occupied: DataFrame | None = None) -> DataFrame:
    """Segments, one row for every cell of a grid that they come within the radius of (east, west, north or south).

    The grid is walked row by row: the stretch of a segment beside a row's parallels bounds the columns it meets there, so
    copies follow the cells crossed, not the segment's box. occupied: the cells (y, x) wanted, others are left out; columns
    are cut to those of the row's cells before they are listed, as near a pole a radius spans every meridian.
    """
    dy = radius_m * 1.1 / EARTH_RADIUS_M * 57.29578
    reach = F.lit(dy) / F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs("la"), F.abs("lb")) + dy, F.lit(89.9 if occupied is None else 90.0)))), F.lit(1e-6))
    df = segments.withColumns({"_dx": reach, y: F.explode(F.sequence(F.floor((F.least("la", "lb") - dy) / deg), F.floor((F.greatest("la", "lb") + dy) / deg)))})
    # longitudes where the segment enters and leaves the widened row; a segment along a parallel is in it whole
    share = lambda edge: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge - F.col("la")) / (F.col("lb") - F.col("la"))))
    at = lambda edge: F.when(F.col("la") == F.col("lb"), None).otherwise(F.col("lo") + share(edge) * (F.col("lp") - F.col("lo")))
    a, b = at(F.col(y) * deg - dy), at((F.col(y) + 1) * deg + dy)
    west, east = F.least(F.coalesce(a, F.col("lo")), F.coalesce(b, F.col("lp"))) - F.col("_dx"), F.greatest(F.coalesce(a, F.col("lo")), F.coalesce(b, F.col("lp"))) + F.col("_dx")
    df = df.withColumns({"_first": F.floor(west / deg), "_last": F.floor(east / deg)})
    if occupied is not None:
        rows = occupied.groupBy(y).agg(F.min(x).alias("_west"), F.max(x).alias("_east"))
        df = df.join(rows, y).withColumns({"_first": F.greatest("_first", "_west"), "_last": F.least("_last", "_east")}).where("_first <= _last").drop("_west", "_east")
    df = df.withColumn(x, F.explode(F.sequence("_first", "_last"))).drop("_dx", "_first", "_last")
    return df if occupied is None else df.join(occupied.select(y, x).distinct(), [y, x], "left_semi")


#: A cell of more segments than this is divided into SPLIT by SPLIT cells.
HOT, SPLIT = 2000, 8


def clipped_segments(anchors: DataFrame, ways: DataFrame, radius_m: float, deg: float = 0.25) -> DataFrame:
    """(sample_id, osm_id, category, subtype, x0, y0, x1, y1): parts of way segments within the square about each anchor.

    Ways are taken apart first, and each segment is filed by the cells with anchors that it comes near; anchors look up their
    own cell.
    Cells of many segments are divided, for anchors and segments alike, so a harbour's pairs are those of small cells.
    """
    segments = way_segments(ways)
    own = anchors.select("sample_id", "anchor_lat", "anchor_lon", F.floor(F.col("anchor_lat") / (deg / SPLIT)).alias("_v"), F.floor(F.col("anchor_lon") / (deg / SPLIT)).alias("_u"))
    own = own.withColumns({"_y": F.floor(F.col("_v") / SPLIT), "_x": F.floor(F.col("_u") / SPLIT)})
    filed = by_cells(segments, radius_m, deg, occupied=own.select("_y", "_x").distinct())
    hot = filed.groupBy("_y", "_x").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select("_y", "_x", F.lit(True).alias("_hot"))
    marked = filed.join(hot, ["_y", "_x"], "left")
    fine = by_cells(marked.where("_hot"), radius_m, deg / SPLIT, "_v", "_u", own.join(hot, ["_y", "_x"], "left_semi").select("_v", "_u").distinct()).where((F.floor(F.col("_v") / SPLIT) == F.col("_y")) & (F.floor(F.col("_u") / SPLIT) == F.col("_x")))
    filed = marked.where("_hot is null").withColumns({"_v": F.lit(None).cast("long"), "_u": F.lit(None).cast("long")}).unionByName(fine).drop("_hot")
    own = own.join(hot, ["_y", "_x"], "left")
    own = own.withColumns({c: F.when(F.col("_hot"), F.col(c)) for c in ("_v", "_u")}).drop("_hot")
    none = F.lit(-(1 << 40)).cast("long")  # no cell's number
    keyed = lambda df: df.withColumns({"_v": F.coalesce("_v", none), "_u": F.coalesce("_u", none)})
    near = keyed(own).join(keyed(filed), ["_y", "_x", "_v", "_u"])
    x = lambda c: geo.local_x(F.col(c), F.col("anchor_lat"), F.col("anchor_lon"))
    y = lambda c: geo.local_y(F.col(c), F.col("anchor_lat"))
    parts = near.select("sample_id", "osm_id", "category", "subtype", x("lo").alias("a"), y("la").alias("b"), x("lp").alias("c"), y("lb").alias("d"))
    enter, leave = geo.clip_square(F.col("a"), F.col("b"), F.col("c"), F.col("d"), radius_m)
    parts = parts.withColumns({"_t0": enter, "_t1": leave}).where("_t0 <= _t1")
    single = lambda p, q, t: (F.col(p) + F.col(t) * (F.col(q) - F.col(p))).cast("float").cast("double")
    return parts.select("sample_id", "osm_id", "category", "subtype", single("a", "c", "_t0").alias("x0"), single("b", "d", "_t0").alias("y0"), single("a", "c", "_t1").alias("x1"), single("b", "d", "_t1").alias("y1"))


def category_summary(segments: DataFrame) -> DataFrame:
    """Per sample and category: least distance, number, length, and numbers within 250, 500 and 1000 m."""
    c = [F.col(k) for k in ("x0", "y0", "x1", "y1")]
    df = segments.withColumns({"_d": geo.point_segment_m(*c), "_l": F.hypot(c[2] - c[0], c[3] - c[1])})
    within = [F.count_if(F.col("_d") <= m).alias(f"near_{m}m") for m in (250, 500, 1000)]
    return df.groupBy("sample_id", "category").agg(F.min("_d").alias("min_dist_m"), F.count("*").alias("segment_count"), F.sum("_l").alias("total_length_m"), *within)


def raster_cells(segments: DataFrame, radius_m: float, size: int, step_m: float, flip: bool = False) -> DataFrame:
    """(sample_id, category, gy, gx) of cells met by points every step along segments; flip: rows grow southwards."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    n = F.greatest(F.lit(2), F.ceil((F.greatest(length, F.lit(1.0)) if flip else length) / max(step_m, 1.0)).cast("int") + 1)
    df = segments.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    point = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("_i") / (F.col("_n") - 1))
    cell = lambda v: F.floor(v / (2.0 * radius_m) * size).cast("int")
    y = F.lit(radius_m) - point("y0", "y1") if flip else point("y0", "y1") + radius_m
    df = df.select("sample_id", "category", cell(y).alias("gy"), cell(point("x0", "x1") + radius_m).alias("gx"))
    return df.where(F.col("gy").between(0, size - 1) & F.col("gx").between(0, size - 1)).distinct()


def dilate_cells(cells: DataFrame, radius_px: int, size: int) -> DataFrame:
    """Cells within a disk of any cell, inside the grid."""
    r = range(-radius_px, radius_px + 1)
    disk = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in r for dx in r if dy * dy + dx * dx <= radius_px**2])
    df = cells.withColumn("_o", F.explode(disk)).withColumns({"gy": F.col("gy") + F.col("_o.dy"), "gx": F.col("gx") + F.col("_o.dx")}).drop("_o")
    return df.where(F.col("gy").between(0, size - 1) & F.col("gx").between(0, size - 1)).distinct()


def environment_v1(anchors: DataFrame, ways: DataFrame, radius_m: float = 2048.0, size: int = 64, step_m: float = 24.0, deg: float = 0.25) -> DataFrame:
    """Shoreline and waterfront features of each sample; without any, distances are twice the radius."""
    parts = clipped_segments(anchors, ways, radius_m, deg)
    cells = raster_cells(parts, radius_m, size, step_m).groupBy("sample_id", "category").agg(F.count("*").alias("occupancy"))
    stats = category_summary(parts).join(cells, ["sample_id", "category"], "left")
    rest = [c for c in stats.columns if c not in ("sample_id", "category")]
    # one row for each sample, so clipping and cells are computed and joined once for both categories
    both = stats.groupBy("sample_id").agg(*[F.first(F.when(F.col("category") == name, F.struct(*rest)), ignorenulls=True).alias(name) for name in LABELS[1]])
    out = anchors.join(both, "sample_id", "left")
    for name in LABELS[1]:
        count = lambda c: F.coalesce(F.col(f"{name}.{c}"), F.lit(0)).cast("long")  # noqa: B023, E731
        out = out.withColumns({
            f"min_{name}_dist_m": F.round(F.coalesce(F.col(f"{name}.min_dist_m"), F.lit(2.0 * radius_m)), 3), f"{name}_segment_count": count("segment_count"),
            f"{name}_total_length_m": F.round(F.coalesce(F.col(f"{name}.total_length_m"), F.lit(0.0)), 3), **{f"{name}_segments_within_{m}m": count(f"near_{m}m") for m in (250, 500, 1000)},
            f"has_{name}_in_patch": F.col(name).isNotNull().cast("int"), f"{name}_raster_occupancy": count("occupancy"),
        }).drop(name)
    return out


#: Columns that floods give, and the rasters themselves.
RATIOS = "water_ratio double, navigable_ratio double, natural_boundary_density double, manmade_boundary_density double, barrier_density double, anchor_in_water int, anchor_in_navigable int, anchor_on_barrier int"
RASTERS = "masks binary, distances binary"
#: Masks and signed distance maps of version 2, in the order in which they are kept; grids worked on at once.
MASKS, DISTANCES, GRIDS = ("land", "water", "navigable", "natural", "manmade", "barrier"), ("shore", "navigable"), 64


class Patches:
    """Masks of some grids, and their distance maps when asked. Where no boundary is, all is water and every distance the radius."""

    def __init__(self, natural: np.ndarray, manmade: np.ndarray, radius_m: float) -> None:
        self.natural, self.manmade, self.radius_m = natural, manmade, radius_m
        self.barrier = natural | manmade
        self.some = self.barrier.any((1, 2))
        self.water, c = np.ones_like(self.barrier), natural.shape[1] // 2
        if self.some.any():
            self.water[self.some] = grids.flooded(self.barrier[self.some])
        self.navigable = self.water & ~grids.beside(self.barrier)
        self.navigable[:, c, c] |= self.water[:, c, c]

    def masks(self) -> np.ndarray:
        """(grids, masks, n, n)"""
        return np.stack([~self.water, self.water, self.navigable, self.natural, self.manmade, self.barrier], 1)

    def distances(self) -> np.ndarray:
        """(grids, maps, n, n), negative outside."""
        out = np.full((len(self.barrier), len(DISTANCES), *self.barrier.shape[1:]), self.radius_m, np.float32)
        if self.some.any():
            barrier, water, nav = (m[self.some] for m in (self.barrier, self.water, self.navigable))
            out[self.some] = np.stack([grids.distances_m(barrier, self.radius_m) * np.where(water, 1, -1), grids.distances_m(~nav, self.radius_m) * np.where(nav, 1, -1)], 1)
        return out


def marked(cells: pa.ListArray, size: int) -> np.ndarray:
    """Lists of cells as grids."""
    out = np.zeros((len(cells), size * size), bool)
    out[np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy()), cells.flatten().to_numpy()] = True
    return out.reshape(-1, size, size)


def _by_patches(outlines: DataFrame, radius_m: float, size: int, schema: T.StructType, columns: Callable[[pa.RecordBatch, Patches], list]) -> DataFrame:
    """Rows that `columns` makes of some outlines and their grids at a time. Grids stay within a task: neither shuffled nor kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, GRIDS):
                part = batch.slice(k, GRIDS)
                patches = Patches(marked(part.column("natural"), size), marked(part.column("manmade"), size), radius_m)
                yield pa.RecordBatch.from_arrays(columns(part, patches), schema.names)

    ship_code()
    return outlines.mapInArrow(run, schema)


def outlines_v2(anchors: DataFrame, ways: DataFrame, radius_m: float = 5000.0, size: int = 128, step_m: float = 32.0, deg: float = 0.25) -> DataFrame:
    """Anchors with their boundaries' distances and lengths, and cells as the lists natural and manmade. ways are those of version 2."""
    parts = clipped_segments(anchors, ways, radius_m, deg)
    cells = raster_cells(parts, radius_m, size, step_m, flip=True).withColumn("cell", F.col("gy") * size + F.col("gx"))
    pick = lambda k: F.collect_list(F.when(F.col("category") == LABELS[2][k], F.col("cell")))
    both = category_summary(parts).groupBy("sample_id").agg(*[F.first(F.when(F.col("category") == name, F.struct("min_dist_m", "total_length_m")), ignorenulls=True).alias(f"_{k}") for k, name in zip(("natural", "manmade"), LABELS[2])])
    out = anchors.join(both.join(cells.groupBy("sample_id").agg(pick(0).alias("natural"), pick(1).alias("manmade")), "sample_id", "left"), "sample_id", "left")
    shore, made = (F.coalesce(F.col(f"_{k}.min_dist_m"), F.lit(radius_m)) for k in ("natural", "manmade"))
    empty = F.array().cast("array<int>")
    return out.withColumns({
        "nearest_shore_dist_m": F.round(shore, 3), "nearest_manmade_dist_m": F.round(made, 3), "nearest_barrier_dist_m": F.round(F.least(shore, made), 3),
        **{f"{k}_boundary_length_m": F.round(F.coalesce(F.col(f"_{k}.total_length_m"), F.lit(0.0)), 3) for k in ("natural", "manmade")}, **{f"has_{k}_boundary": F.col(f"_{k}").isNotNull().cast("int") for k in ("natural", "manmade")},
        **{k: F.coalesce(k, empty) for k in ("natural", "manmade")},
    }).drop("_natural", "_manmade")


def with_rasters(outlines: DataFrame, radius_m: float = 5000.0, size: int = 128, ratios: bool = True, rasters: bool = True) -> DataFrame:
    """Outlines with shares of masks and flags of the centre, and with the rasters; without the lists of cells."""
    kept = [f for f in outlines.schema if f.name not in ("natural", "manmade")]
    names, c = [f.name for f in kept], size // 2
    schema = T.StructType([*kept, *(T.StructType.fromDDL(RATIOS).fields if ratios else []), *(T.StructType.fromDDL(RASTERS).fields if rasters else [])])

    def columns(part: pa.RecordBatch, at: Patches) -> list:
        out = [part.column(n) for n in names]
        if ratios:
            out += [pa.array(m.reshape(len(m), -1).mean(1)) for m in (at.water, at.navigable, at.natural, at.manmade, at.barrier)]
            out += [pa.array(m[:, c, c].astype(np.int32)) for m in (at.water, at.navigable, at.barrier)]
        if rasters:
            out.append(pa.array([m.tobytes() for m in np.packbits(at.masks().reshape(len(at.water), -1), axis=1)], pa.binary()))
            out.append(pa.array([d.tobytes() for d in at.distances()], pa.binary()))
        return out

    return _by_patches(outlines, radius_m, size, schema, columns)


def environment_v2(anchors: DataFrame, ways: DataFrame, radius_m: float = 5000.0, size: int = 128, step_m: float = 32.0, deg: float = 0.25) -> DataFrame:
    """Boundary descriptors, masks and signed distance maps of each sample. ways are those of version 2.

    Segments and cells are relational; floods and distance maps are made in numpy for a batch of grids at once, after all
    joins, as a row's rasters are far larger than the rest of it.
    """
    return scenes_v2(with_rasters(outlines_v2(anchors, ways, radius_m, size, step_m, deg), radius_m, size))


def scenes_v2(out: DataFrame) -> DataFrame:
    """Scene type and quality score from shares and distances."""
    scene = F.when((F.col("manmade_boundary_density") > 0.02) & (F.col("nearest_shore_dist_m") < 500), "harbor").when((F.col("water_ratio") < 0.45) | (F.col("navigable_ratio") < 0.3), "constrained").when(F.col("nearest_shore_dist_m") < 1200, "nearshore").otherwise("open_water")
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    score = clip(0.25 * F.col("anchor_in_water") + 0.35 * F.col("anchor_in_navigable") + 0.2 * clip(F.col("water_ratio")) + 0.2 * clip(F.col("navigable_ratio")))
    out = out.withColumns({"scene_type": scene, "env_quality_score": F.round(score, 6)})
    return out.withColumns({f"scene_{s}": (F.col("scene_type") == s).cast("int") for s in ("open_water", "nearshore", "harbor", "constrained")})


def _repeated(ids: pa.Array, times: np.ndarray) -> pa.Array:
    return ids.take(pa.array(times))


def _mask_sums(ids: pa.Array, masks: np.ndarray, wanted: list[int]) -> list:
    """For every row of every grid with a cell of a wanted mask: number of cells and sum of their columns, mask by mask."""
    masks = masks[:, wanted]
    grid, y = np.nonzero(masks.any((1, 3)))
    cells = masks[grid, :, y]
    n, total = cells.sum(2), cells @ np.arange(masks.shape[3])
    return [_repeated(ids, grid), pa.array(y.astype(np.int32)), *(pa.array(v[:, k].astype(np.int64)) for k in range(len(wanted)) for v in (n, total))]


def mask_sums(outlines: DataFrame, names: tuple[str, ...], radius_m: float = 5000.0, size: int = 128) -> DataFrame:
    """(sample_id, gy, name, sum_name for each name): cells of masks in each row, and their columns' sum; rows without any left out."""
    schema = T.StructType.fromDDL("sample_id string, gy int, " + ", ".join(f"{n} long, sum_{n} long" for n in names))
    wanted = [MASKS.index(n) for n in names]
    return _by_patches(outlines, radius_m, size, schema, lambda part, at: _mask_sums(part.column("sample_id"), at.masks(), wanted))


def _unpacked(masks: pa.Array, size: int) -> np.ndarray:
    bits = np.stack([np.frombuffer(p, np.uint8) for p in masks.to_pylist()])
    return np.unpackbits(bits, axis=1).reshape(len(bits), len(MASKS), size, size)


def mask_cells(env: DataFrame, names: tuple[str, ...], size: int = 128) -> DataFrame:
    """(sample_id, name for each name): cells of kept masks."""
    wanted = [MASKS.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, GRIDS):
                part = batch.slice(k, GRIDS)
                n = _unpacked(part.column("masks"), size)[:, wanted].sum((2, 3), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column("sample_id"), *(pa.array(n[:, i]) for i in range(len(names)))], ["sample_id", *names])

    ship_code()
    return env.select("sample_id", "masks").mapInArrow(run, "sample_id string, " + ", ".join(f"{n} long" for n in names))


def mask_rows(env: DataFrame, size: int = 128) -> DataFrame:
    """(sample_id, gy, mask, cells): each mask's row as a string of 0 and 1, rows without any cell left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, GRIDS):
                part = batch.slice(k, GRIDS)
                bits = _unpacked(part.column("masks"), size)
                grid, mask, y = np.nonzero(bits.any(3))
                cells = (bits[grid, mask, y] + 48).view(f"S{size}").ravel().astype(str)
                yield pa.RecordBatch.from_arrays([_repeated(part.column("sample_id"), grid), pa.array(y.astype(np.int32)), pa.array(np.array(MASKS)[mask].tolist(), pa.string()), pa.array(cells.tolist(), pa.string())], ["sample_id", "gy", "mask", "cells"])

    ship_code()
    return env.select("sample_id", "masks").mapInArrow(run, "sample_id string, gy int, mask string, cells string")


SPOTS = "sample_id string, gy int, gx int, shore_m double, navigable_m double"


def _spots(ids: pa.Array, maps: np.ndarray, every: int) -> list:
    wanted = np.arange(every // 2, maps.shape[2], every)
    maps = maps[:, :, wanted][:, :, :, wanted].astype(np.float64)
    grid, y, x = (v.ravel() for v in np.meshgrid(np.arange(len(maps)), wanted, wanted, indexing="ij"))
    return [_repeated(ids, grid), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(maps[:, 0].ravel()), pa.array(maps[:, 1].ravel())]


def distances_at(env: DataFrame, every: int, size: int = 128) -> DataFrame:
    """(sample_id, gy, gx, shore_m, navigable_m): signed distances at every so many cells, from half of it on, of kept maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, GRIDS):
                part = batch.slice(k, GRIDS)
                maps = np.stack([np.frombuffer(raw, np.float32) for raw in part.column("distances").to_pylist()]).reshape(-1, len(DISTANCES), size, size)
                yield pa.RecordBatch.from_arrays(_spots(part.column("sample_id"), maps, every), [x.split()[0] for x in SPOTS.split(", ")])

    ship_code()
    return env.select("sample_id", "distances").mapInArrow(run, SPOTS)


def distances_of(outlines: DataFrame, every: int, radius_m: float = 5000.0, size: int = 128) -> DataFrame:
    """What distances_at gives, of maps that are made for it and not kept."""
    return _by_patches(outlines, radius_m, size, T.StructType.fromDDL(SPOTS), lambda part, at: _spots(part.column("sample_id"), at.distances(), every))


def scene_groups(env: DataFrame) -> DataFrame:
    """scene_group by distance, number and length of ways; tile_sample_count and density_group by samples in the tile."""
    front, shore = F.col("min_waterfront_dist_m"), F.col("min_shoreline_dist_m")
    n = F.col("shoreline_segment_count")
    scene = (
        F.when((front <= 1200) | (F.col("waterfront_segment_count") >= 20) | (F.col("waterfront_total_length_m") >= 1500), "harbor_port")
        .when((shore <= 900) | (n >= 80) | (F.col("shoreline_total_length_m") >= 2500), "nearshore_channel").when((shore <= 2200) | (n > 0) | (front <= 2200), "coastal_route").otherwise("offshore_route")
    )
    counts = env.groupBy("tile_id").agg(F.count("*").alias("tile_sample_count"))  # then a join, as a tile may hold any share of the samples
    density = F.when(F.col("tile_sample_count") >= 300, "traffic_hub").when(F.col("tile_sample_count") >= 80, "traffic_corridor").otherwise("sparse_region")
    return env.join(counts, "tile_id").withColumns({"scene_group": scene, "density_group": density})


def region_clusters(tiles: DataFrame, tile_deg: float = 0.25, max_rounds: int = 1000) -> DataFrame:
    """(tile_id, region_cluster): occupied tiles that touch, numbered in order of their smallest tile_id.

    Least labels spread to the eight neighbours, and each label takes on its own label's, until nothing changes; rounds
    are written to the shared folder. Tiles are far fewer than samples.
    """
    spark, per = tiles.sparkSession, 1.0 / tile_deg
    grid = tiles.select("tile_id").distinct().withColumns({"gy": F.rint(F.substring("tile_id", 1, 8).cast("double") * per).cast("long"), "gx": F.rint(F.substring("tile_id", 10, 9).cast("double") * per).cast("long")})
    offsets = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    around = grid.withColumn("_o", F.explode(offsets)).select("tile_id", (F.col("gy") + F.col("_o.y")).alias("gy"), (F.col("gx") + F.col("_o.x")).alias("gx"))
    edges = around.join(grid.withColumnRenamed("tile_id", "other"), ["gy", "gx"]).select("tile_id", "other")
    home = f"{shared_folder(spark)}/tidewake-regions-{uuid.uuid4().hex}"
    edges.write.parquet(f"{home}-edges")  # once: otherwise every round would read all samples again
    edges = spark.read.parquet(f"{home}-edges")
    label = edges.groupBy("tile_id").agg(F.min("other").alias("label")).withColumn("changed", F.lit(True))
    for k in range(max_rounds):
        label.write.parquet(f"{home}-{k}")
        old = spark.read.parquet(f"{home}-{k}")
        if old.where("changed").isEmpty():
            break
        near = edges.join(old.select(F.col("tile_id").alias("other"), "label"), "other").groupBy("tile_id").agg(F.min("label").alias("near"), F.min(F.when(F.col("other") == F.col("tile_id"), F.col("label"))).alias("was"))
        jump = old.select(F.col("tile_id").alias("near"), F.col("label").alias("jump"))
        label = near.join(jump, "near", "left").select("tile_id", "was", F.least("near", F.coalesce("jump", "near")).alias("label"))
        label = label.select("tile_id", "label", (F.col("label") != F.col("was")).alias("changed"))
    else:
        raise RuntimeError(f"regions did not settle in {max_rounds} rounds")
    names = old.select("label").distinct().withColumn("region_cluster", F.format_string("region_%03d", F.row_number().over(Window.orderBy("label")) - 1))
    return old.join(names, "label").select("tile_id", "region_cluster")


def region_summary(df: DataFrame) -> DataFrame:
    """Per region: samples, tiles, box, most frequent scene (ties: the first by name) and scene counts as JSON."""
    scenes = df.groupBy("region_cluster", "scene_group").agg(F.count("*").alias("n"))
    per = scenes.groupBy("region_cluster").agg(
        F.max_by("scene_group", F.struct("n", F.transform(F.split("scene_group", ""), lambda c: -F.ascii(c)))).alias("dominant_scene_group"),
        F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "scene_group"))), lambda s: F.struct(s["scene_group"], -s["n"])))).alias("scene_group_counts"),
    )
    box = df.groupBy("region_cluster").agg(F.count("*").alias("num_samples"), F.count_distinct("tile_id").alias("num_tiles"), *[f(f"anchor_{c}").alias(f"{c}_{n}") for c in ("lat", "lon") for f, n in ((F.min, "min"), (F.max, "max"))])
    return box.join(per, "region_cluster")
