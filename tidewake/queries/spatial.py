"""Queries of the map-context operators, over ways derived from the supplier table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import reports, spatial
from ..plans.stages import shared_folder, stage
from ..registry import query
from ..sources import rasters
from . import chain
from .fixtures import settled

#: Short polylines along the vessels' courses. Numbers in scientific notation are doubles in both engines.
WAY_NODES = """
  SELECT s AS osm_id, i AS node, round(lat0 + (i - 1.5e0) * 6e-3 * cos(s), 6) AS lat, round(lon0 + (i - 1.5e0) * 1e-2 * sin(s), 6) AS lon,
    CASE WHEN s % 7 < 2 THEN 'coastline' END AS natural_tag, CASE WHEN s % 7 = 2 THEN 'dock' WHEN s % 7 = 6 THEN 'fairway' END AS waterway, CASE WHEN s % 7 = 3 THEN 'pier' WHEN s % 7 = 4 THEN 'quay' END AS man_made, CASE WHEN s % 7 = 5 THEN 'port' END AS landuse
  FROM (SELECT s, i, 5.5e1 + g * 5e-1 + (s % 9 - 4) * 4e-3 + v * cos(dir) * t / 1.1119493e5 AS lat0, 1e1 + g * 4e-1 + (s % 5 - 2) * 5e-3 + v * sin(dir) * t / 6.34e4 AS lon0 FROM (
    SELECT s_suppkey AS s, i, s_suppkey % 4 AS g, CAST(floor(s_suppkey / 4) AS BIGINT) * 4e2 AS t, CASE WHEN s_suppkey % 4 = 0 THEN 6e0 WHEN s_suppkey % 4 = 1 THEN 1.7e1 WHEN s_suppkey % 4 = 2 THEN 8e0 ELSE 5e0 END AS v,
      CASE WHEN s_suppkey % 4 = 0 THEN 6e-1 WHEN s_suppkey % 4 = 1 THEN 2.1e0 WHEN s_suppkey % 4 = 2 THEN 4e0 ELSE 5.2e0 END AS dir
    FROM {supplier} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n) a) b
"""
KIND = "CASE WHEN natural_tag = 'coastline' OR waterway IN ('riverbank', 'dock', 'canal') THEN 'shoreline' WHEN man_made IN ('pier', 'breakwater', 'groyne', 'quay') OR landuse = 'port' THEN 'waterfront' END"
TILE = "printf('%+08.3f_%+09.3f', floor(anchor_lat / 0.25) * 0.25, floor(anchor_lon / 0.25) * 0.25)"
X, Y = "radians({lon} - anchor_lon) * cos(radians(anchor_lat)) * 6371000.0", "radians({lat} - anchor_lat) * 6371000.0"
R = 2048.0


def side(p: str, d: str, low: bool, r: float = R) -> str:
    inner, outer = ("least", "greatest") if low else ("greatest", "least")
    miss = "2.0" if low else "-1.0"
    a, b = f"(-{r} - {p}) / nullif({d}, 0)", f"({r} - {p}) / nullif({d}, 0)"
    return f"CASE WHEN {d} = 0 THEN CASE WHEN abs({p}) > {r} THEN {miss} ELSE {'0.0' if low else '1.0'} END ELSE {inner}({a}, {b}) END"


MORE = {
    "nodes": WAY_NODES.format(supplier="supplier"),
    "anchors": f"SELECT *, {TILE} AS tile_id FROM (SELECT s.sample_id, s.mmsi, s.segment_id, s.hist_end, o.lat AS anchor_lat, o.lon AS anchor_lon FROM samples s JOIN ordered o ON o.segment_id = s.segment_id AND o.us = s.hist_end)",
    "local": f"SELECT sample_id, osm_id, node, {KIND} AS category, {X.format(lon='n.lon')} AS x, {Y.format(lat='n.lat')} AS y FROM anchors JOIN nodes n ON {KIND} IS NOT NULL",
    "pairs": "SELECT * FROM (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM local WINDOW w AS (PARTITION BY sample_id, osm_id ORDER BY node)) WHERE dx IS NOT NULL",
    "cut": f"SELECT *, greatest(0.0, {side('x', 'dx', True)}, {side('y', 'dy', True)}) AS t0, least(1.0, {side('x', 'dx', False)}, {side('y', 'dy', False)}) AS t1 FROM pairs",
    "parts": "SELECT sample_id, osm_id, category, CAST(CAST(x + t0 * dx AS FLOAT) AS DOUBLE) AS x0, CAST(CAST(y + t0 * dy AS FLOAT) AS DOUBLE) AS y0, CAST(CAST(x + t1 * dx AS FLOAT) AS DOUBLE) AS x1, CAST(CAST(y + t1 * dy AS FLOAT) AS DOUBLE) AS y1 FROM cut WHERE t0 <= t1",
    "far": """SELECT *, sqrt(pow(x0 + t * (x1 - x0), 2) + pow(y0 + t * (y1 - y0), 2)) AS d, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS len FROM (SELECT *, CASE WHEN pow(x1 - x0, 2) + pow(y1 - y0, 2) <= 1e-12 THEN 0.0
      ELSE greatest(0.0, least(1.0, -(x0 * (x1 - x0) + y0 * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) END AS t FROM parts)""",
    "stats": "SELECT sample_id, category, min(d) AS min_dist, count(*) AS n, sum(len) AS total, count(*) FILTER (d <= 250) AS n250, count(*) FILTER (d <= 500) AS n500, count(*) FILTER (d <= 1000) AS n1000 FROM far GROUP BY 1, 2",
    "cells": f"""SELECT DISTINCT sample_id, category, gy, gx FROM (SELECT sample_id, category, CAST(floor((y0 + (y1 - y0) * (i / (m - 1)) + {R}) / {2 * R} * 64) AS INT) AS gy, CAST(floor((x0 + (x1 - x0) * (i / (m - 1)) + {R}) / {2 * R} * 64) AS INT) AS gx
      FROM (SELECT *, unnest(range(0, m)) AS i FROM (SELECT *, greatest(2, CAST(ceil(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) / 24) AS BIGINT) + 1) AS m FROM parts))) WHERE gy BETWEEN 0 AND 63 AND gx BETWEEN 0 AND 63""",
    "env": f"""SELECT a.*, round(coalesce(s.min_dist, {2 * R}), 3) AS min_shoreline_dist_m, coalesce(s.n, 0) AS shoreline_segment_count, round(coalesce(s.total, 0), 3) AS shoreline_total_length_m, coalesce(s.n1000, 0) AS shoreline_segments_within_1000m,
      round(coalesce(f.min_dist, {2 * R}), 3) AS min_waterfront_dist_m, coalesce(f.n, 0) AS waterfront_segment_count, round(coalesce(f.total, 0), 3) AS waterfront_total_length_m, coalesce(f.n1000, 0) AS waterfront_segments_within_1000m,
      CAST(s.n IS NOT NULL AS INT) AS has_shoreline_in_patch, coalesce(c.k, 0) AS shoreline_raster_occupancy
      FROM anchors a LEFT JOIN (SELECT * FROM stats WHERE category = 'shoreline') s USING (sample_id) LEFT JOIN (SELECT * FROM stats WHERE category = 'waterfront') f USING (sample_id)
      LEFT JOIN (SELECT sample_id, count(*) AS k FROM cells WHERE category = 'shoreline' GROUP BY 1) c USING (sample_id)""",
    "scenes": """SELECT *, CASE WHEN min_waterfront_dist_m <= 1200 OR waterfront_segment_count >= 20 OR waterfront_total_length_m >= 1500 THEN 'harbor_port' WHEN min_shoreline_dist_m <= 900 OR shoreline_segment_count >= 80 OR shoreline_total_length_m >= 2500 THEN 'nearshore_channel'
      WHEN min_shoreline_dist_m <= 2200 OR shoreline_segment_count > 0 OR min_waterfront_dist_m <= 2200 THEN 'coastal_route' ELSE 'offshore_route' END AS scene_group, count(*) OVER (PARTITION BY tile_id) AS tile_sample_count FROM env""",
    "grid": "SELECT DISTINCT tile_id, CAST(round(CAST(substr(tile_id, 1, 8) AS DOUBLE) * 4) AS BIGINT) AS gy, CAST(round(CAST(substr(tile_id, 10, 9) AS DOUBLE) * 4) AS BIGINT) AS gx FROM anchors",
    "reach": "SELECT tile_id AS a, tile_id AS b FROM grid UNION SELECT r.a, q.tile_id FROM reach r JOIN grid p ON p.tile_id = r.b JOIN grid q ON abs(p.gy - q.gy) <= 1 AND abs(p.gx - q.gx) <= 1",
    "regions": "SELECT tile_id, printf('region_%03d', dense_rank() OVER (ORDER BY least_tile) - 1) AS region_cluster FROM (SELECT a AS tile_id, min(b) AS least_tile FROM reach GROUP BY 1)",
}


def over(body: str, last: str, *extra: str) -> str:
    names = list(MORE)
    names = names[: names.index(last) + 1]
    sql = chain.sql(body, "samples", **{n: MORE[n] for n in names})
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) if "reach" in names else sql


def elements(spark, d):
    nodes = spark.sql(WAY_NODES, supplier=spark.read.parquet(f"{d}/supplier.parquet"))
    tags = F.map_filter(F.create_map(F.lit("natural"), "natural_tag", F.lit("waterway"), "waterway", F.lit("man_made"), "man_made", F.lit("landuse"), "landuse"), lambda _, v: v.isNotNull())
    geometry = F.transform(F.array_sort(F.collect_list(F.struct("node", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return nodes.withColumn("tags", tags).groupBy(F.col("osm_id").alias("id")).agg(F.first("tags").alias("tags"), geometry.alias("geometry")).withColumn("type", F.lit("way"))


def ways(spark, d, version=1):
    return spatial.parse_ways(elements(spark, d), version)


def anchors_of(spark, d):
    keep = ("sample_id", "mmsi", "segment_id", "hist_end_ts", "hist_interp", "quality_tier")
    return stage(spark, "anchors", d, lambda: spatial.recover_anchors(chain.labels(spark, d, *keep), chain.long_enough(spark, d)))


def parts_of(spark, d):
    return stage(spark, "parts", d, lambda: spatial.clipped_segments(anchors_of(spark, d), ways(spark, d), R))


def env_of(spark, d):
    return stage(spark, "env", d, lambda: spatial.environment_v1(anchors_of(spark, d), ways(spark, d), R))


def scenes_of(spark, d):
    return spatial.scene_groups(env_of(spark, d))


@query(over("SELECT sample_id, round(anchor_lat, 6) AS anchor_lat, round(anchor_lon, 6) AS anchor_lon FROM anchors", "anchors"))
def anchors(spark, d):
    return settled(anchors_of(spark, d).select("sample_id", "anchor_lat", "anchor_lon"))


@query(over("SELECT sample_id, tile_id FROM anchors", "anchors"))
def tile_ids(spark, d):
    return anchors_of(spark, d).select("sample_id", "tile_id")


@query(over("SELECT tile_id, count(*) AS n FROM anchors GROUP BY 1", "anchors"))
def tile_counts(spark, d):
    return anchors_of(spark, d).groupBy("tile_id").agg(F.count("*").alias("n"))


@query(f"WITH nodes AS ({WAY_NODES.format(supplier='supplier')}) SELECT osm_id, {KIND} AS category, coalesce(CASE WHEN natural_tag = 'coastline' THEN 'coastline' END, CASE WHEN waterway = 'dock' THEN waterway END, man_made, CASE WHEN landuse = 'port' THEN 'port_boundary' END) AS subtype, count(*) AS nodes FROM nodes WHERE {KIND} IS NOT NULL GROUP BY 1, 2, 3")
def classify_ways(spark, d):
    return ways(spark, d).select("osm_id", "category", "subtype", F.size("geom").cast("long").alias("nodes"))


@query(over("SELECT sample_id, osm_id, category, round(x0, 1) + 0.0 AS x0, round(y0, 1) + 0.0 AS y0, round(x1, 1) + 0.0 AS x1, round(y1, 1) + 0.0 AS y1 FROM parts", "parts"))
def clip_segments(spark, d):
    return parts_of(spark, d).select("sample_id", "osm_id", "category", *[(F.round(c, 1) + 0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(over("SELECT sample_id, category, round(min_dist, 2) AS min_dist_m, n AS segment_count, round(total, 2) AS total_length_m, n250 AS near_250m, n500 AS near_500m, n1000 AS near_1000m FROM stats", "stats"))
def category_summary(spark, d):
    return spatial.category_summary(parts_of(spark, d)).withColumns({"min_dist_m": F.round("min_dist_m", 2), "total_length_m": F.round("total_length_m", 2)})


@query(over("SELECT sample_id, category, count(*) AS cells FROM cells GROUP BY 1, 2", "cells"))
def raster_cells(spark, d):
    return spatial.raster_cells(parts_of(spark, d), R, 64, 24.0).groupBy("sample_id", "category").agg(F.count("*").alias("cells"))


@query(over("SELECT sample_id, count(*) AS cells FROM (SELECT DISTINCT sample_id, gy + dy AS y, gx + dx AS x FROM cells, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) o(dy, dx)) WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63 GROUP BY 1", "cells"))
def dilate_cells(spark, d):
    cells = spatial.raster_cells(parts_of(spark, d), R, 64, 24.0).drop("category").distinct()
    return spatial.dilate_cells(cells, 1, 64).groupBy("sample_id").agg(F.count("*").alias("cells"))


ENV = "min_shoreline_dist_m, shoreline_segment_count, shoreline_total_length_m, shoreline_segments_within_1000m, min_waterfront_dist_m, waterfront_segment_count, waterfront_total_length_m, waterfront_segments_within_1000m, has_shoreline_in_patch, shoreline_raster_occupancy"


@query(over(f"SELECT sample_id, tile_id, {ENV} FROM env", "env"))
def env_v1(spark, d):
    return env_of(spark, d).select("sample_id", "tile_id", *ENV.split(", "))


#: Version 2: the same by other names in a larger square, with rows that grow southwards; floods over runs of free cells.
KIND2 = KIND.replace("shoreline", "natural").replace("waterfront", "manmade")
R2, N2, EVERY = 5000.0, 128, 16
MORE2 = {
    **{k: MORE[k] for k in ("nodes", "anchors")},
    "local2": MORE["local"].replace(KIND, KIND2), "pairs2": MORE["pairs"].replace("FROM local", "FROM local2"),
    "cut2": f"SELECT *, greatest(0.0, {side('x', 'dx', True, R2)}, {side('y', 'dy', True, R2)}) AS t0, least(1.0, {side('x', 'dx', False, R2)}, {side('y', 'dy', False, R2)}) AS t1 FROM pairs2",
    "parts2": MORE["parts"].replace("FROM cut", "FROM cut2"), "far2": MORE["far"].replace("FROM parts", "FROM parts2"),
    "stats2": "SELECT sample_id, category, min(d) AS min_dist, sum(len) AS total FROM far2 GROUP BY 1, 2",
    "cells2": f"""SELECT DISTINCT sample_id, category, gy, gx FROM (SELECT sample_id, category, CAST(floor(({R2} - (y0 + (y1 - y0) * (i / (m - 1)))) / {2 * R2} * {N2}) AS INT) AS gy, CAST(floor((x0 + (x1 - x0) * (i / (m - 1)) + {R2}) / {2 * R2} * {N2}) AS INT) AS gx
      FROM (SELECT *, unnest(range(0, m)) AS i FROM (SELECT *, greatest(2, CAST(ceil(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) / 32) AS BIGINT) + 1) AS m FROM parts2))) WHERE gy BETWEEN 0 AND {N2 - 1} AND gx BETWEEN 0 AND {N2 - 1}""",
    "barrier": "SELECT DISTINCT sample_id, gy, gx FROM cells2",
    "edges": f"SELECT sample_id, gy, gx FROM barrier UNION ALL SELECT sample_id, unnest(range(0, {N2})), {N2} FROM anchors",
    "free": "SELECT sample_id, gy, a, b FROM (SELECT sample_id, gy, coalesce(lag(gx) OVER (PARTITION BY sample_id, gy ORDER BY gx), -1) + 1 AS a, gx - 1 AS b FROM edges) WHERE a <= b",
    "starts2": f"""SELECT sample_id, y, x FROM (SELECT sample_id FROM anchors), (SELECT {N2 // 2} + dy AS y, {N2 // 2} + dx AS x, greatest(abs(dy), abs(dx)) AS ring FROM range(-4, 5) t(dy), range(-4, 5) u(dx))
      WHERE (sample_id, y, x) NOT IN (SELECT sample_id, gy, gx FROM barrier) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ring, y, x) = 1""",
    "water": """SELECT f.* FROM free f JOIN starts2 s ON s.sample_id = f.sample_id AND s.y = f.gy AND s.x BETWEEN f.a AND f.b
      UNION SELECT f.* FROM water w JOIN free f ON f.sample_id = w.sample_id AND f.gy IN (w.gy - 1, w.gy + 1) AND f.a <= w.b AND f.b >= w.a""",
    "wide": f"SELECT DISTINCT sample_id, gy + dy AS gy, gx + dx AS gx FROM barrier, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) o(dy, dx) WHERE gy + dy BETWEEN 0 AND {N2 - 1} AND gx + dx BETWEEN 0 AND {N2 - 1}",
    "spots": f"SELECT sample_id, y, x FROM anchors, range({EVERY // 2}, {N2}, {EVERY}) t(y), range({EVERY // 2}, {N2}, {EVERY}) u(x)",
    "off": f"SELECT w.*, EXISTS (SELECT 1 FROM water t WHERE t.sample_id = w.sample_id AND t.gy = w.gy AND w.gx BETWEEN t.a AND t.b) AS wet, w.gy = {N2 // 2} AND w.gx = {N2 // 2} AS mid FROM wide w",
    "shut": "SELECT sample_id, gy, gx FROM off WHERE NOT (wet AND mid)",
    "lost": "SELECT sample_id, gy, count(*) AS k, sum(gx) AS sx FROM off WHERE wet AND NOT mid GROUP BY 1, 2",
    "rows2": """SELECT w.sample_id, w.gy, w.n AS water, w.sx AS sum_water, w.n - coalesce(l.k, 0) AS navigable, w.sx - coalesce(l.sx, 0) AS sum_navigable
      FROM (SELECT sample_id, gy, CAST(sum(b - a + 1) AS BIGINT) AS n, CAST(sum((a + b) * (b - a + 1) / 2) AS BIGINT) AS sx FROM water GROUP BY 1, 2) w LEFT JOIN lost l USING (sample_id, gy)""",
    "grid2": f"""SELECT a.sample_id, coalesce(w, 0) / {N2 * N2} AS water_ratio, coalesce(v, 0) / {N2 * N2} AS navigable_ratio, coalesce(nat, 0) / {N2 * N2} AS natural_boundary_density, coalesce(man, 0) / {N2 * N2} AS manmade_boundary_density, coalesce(bar, 0) / {N2 * N2} AS barrier_density,
      CAST(s.sample_id IS NOT NULL AS INT) AS anchor_in_water, CAST(s.sample_id IS NOT NULL AS INT) AS anchor_in_navigable, CAST(c.sample_id IS NOT NULL AS INT) AS anchor_on_barrier
      FROM anchors a LEFT JOIN (SELECT sample_id, sum(water) AS w, sum(navigable) AS v FROM rows2 GROUP BY 1) r USING (sample_id)
      LEFT JOIN (SELECT sample_id, count(*) FILTER (category = 'natural') AS nat, count(*) FILTER (category = 'manmade') AS man FROM cells2 GROUP BY 1) k USING (sample_id) LEFT JOIN (SELECT sample_id, count(*) AS bar FROM barrier GROUP BY 1) b USING (sample_id)
      LEFT JOIN (SELECT sample_id FROM starts2 WHERE y = {N2 // 2} AND x = {N2 // 2}) s USING (sample_id) LEFT JOIN (SELECT sample_id FROM barrier WHERE gy = {N2 // 2} AND gx = {N2 // 2}) c USING (sample_id)""",
    "env2": f"""SELECT *, round(CASE WHEN manmade_boundary_density > 0.02 AND shore < 500 THEN 0 WHEN water_ratio < 0.45 OR navigable_ratio < 0.3 THEN 1 WHEN shore < 1200 THEN 2 ELSE 3 END) AS scene,
      greatest(0.0, least(1.0, 0.25 * anchor_in_water + 0.35 * anchor_in_navigable + 0.2 * water_ratio + 0.2 * navigable_ratio)) AS score
      FROM (SELECT g.*, round(coalesce(s.min_dist, {R2}), 3) AS shore, round(coalesce(m.min_dist, {R2}), 3) AS made, round(coalesce(s.total, 0), 3) AS natural_length, round(coalesce(m.total, 0), 3) AS manmade_length, s.min_dist IS NOT NULL AS has_n, m.min_dist IS NOT NULL AS has_m
      FROM grid2 g LEFT JOIN (SELECT * FROM stats2 WHERE category = 'natural') s USING (sample_id) LEFT JOIN (SELECT * FROM stats2 WHERE category = 'manmade') m USING (sample_id))""",
}


def over2(body: str) -> str:
    return chain.sql(body, "samples", **MORE2).replace("WITH ", "WITH RECURSIVE ", 1)


def outlines_of(spark, d):
    """Lists of cells, not rasters: those are made where they are used, as they are a hundred times as large."""
    return stage(spark, "outlines2", d, lambda: spatial.outlines_v2(anchors_of(spark, d), ways(spark, d, 2)))


def grids_of(spark, d, *columns):
    """Samples with their lists of cells, dealt to as many tasks as shuffles have: a small table is read in few, and each row is much work."""
    return outlines_of(spark, d).select("sample_id", "natural", "manmade", *columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


RATIOS = "water_ratio, navigable_ratio, natural_boundary_density, manmade_boundary_density, barrier_density, anchor_in_water, anchor_in_navigable, anchor_on_barrier"


@query(over2(f"""SELECT sample_id, {RATIOS}, shore AS nearest_shore_dist_m, made AS nearest_manmade_dist_m, natural_length AS natural_boundary_length_m, manmade_length AS manmade_boundary_length_m,
  CAST(has_n AS INT) AS has_natural_boundary, CAST(has_m AS INT) AS has_manmade_boundary, ['harbor', 'constrained', 'nearshore', 'open_water'][CAST(scene AS INT) + 1] AS scene_type, CAST(round(score * {5 * N2 * N2}) AS BIGINT) AS quality_units FROM env2"""))
def env_v2(spark, d):
    lengths = ("nearest_shore_dist_m", "nearest_manmade_dist_m", "natural_boundary_length_m", "manmade_boundary_length_m")
    units = F.rint(F.col("env_quality_score") * (5 * N2 * N2)).cast("long")  # a cell more or less is one unit
    env = spatial.scenes_v2(spatial.with_rasters(grids_of(spark, d, *lengths, "has_natural_boundary", "has_manmade_boundary"), rasters=False))
    return env.select("sample_id", *RATIOS.split(", "), *lengths, "has_natural_boundary", "has_manmade_boundary", "scene_type", units.alias("quality_units"))


@query(over2("SELECT sample_id, CAST(gy AS INT) AS gy, water, sum_water, navigable, CAST(sum_navigable AS BIGINT) AS sum_navigable FROM rows2"))
def env_v2_masks(spark, d):
    rows = spatial.mask_sums(grids_of(spark, d), ("water", "navigable"))
    return rows.select("sample_id", "gy", "water", "sum_water", "navigable", "sum_navigable")


NEAREST = f"(SELECT sample_id, y, x, min(pow(gy - y, 2) + pow(gx - x, 2)) AS d FROM spots JOIN {{cells}} USING (sample_id) GROUP BY 1, 2, 3)"


@query(over2(f"""SELECT sample_id, CAST(y AS INT) AS gy, CAST(x AS INT) AS gx, CAST(coalesce(b.d, {N2 * N2 // 4}) * CASE WHEN wet THEN 1 ELSE -1 END AS BIGINT) AS shore, CAST(CASE WHEN nav THEN coalesce(s.d, {N2 * N2 // 4}) ELSE 0 END AS BIGINT) AS navigable
  FROM (SELECT *, wet AND NOT EXISTS (SELECT 1 FROM shut WHERE shut.sample_id = p.sample_id AND shut.gy = p.y AND shut.gx = p.x) AS nav
    FROM (SELECT *, EXISTS (SELECT 1 FROM water t WHERE t.sample_id = o.sample_id AND t.gy = o.y AND o.x BETWEEN t.a AND t.b) AS wet FROM spots o) p) q
  LEFT JOIN {NEAREST.format(cells='barrier')} b USING (sample_id, y, x) LEFT JOIN {NEAREST.format(cells='shut')} s USING (sample_id, y, x)"""))
def env_v2_distances(spark, d):
    """Squared distances in cells, negative outside; where there is nothing, those of the radius."""
    squared = lambda c: (F.signum(c) * F.rint(F.pow(F.col(c) / (2 * R2 / N2), 2))).cast("long")
    return spatial.distances_of(grids_of(spark, d), EVERY).select("sample_id", "gy", "gx", squared("shore_m").alias("shore"), squared("navigable_m").alias("navigable"))


@query(over("SELECT sample_id, scene_group FROM scenes", "scenes"))
def scene_groups(spark, d):
    return scenes_of(spark, d).select("sample_id", "scene_group")


@query(over("SELECT sample_id, tile_sample_count, CASE WHEN tile_sample_count >= 300 THEN 'traffic_hub' WHEN tile_sample_count >= 80 THEN 'traffic_corridor' ELSE 'sparse_region' END AS density_group FROM scenes", "scenes"))
def density_groups(spark, d):
    return scenes_of(spark, d).select("sample_id", "tile_sample_count", "density_group")


@query(over("SELECT tile_id, region_cluster FROM regions", "regions"))
def region_clusters(spark, d):
    return spatial.region_clusters(anchors_of(spark, d))


@query(over("SELECT region_cluster, count(*) AS num_samples, count(DISTINCT tile_id) AS num_tiles, round(min(anchor_lat), 6) AS lat_min, round(max(anchor_lon), 6) AS lon_max FROM scenes JOIN regions USING (tile_id) GROUP BY 1", "regions"))
def region_summary(spark, d):
    df = spatial.region_summary(scenes_of(spark, d).join(spatial.region_clusters(anchors_of(spark, d)), "tile_id"))
    return settled(df.select("region_cluster", "num_samples", "num_tiles", "lat_min", "lon_max"))


SCENES = ["coastal_route", "harbor_port", "nearshore_channel", "offshore_route"]


@query(over("SELECT mmsi, " + ", ".join(f"count(*) FILTER (scene_group = '{s}') AS {s}" for s in SCENES) + " FROM scenes GROUP BY 1", "scenes"))
def scene_pivot(spark, d):
    return reports.pivot_counts(scenes_of(spark, d), "mmsi", "scene_group", SCENES)


@query(over(f"SELECT CAST(least(29, floor(least({2 * R}, greatest(0, min_shoreline_dist_m)) / ({2 * R} / 30))) AS INT) AS bin, count(*) AS n FROM env GROUP BY 1", "env"))
def distance_histogram(spark, d):
    return reports.histogram(env_of(spark, d), "min_shoreline_dist_m", 0.0, 2 * R, 30)


@query(over2("SELECT sample_id, CAST(sum(water) AS BIGINT) AS water, CAST(sum(navigable) AS BIGINT) AS navigable FROM rows2 GROUP BY 1"))
def raster_shards(spark, d):
    """Version 2's rasters written as shards and read back."""
    def build():
        path = f"{shared_folder(spark)}/tidewake-shards-{uuid.uuid4().hex}"
        rasters.write_rasters(outlines_of(spark, d).select("sample_id", "natural", "manmade"), path, make=lambda df: spatial.with_rasters(df, ratios=False))
        return spatial.mask_cells(rasters.read_rasters(spark, path, columns=("masks",)), ("water", "navigable"))

    return stage(spark, "shards", d, build)
