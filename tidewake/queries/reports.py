"""Queries of reports, lookups, decoding and the second dialect."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.arrays import at
from ..operators import ingest, reports, samples, selection, social, spatial
from ..registry import query
from ..sources import readers, writers
from . import chain
from . import selection as chosen
from . import social as met
from . import spatial as maps
from .fixtures import raw_messages, settled
from .samples import SPLIT

SECOND = {
    "MMSI": "mmsi", "Latitude": "latitude", "Longitude": "longitude", "SOG": "sog", "COG": "cog", "Heading": "heading", "nav_code": "status", "type_code": "vessel_type",
    "Length": "length", "Width": "width", "Draught": "draft", "IMO": "imo",
}
NAV = "coalesce(['under way using engine', 'at anchor', 'not under command', 'restricted manoeuverability', 'constrained by draught', 'moored', 'aground', 'engaged in fishing', 'under way sailing'][CAST(nav_code AS INT) + 1], 'undefined')"
KIND = "CASE WHEN CAST(type_code AS INT) BETWEEN 70 AND 79 THEN 'cargo' WHEN CAST(type_code AS INT) BETWEEN 80 AND 89 THEN 'tanker' WHEN CAST(type_code AS INT) BETWEEN 60 AND 69 THEN 'passenger' ELSE 'unknown' END"


def second_dialect(spark, d):
    """The raw messages under the second dialect's header, with codes and ISO times in both of its forms."""
    raw = raw_messages(spark, d).drop("Navigational status", "Ship type", "# Timestamp").withColumnsRenamed(SECOND)
    stamp = F.when(F.col("epoch") % 2 == 0, F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd HH:mm:ss"))
    return raw.withColumn("base_date_time", stamp)


@query(chain.sql(f"SELECT s._ingest_order, s.mmsi, us AS timestamp_utc, lat, lon, sog, cog, heading, {NAV} AS nav_status, {KIND} AS ship_type, length, width, draught, imo FROM std s JOIN raw r USING (_ingest_order)", "std"))
def standardize_second_dialect(spark, d):
    df = ingest.standardize(second_dialect(spark, d))
    return settled(df.drop("source_file"))


@query(chain.sql(f"SELECT DISTINCT ship_type, CAST(CASE coalesce({chain.ship_class('ship_type')}, 'unknown') WHEN 'cargo' THEN 1 WHEN 'tanker' THEN 2 WHEN 'bulk' THEN 3 WHEN 'container' THEN 4 WHEN 'passenger' THEN 5 WHEN 'ferry' THEN 6 WHEN 'fishing' THEN 7 WHEN 'tug' THEN 8 WHEN 'service' THEN 9 ELSE 0 END AS INT) AS ship_type_id FROM std", "std"))
def ship_type_ids(spark, d):
    return chain.standard(spark, d).select("ship_type").distinct().withColumn("ship_type_id", text.ship_type_id(F.col("ship_type")).cast("int"))


@query(chain.sql("SELECT _ingest_order, coalesce(try_cast(trim(draught_text) AS DOUBLE), -1.0) AS draught, coalesce(try_cast(trim(heading_text) AS INT), 511) AS heading FROM raw", "raw"))
def safe_casts(spark, d):
    raw = raw_messages(spark, d)
    return raw.select("_ingest_order", text.number_or(F.col("Draught"), "double", -1.0).alias("draught"), text.number_or(F.col("Heading"), "int", 511).alias("heading"))


@query(chain.sql("SELECT sample_id, CAST(regexp_extract(sample_id, '_([0-9]+)$', 1) AS INT) AS sample_step FROM samples", "samples"))
def sample_steps(spark, d):
    return chosen.evaluated(spark, d).select("sample_id", "sample_step")


@query(chain.sql("SELECT sample_id, strftime(make_timestamp(hist_end), '%Y-%m-%dT%H:%M:%S+00:00') AS hist_end_utc FROM samples", "samples"))
def utc_times(spark, d):
    return chain.labels(spark, d, "sample_id", "hist_end_ts").select("sample_id", text.utc_text(F.col("hist_end_ts")).alias("hist_end_utc"))


@query(chain.sql("SELECT p.sample_id, round(a.lat + degrees(p.y / 6371000.0), 6) AS lat, round(a.lon + degrees(p.x / (6371000.0 * cos(radians(a.lat)))), 6) AS lon FROM placed p JOIN points a ON a.sample_id = p.sample_id AND a.step = 29 WHERE p.step = 59", "placed"))
def places_from_xy(spark, d):
    df = chain.labelled(spark, d).join(maps.anchors_of(spark, d).select("sample_id", "anchor_lat", "anchor_lon"), "sample_id")
    x, y, lat, lon = at(F.col("fut_x"), -1), at(F.col("fut_y"), -1), F.col("anchor_lat"), F.col("anchor_lon")
    return df.select("sample_id", F.round(geo.local_lat(y, lat), 6).alias("lat"), F.round(geo.local_lon(x, lat, lon), 6).alias("lon"))


JSON_TEXT = """CASE WHEN event_id % 7 = 0 THEN '[1, 2.5, null, "x", true]' WHEN event_id % 7 = 1 THEN '' WHEN event_id % 7 = 2 THEN '{"a": 1}' WHEN event_id % 7 = 3 THEN '[1, 2' WHEN event_id % 7 = 4 THEN '[]' WHEN event_id % 7 = 5 THEN ' ["3.25"] ' END"""


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '1.0|2.5|1.0' WHEN event_id % 7 = 5 THEN '3.25' ELSE '' END AS numbers FROM events")
def tolerant_decode(spark, d):
    df = spark.read.parquet(f"{d}/events.parquet").withColumn("t", F.expr(JSON_TEXT))
    return df.select("event_id", F.array_join(F.transform(text.floats_of(F.col("t")), lambda v: v.cast("string")), "|").alias("numbers"))


@query("SELECT event_id, CAST(2 * event_id + 1 AS DOUBLE) AS total, '[' || event_id || ',null,' || (event_id + 1) || ']' AS compact FROM events")
def strict_decode(spark, d):
    df = spark.read.parquet(f"{d}/events.parquet").withColumn("t", F.expr("concat('[ ', event_id, ', null, ', event_id + 1, ' ]')"))
    values = text.strict_array(F.col("t"))
    return df.select("event_id", F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))).alias("total"), text.recompact(F.col("t"), "array<bigint>").alias("compact"))


@query(chain.sql("""SELECT sample_id, '{"sample_id":"' || sample_id || '","mmsi":' || mmsi || ',"segment_id":"' || segment_id || '","ship_type":' || coalesce('"' || ship_type || '"', 'null') || ',"ship_class":' || coalesce('"' || ship_class || '"', 'null')
  || ',"quality_tier":"' || tier || '","core_eligible":' || core || ',"full_eligible":' || full_ok || ',"interp_ratio_total":' || it || '}' AS meta FROM samples""", "samples"))
def sample_metadata(spark, d):
    return writers.sample_json(chain.labelled(spark, d))


@query(chain.sql("SELECT segment_id, us AS timestamp_utc FROM ordered WHERE segment_id = (SELECT min(segment_id) FROM ordered)", "ordered"))
def find_segment(spark, d):
    rows = chain.long_enough(spark, d)
    first = rows.agg(F.min("segment_id")).first()[0]
    return settled(readers.find_segment(rows, first).select("segment_id", "timestamp_utc"))


@query(chain.sql(f"SELECT sample_id, split FROM (SELECT sample_id, {SPLIT} AS split FROM samples) QUALIFY row_number() OVER (PARTITION BY split ORDER BY sample_id) <= 10", "samples"))
def first_rows(spark, d):
    return readers.first_rows(chosen._candidates(spark, d).select("sample_id", "split"), 10)


@query(chain.sql(f"SELECT {SPLIT} AS split, count(*) AS n FROM samples GROUP BY 1", "samples"))
def union_splits(spark, d):
    df = chosen._candidates(spark, d)
    return readers.union_splits({s: df.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")}).groupBy("split").agg(F.count("*").alias("n"))


@query(chosen.over(f"SELECT ship_group, speed_bin, motion_bin, count(*) AS n, round(avg({chosen.SCORE}), 4) AS mean_quality, round(avg({chosen.HARD}), 4) AS mean_difficulty FROM metrics GROUP BY 1, 2, 3", "metrics"))
def stratum_means(spark, d):
    return reports.stratum_means(chosen.evaluated(spark, d))


def _bins(c: str) -> str:
    return f"(SELECT split, string_agg({c} || '=' || n, ',' ORDER BY {c}) AS {c} FROM (SELECT {SPLIT} AS split, {c}, count(*) AS n FROM bins GROUP BY 1, 2) GROUP BY 1)"


@query(chosen.over(f"SELECT * FROM {_bins('ship_group')} JOIN {_bins('speed_bin')} USING (split) JOIN {_bins('motion_bin')} USING (split)", "bins"))
def split_histograms(spark, d):
    joined = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return reports.split_report(chosen._candidates(spark, d)).select("split", *[joined(c) for c in reports.STRATUM])


@query(chain.sql("SELECT tier AS key, CAST(count(*) AS BIGINT) AS n FROM samples GROUP BY 1", "samples"))
def merged_counts(spark, d):
    parts = chain.labelled(spark, d).groupBy(F.pmod("mmsi", F.lit(8)).alias("part"), "quality_tier").agg(F.count("*").alias("n")).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("quality_tier", "n"))).alias("tiers"))
    return samples.merge_maps(parts, "tiers")


def _env(spark, d):
    return maps.env_of(spark, d).withColumn("split", text.split_of(F.col("mmsi")))


ENV_MEANS = ", ".join(f"round({f}(min_{k}_dist_m), 3) AS {n}_min_{k}_dist_m" for k in ("shoreline", "waterfront") for f, n in (("avg", "mean"), ("median", "median")))


@query(maps.over(f"SELECT {SPLIT} AS split, count(*) AS num_samples, count(*) FILTER (has_shoreline_in_patch > 0) AS shoreline_positive, count(*) FILTER (waterfront_segment_count > 0) AS waterfront_positive, {ENV_MEANS} FROM env GROUP BY 1", "env"))
def environment_summary(spark, d):
    return settled(reports.environment_summary(_env(spark, d), "split"), digits=3)


@query(maps.over("SELECT round(max(ln(1 + greatest(shoreline_total_length_m, 0))), 6) AS shoreline_total_length_m, round(max(ln(1 + greatest(waterfront_total_length_m, 0))), 6) AS waterfront_total_length_m FROM env", "env"))
def log_maxima(spark, d):
    return settled(reports.log_maxima(_env(spark, d), "shoreline_total_length_m", "waterfront_total_length_m"))


RICH = f"SELECT *, {SPLIT} AS split, CAST(waterfront_segment_count > 0 AS INT) AS has_waterfront FROM env"


@query(maps.over(f"SELECT sample_id, split FROM ({RICH}) QUALIFY row_number() OVER (PARTITION BY split ORDER BY has_waterfront DESC, has_shoreline_in_patch DESC, shoreline_segment_count DESC, waterfront_segment_count DESC, sample_id) <= 5 AND (has_waterfront + has_shoreline_in_patch > 0 OR max(has_waterfront + has_shoreline_in_patch) OVER (PARTITION BY split) = 0)", "env"))
def context_examples(spark, d):
    return reports.context_examples(_env(spark, d), 5).select("sample_id", "split")


@query(maps.over("SELECT region_cluster, count(*) AS n FROM anchors JOIN regions USING (tile_id) GROUP BY 1 ORDER BY n DESC, region_cluster LIMIT 20", "regions"))
def top_regions(spark, d):
    anchors = maps.anchors_of(spark, d)
    counts = anchors.join(spatial.region_clusters(anchors), "tile_id").groupBy("region_cluster").agg(F.count("*").alias("n"))
    return reports.top_rows(counts, [F.desc("n"), F.col("region_cluster")], 20)


@query(maps.over("SELECT region_cluster, arg_max(scene_group, {'n': n, 's': -nr}) AS dominant_scene_group, '{' || string_agg('\"' || scene_group || '\":' || n, ',' ORDER BY n DESC, scene_group) || '}' AS scene_group_counts FROM (SELECT region_cluster, scene_group, count(*) AS n, row_number() OVER (PARTITION BY region_cluster ORDER BY scene_group) AS nr FROM scenes JOIN regions USING (tile_id) GROUP BY 1, 2) GROUP BY 1", "regions"))
def region_scenes(spark, d):
    df = spatial.region_summary(maps.scenes_of(spark, d).join(spatial.region_clusters(maps.anchors_of(spark, d)), "tile_id"))
    return df.select("region_cluster", "dominant_scene_group", "scene_group_counts")


@query(maps.over(f"SELECT {SPLIT} AS split, " + ", ".join(f"count(*) FILTER (scene_group = '{s}') AS {s}" for s in maps.SCENES) + " FROM scenes GROUP BY 1", "scenes"))
def scene_pivot_by_split(spark, d):
    return reports.pivot_counts(maps.scenes_of(spark, d).withColumn("split", text.split_of(F.col("mmsi"))), "split", "scene_group", maps.SCENES)


@query(chain.sql("SELECT sample_id FROM samples ORDER BY md5(sample_id), sample_id LIMIT 50", "samples"))
def stable_sample(spark, d):
    return reports.stable_sample(chain.labelled(spark, d).select("sample_id"), 50)


@query(maps.over("SELECT s.sample_id, CASE WHEN e.sample_id IS NULL THEN s.tier ELSE 'coastal' END AS quality_tier, e.shoreline_segment_count FROM samples s LEFT JOIN (SELECT * FROM env WHERE has_shoreline_in_patch > 0) e USING (sample_id)", "env"))
def override_join(spark, d):
    right = maps.env_of(spark, d).where("has_shoreline_in_patch > 0").select("sample_id", F.lit("coastal").alias("quality_tier"), "shoreline_segment_count")
    return reports.override_join(chain.labelled(spark, d).select("sample_id", "quality_tier"), right, "sample_id")


@query(maps.over("SELECT sample_id, shoreline_segment_count FROM samples LEFT JOIN (SELECT * FROM env WHERE has_shoreline_in_patch > 0) USING (sample_id)", "env"))
def optional_join(spark, d):
    right = maps.env_of(spark, d).where("has_shoreline_in_patch > 0").select("sample_id", "shoreline_segment_count")
    return social.left_one_to_one(chain.labelled(spark, d).select("sample_id"), right, ["sample_id"])


@query(chosen.over("SELECT sample_id, mmsi, segment_id FROM bins QUALIFY row_number() OVER (PARTITION BY ship_group, speed_bin, motion_bin ORDER BY md5(sample_id)) <= 5", "bins"))
def selected_rows(spark, d):
    picked = reports.top_per_group(chosen.evaluated(spark, d), list(selection.STRATUM), [F.md5("sample_id")], 5)
    return selection.selected_rows(chain.labelled(spark, d), picked).select("sample_id", "mmsi", "segment_id")


@query(maps.over("SELECT DISTINCT tile_id FROM env WHERE tile_id NOT IN (SELECT tile_id FROM env WHERE has_shoreline_in_patch > 0)", "env"))
def missing_tiles(spark, d):
    env = maps.env_of(spark, d)
    return readers.missing_keys(env, env.where("has_shoreline_in_patch > 0"), "tile_id")


@query(maps.over("SELECT sample_id, category, gy, gx FROM cells", "cells"))
def raster_places(spark, d):
    return spatial.raster_cells(maps.parts_of(spark, d), maps.R, 64, 24.0)


@query(maps.over("SELECT DISTINCT sample_id, gy + dy AS gy, gx + dx AS gx FROM cells, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) o(dy, dx) WHERE gy + dy BETWEEN 0 AND 63 AND gx + dx BETWEEN 0 AND 63", "cells"))
def dilated_places(spark, d):
    return spatial.dilate_cells(spatial.raster_cells(maps.parts_of(spark, d), maps.R, 64, 24.0).drop("category").distinct(), 1, 64)


@query(maps.over("SELECT category, gy, gx FROM cells WHERE sample_id = (SELECT min(sample_id) FROM cells)", "cells"))
def find_raster(spark, d):
    cells = spatial.raster_cells(maps.parts_of(spark, d), maps.R, 64, 24.0)
    return readers.find_raster(cells, cells.agg(F.min("sample_id")).first()[0]).drop("sample_id")


WITHIN = [(k, m) for k in ("shoreline", "waterfront") for m in (250, 500, 1000)]


@query(maps.over("SELECT sample_id, " + ", ".join(f"coalesce(max(n{m}) FILTER (category = '{k}'), 0) AS {k}_segments_within_{m}m" for k, m in WITHIN) + " FROM anchors LEFT JOIN stats USING (sample_id) GROUP BY 1", "stats"))
def segments_within(spark, d):
    return maps.env_of(spark, d).select("sample_id", *[f"{k}_segments_within_{m}m" for k, m in WITHIN])


#: The clip of version 1 over the square of version 2.
WIDE = {"2048.0": "5000.0", "4096.0": "10000.0"}


def _wide(sql: str) -> str:
    for a, b in WIDE.items():
        sql = sql.replace(a, b)
    return sql


@query(_wide(maps.over("""SELECT sample_id, tile_id, round(coalesce(min(min_dist) FILTER (category = 'shoreline'), 5000), 3) AS nearest_shore_dist_m, round(coalesce(min(min_dist) FILTER (category = 'waterfront'), 5000), 3) AS nearest_manmade_dist_m, round(least(coalesce(min(min_dist) FILTER (category = 'shoreline'), 5000), coalesce(min(min_dist) FILTER (category = 'waterfront'), 5000)), 3) AS nearest_barrier_dist_m,
  round(coalesce(sum(total) FILTER (category = 'shoreline'), 0), 3) AS natural_boundary_length_m, round(coalesce(sum(total) FILTER (category = 'waterfront'), 0), 3) AS manmade_boundary_length_m, CAST(count(*) FILTER (category = 'shoreline') AS INT) AS has_natural_boundary,
  CAST(count(*) FILTER (category = 'waterfront') AS INT) AS has_manmade_boundary FROM anchors LEFT JOIN stats USING (sample_id) GROUP BY 1, 2""", "stats")))
def env_v2_boundaries(spark, d):
    names = ("nearest_shore_dist_m", "nearest_manmade_dist_m", "nearest_barrier_dist_m", "natural_boundary_length_m", "manmade_boundary_length_m", "has_natural_boundary", "has_manmade_boundary")
    return maps.outlines_of(spark, d).select("sample_id", "tile_id", *names)


@query(met.over("SELECT sample_id, string_agg(n_segment_id, ',' ORDER BY nr) AS segments, string_agg(CAST(round(dist) AS BIGINT), ',' ORDER BY nr) AS distances, string_agg(coalesce(CAST(CAST(round(vx * 10) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY nr) AS speeds FROM near WHERE nr <= 8 GROUP BY 1", "near"))
def neighbour_arrays(spark, d):
    df = met.met_of(spark, d).where("neighbor_count_used > 0")
    whole = lambda c, k: F.array_join(F.transform(c, lambda v: F.coalesce(F.round(v * k).cast("long").cast("string"), F.lit("-"))), ",")
    return df.select("sample_id", F.array_join("neighbor_segment_id", ",").alias("segments"), whole("neighbor_distance_m", 1).alias("distances"), whole("neighbor_rel_vx_mps", 10).alias("speeds"))


@query(met.over("""SELECT sample_id, n_segment_id AS segment_id, o.i - (k.last - 29) AS step, round((o.lon - k.lon0) * 111320.0 * cos(radians(k.lat0)), 2) AS rel_x, round((o.lat - k.lat0) * 110540.0, 2) AS rel_y
  FROM (SELECT n.sample_id, n.n_segment_id, t.lat AS lat0, t.lon AS lon0, p.i AS last FROM near n JOIN samples s USING (sample_id) JOIN snaps t ON t.us = s.hist_end AND t.segment_id = s.segment_id JOIN ordered p ON p.segment_id = n.n_segment_id AND p.us = s.hist_end WHERE nr <= 8) k
  JOIN ordered o ON o.segment_id = k.n_segment_id AND o.i BETWEEN k.last - 29 AND k.last""", "near"))
def neighbour_histories(spark, d):
    df = met.social_of(spark, d).select("sample_id", F.explode(F.arrays_zip("neighbor_segment_id", "neighbor_rel_hist_x", "neighbor_rel_hist_y")).alias("n"))
    rows = df.select("sample_id", F.col("n.neighbor_segment_id").alias("segment_id"), F.posexplode(F.arrays_zip(F.col("n.neighbor_rel_hist_x").alias("x"), F.col("n.neighbor_rel_hist_y").alias("y"))).alias("step", "p"))
    return rows.select("sample_id", "segment_id", F.col("step").cast("long").alias("step"), F.round("p.x", 2).alias("rel_x"), F.round("p.y", 2).alias("rel_y"))


@query(chain.sql("""SELECT sample_id, step, round(x, 3) AS x, round(y, 3) AS y, round(vx, 3) AS vx, round(vy, 3) AS vy, round(CASE WHEN step = 0 THEN 0 ELSE vx - lag(vx) OVER w END, 3) AS ax, round(CASE WHEN step = 0 THEN 0 ELSE vy - lag(vy) OVER w END, 3) AS ay FROM
  (SELECT sample_id, step, x, y, coalesce(x - lag(x) OVER w, 0) AS vx, coalesce(y - lag(y) OVER w, 0) AS vy FROM placed WHERE step < 30 WINDOW w AS (PARTITION BY sample_id ORDER BY step)) WINDOW w AS (PARTITION BY sample_id ORDER BY step)""", "placed"))
def kinematic_rows(spark, d):
    df = samples.kinematics(chain.labelled(spark, d)).select("sample_id", F.posexplode("hist").alias("step", "r"))
    return df.select("sample_id", F.col("step").cast("long").alias("step"), *[(F.round(F.get("r", F.lit(k)), 3) + 0.0).alias(n) for k, n in enumerate(("x", "y", "vx", "vy", "ax", "ay"))])
