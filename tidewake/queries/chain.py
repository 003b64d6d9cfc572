"""The stages as Spark frames and as a chain of DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import ingest, samples, tracks
from ..plans.stages import is_written, stage
from .fixtures import DUCK_RAW, raw_messages

DATA = "lat, lon, sog, cog, heading, nav_status, ship_type, length, width, draught, imo"


def standard(spark: SparkSession, d: str) -> DataFrame:
    return ingest.standardize(raw_messages(spark, d))


def filtered(spark: SparkSession, d: str) -> DataFrame:
    return ingest.basic_filter(standard(spark, d))


def deduped(spark: SparkSession, d: str, **how) -> DataFrame:
    return ingest.dedup_messages(filtered(spark, d), **how)


def clean(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        # dealt by vessel before rows of one vessel and time are compared, which then need no exchange of their own
        return ingest.speed_filter(ingest.dedup_messages(tracks.co_located(filtered(spark, d))))

    return stage(spark, "clean", d, build, "mmsi")


def segmented(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        return tracks.segment_tracks(clean(spark, d))

    return stage(spark, "segmented", d, build, "mmsi")


def underway(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        return tracks.underway(segmented(spark, d))

    return stage(spark, "underway", d, build, "mmsi")


def gapfilled(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        return tracks.fill_short_gaps(underway(spark, d))

    return stage(spark, "gapfilled", d, build, "mmsi")


def resampled(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        return tracks.resample(gapfilled(spark, d))

    return stage(spark, "resampled", d, build, "mmsi")


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    return tracks.reject_anomalies(resampled(spark, d))


def long_enough(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        return tracks.long_segments(reviewed(spark, d))

    return stage(spark, "long", d, build, "mmsi")


def windows(spark: SparkSession, d: str) -> DataFrame:
    return samples.make_windows(long_enough(spark, d))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        return samples.label_samples(windows(spark, d))

    return stage(spark, "labelled", d, build)


def labels(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Some columns of the labelled samples: from their table if it is there, else made alone, without a sample's thirty arrays."""
    df = labelled(spark, d) if is_written(spark, "labelled", d) else samples.label_samples(windows(spark, d))
    return df.select(*columns)


def haversine(a: str, b: str, c: str, d: str) -> str:
    return f"(12742000.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def text(c: str) -> str:
    t = f"lower(regexp_replace(trim({c}), '\\s+', ' ', 'g'))"
    return f"CASE WHEN {t} NOT IN ('', 'unknown', 'unknown value', 'undefined', 'none') THEN {t} END"


def ship_class(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, 'cargo|bulk|container') THEN CASE WHEN {c} LIKE '%container%' THEN 'container' WHEN {c} LIKE '%bulk%' THEN 'bulk' ELSE 'cargo' END
      WHEN {c} LIKE '%tanker%' THEN 'tanker' WHEN regexp_matches({c}, 'passenger|ferry|cruise') THEN CASE WHEN {c} LIKE '%ferry%' THEN 'ferry' ELSE 'passenger' END
      WHEN {c} LIKE '%fishing%' THEN 'fishing' WHEN regexp_matches({c}, 'tug|pilot|service|port tender|tow') THEN CASE WHEN regexp_matches({c}, 'tug|tow') THEN 'tug' ELSE 'service' END END"""


def cap(c: str) -> str:
    return f"CAST(CASE WHEN {c} IN ('cargo', 'tanker', 'bulk', 'container') THEN 35.0 WHEN {c} IN ('passenger', 'ferry') THEN 45.0 WHEN {c} = 'fishing' THEN 25.0 WHEN {c} IN ('tug', 'service') THEN 20.0 END AS DOUBLE)"


def number(c: str) -> str:
    return f"try_cast(trim({c}) AS DOUBLE)"


def circular(a: str, b: str, p: str) -> str:
    d = f"degrees(atan2((1 - {p}) * sin(radians({a})) + {p} * sin(radians({b})), (1 - {p}) * cos(radians({a})) + {p} * cos(radians({b}))))"
    return f"CASE WHEN {d} < 0 THEN {d} + 360.0 ELSE {d} END"


def blend(p: str) -> str:
    return f"""(1 - {p}) * lat + {p} * n_lat AS lat, (1 - {p}) * lon + {p} * n_lon AS lon, CASE WHEN abs(n_sog - sog) <= 8 THEN (1 - {p}) * sog + {p} * n_sog END AS sog,
      {circular("cog", "n_cog", p)} AS cog, {circular("heading", "n_heading", p)} AS heading"""


MISSING = " + ".join(f"CAST({c} IS NULL AS INT)" for c in DATA.split(", "))
SEG = "PARTITION BY segment_id ORDER BY us"
CHAIN: dict[str, str] = {
    "raw": DUCK_RAW,
    "std": f"""SELECT _ingest_order, CAST({number("mmsi_text")} AS BIGINT) AS mmsi, epoch * 1000000 AS us,
      CASE WHEN abs({number("lat_text")}) < 91 THEN {number("lat_text")} END AS lat, CASE WHEN abs({number("lon_text")}) < 181 THEN {number("lon_text")} END AS lon,
      CASE WHEN {number("sog_text")} < 102.2 THEN {number("sog_text")} END AS sog, CASE WHEN {number("cog_text")} < 360 THEN {number("cog_text")} END AS cog,
      CASE WHEN {number("heading_text")} <> 511 THEN {number("heading_text")} END AS heading, {text("nav_text")} AS nav_status, {text("type_text")} AS ship_type,
      {number("length_text")} AS length, {number("width_text")} AS width, {number("draught_text")} AS draught, {number("imo_text")} AS imo FROM raw""",
    "filtered": """SELECT * REPLACE (CASE WHEN cog >= 0 AND cog < 360 THEN cog END AS cog, CASE WHEN heading >= 0 AND heading < 360 THEN heading END AS heading)
      FROM std WHERE mmsi IS NOT NULL AND us IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND (sog IS NULL OR sog >= 0)""",
    "deduped": f"SELECT * FROM filtered QUALIFY row_number() OVER (PARTITION BY mmsi, us ORDER BY {MISSING} DESC, _ingest_order DESC) = 1",
    "classed": f"SELECT *, {cap('ship_class')} AS cap FROM (SELECT *, {ship_class('ship_type')} AS ship_class FROM deduped)",
    "clean": "SELECT * FROM classed WHERE coalesce(sog <= 55, true) AND coalesce(sog <= cap, true)",
    "stepped": f"""SELECT *, (us - p_us) / 1e6 AS dt, {haversine("p_lat", "p_lon", "lat", "lon")} / ((us - p_us) / 1e6) * 1.9438444924406 AS implied,
      greatest(1.4 * greatest(coalesce(p_sog, 0), coalesce(sog, 0)), greatest(coalesce(p_cap, 55), coalesce(cap, 55)) + 5) AS most
      FROM (SELECT *, lag(us) OVER w AS p_us, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(sog) OVER w AS p_sog, lag(cap) OVER w AS p_cap FROM clean WINDOW w AS (PARTITION BY mmsi ORDER BY us))""",
    "broken": "SELECT *, CASE WHEN p_us IS NULL THEN 'start' WHEN dt > 600 THEN 'time_gap' WHEN implied > most THEN 'implied_speed' ELSE 'continue' END AS reason FROM stepped",
    "seg": """SELECT * EXCLUDE (p_us, p_lat, p_lon, p_sog, p_cap, most), printf('%d_%06d', mmsi, CAST(sum(CAST(reason <> 'continue' AS INT)) OVER (PARTITION BY mmsi ORDER BY us) - 1 AS BIGINT)) AS segment_id FROM broken""",
    "flagged": f"""SELECT *, coalesce(regexp_matches(nav_status, 'anchor|moored'), false) AS anchored, coalesce(sog < 0.5, false) AS low,
      coalesce({haversine("lat", "lon", "l_lat", "l_lon")} < 150, false) AS still
      FROM (SELECT *, first(lat) OVER w AS l_lat, first(lon) OVER w AS l_lon FROM seg WINDOW w AS (PARTITION BY segment_id ORDER BY us RANGE BETWEEN 1200000000 FOLLOWING AND UNBOUNDED FOLLOWING))""",
    "turned": f"""SELECT *, coalesce(anchored <> lag(anchored) OVER ({SEG}), false) AS ta, coalesce(low <> lag(low) OVER ({SEG}), false) AS tl FROM flagged""",
    "islands": f"SELECT *, sum(CAST(ta AS INT)) OVER ({SEG}) AS ra, sum(CAST(tl AS INT)) OVER ({SEG}) AS rl FROM turned",
    "runs_a": "SELECT segment_id, max(s) AS anchor_s FROM (SELECT segment_id, ra, CASE WHEN bool_or(anchored) THEN (max(us) - min(us)) / 1e6 ELSE 0 END AS s FROM islands GROUP BY 1, 2) GROUP BY 1",
    "runs_l": "SELECT segment_id, max(s) AS low_s FROM (SELECT segment_id, rl, CASE WHEN bool_or(low) THEN (max(us) - min(us)) / 1e6 ELSE 0 END AS s FROM islands GROUP BY 1, 2) GROUP BY 1",
    "labels": f"""SELECT segment_id, mmsi, n, t0, t1, (t1 - t0) / 1e6 AS duration, {haversine("a.lat", "a.lon", "b.lat", "b.lon")} AS end_to_end, anchor_s, low_s, still,
      anchor_s >= 300 OR low_s >= 300 OR still AS excluded
      FROM (SELECT segment_id, mmsi, count(*) AS n, min(us) AS t0, max(us) AS t1, arg_min({{'lat': lat, 'lon': lon}}, us) AS a, arg_max({{'lat': lat, 'lon': lon}}, us) AS b, bool_or(still) AS still FROM flagged GROUP BY 1, 2)
      JOIN runs_a USING (segment_id) JOIN runs_l USING (segment_id)""",
    "underway": "SELECT * FROM seg WHERE segment_id NOT IN (SELECT segment_id FROM labels WHERE excluded)",
    "gapped": f"""SELECT *, CASE WHEN g IS NULL THEN 'start' WHEN g <= 20 THEN 'none' WHEN g <= 120 THEN 'short' WHEN g <= 300 THEN 'medium' ELSE 'long' END AS gap_class
      FROM (SELECT *, (us - lag(us) OVER w) / 1e6 AS g, lead(us) OVER w AS n_us, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon, lead(sog) OVER w AS n_sog, lead(cog) OVER w AS n_cog, lead(heading) OVER w AS n_heading
      FROM underway WINDOW w AS ({SEG}))""",
    "filler": f"""SELECT mmsi, segment_id, ship_type, nav_status, us + k * 20000000 AS us, {blend("(k * 20000000 / (n_us - us))")}, 'short' AS gap_class, true AS filled
      FROM (SELECT *, unnest(range(1, CAST(ceil((n_us - us) / 20000000) AS BIGINT))) AS k FROM gapped WHERE n_us - us > 20000000 AND n_us - us <= 120000000)""",
    "gapfilled": """SELECT mmsi, segment_id, ship_type, nav_status, us, lat, lon, sog, cog, heading, gap_class, false AS filled FROM gapped UNION ALL SELECT mmsi, segment_id, ship_type, nav_status, us, lat, lon, sog, cog, heading, gap_class, filled FROM filler""",
    "pieces": f"SELECT *, sum(CAST(coalesce(us - p_us > 120000000, false) AS INT)) OVER ({SEG}) AS piece FROM (SELECT *, lag(us) OVER ({SEG}) AS p_us FROM gapfilled)",
    "paired": """SELECT *, dense_rank() OVER (PARTITION BY segment_id ORDER BY piece) - 1 AS num FROM (SELECT *, count(*) OVER (PARTITION BY segment_id, piece) AS size,
      lead(us) OVER w AS n_us, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon, lead(sog) OVER w AS n_sog, lead(cog) OVER w AS n_cog, lead(heading) OVER w AS n_heading
      FROM pieces WINDOW w AS (PARTITION BY segment_id, piece ORDER BY us)) WHERE size >= 2""",
    "gridded": """SELECT *, unnest(range(CAST(ceil(us / 20000000) AS BIGINT), CAST(floor(coalesce(n_us - 1, us) / 20000000) AS BIGINT) + 1)) * 20000000 AS grid FROM paired""",
    "resampled": f"""SELECT mmsi, printf('%s_r%02d', segment_id, num) AS segment_id, ship_type, gap_class, grid AS us, lat, lon, sog, cog, heading, false AS grid_interp, filled AS gap_imputed FROM gridded WHERE grid = us
      UNION ALL SELECT mmsi, printf('%s_r%02d', segment_id, num) AS segment_id, ship_type, gap_class, grid AS us, {blend("((grid - us) / (n_us - us))")}, true AS grid_interp, false AS gap_imputed FROM gridded WHERE grid <> us""",
    "sided": f"""SELECT *, count(*) OVER (PARTITION BY segment_id) AS size, first(ship_type) OVER ({SEG}) AS first_type, lag(us) OVER w AS p_us, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon,
      lead(us) OVER w AS q_us, lead(lat) OVER w AS q_lat, lead(lon) OVER w AS q_lon FROM resampled WINDOW w AS ({SEG})""",
    "spiked": f"""SELECT *, coalesce(size >= 3 AND p_us IS NOT NULL AND q_us IS NOT NULL AND {haversine("lat", "lon", "(p_lat + lat + q_lat - greatest(p_lat, lat, q_lat) - least(p_lat, lat, q_lat))", "(p_lon + lon + q_lon - greatest(p_lon, lon, q_lon) - least(p_lon, lon, q_lon))")} > 200
      AND greatest({haversine("lat", "lon", "p_lat", "p_lon")} / ((us - p_us) / 1e6), {haversine("lat", "lon", "q_lat", "q_lon")} / ((q_us - us) / 1e6)) * 1.9438444924406 > coalesce({cap("(" + ship_class("first_type") + ")")}, 55) + 8, false) AS spike FROM sided""",
    "recut": f"SELECT *, sum(CAST(coalesce(us - b_us > 40000000, false) AS INT)) OVER ({SEG}) AS piece FROM (SELECT *, lag(us) OVER ({SEG}) AS b_us FROM spiked WHERE NOT spike)",
    "reviewed": "SELECT * REPLACE (CASE WHEN size < 3 THEN segment_id ELSE printf('%s_c%02d', segment_id, CAST(piece AS BIGINT)) END AS segment_id) FROM recut",
    "kept": "SELECT * FROM reviewed QUALIFY count(*) OVER (PARTITION BY segment_id) >= 80 AND max(us) OVER (PARTITION BY segment_id) - min(us) OVER (PARTITION BY segment_id) >= 1500000000",
    "ordered": f"SELECT mmsi, segment_id, ship_type, gap_class, us, lat, lon, sog, cog, heading, grid_interp, gap_imputed, row_number() OVER ({SEG}) - 1 AS i, count(*) OVER (PARTITION BY segment_id) AS n FROM kept",
    "starts": "SELECT segment_id, i AS s FROM ordered WHERE i % 5 = 0 AND i + 60 <= n",
    "points": "SELECT printf('%s_%05d', segment_id, s) AS sample_id, s, o.i - s AS step, o.* EXCLUDE (i, n) FROM starts JOIN ordered o USING (segment_id) WHERE o.i BETWEEN s AND s + 59",
    "placed": """SELECT p.*, round_even(radians(p.lon - a.lon) * cos(radians(a.lat)) * 6371000.0 * 1000, 0) / 1000 AS x, round_even(radians(p.lat - a.lat) * 6371000.0 * 1000, 0) / 1000 AS y
      FROM points p JOIN (SELECT sample_id, round_even(lat * 1e7, 0) / 1e7 AS lat, round_even(lon * 1e7, 0) / 1e7 AS lon FROM points WHERE step = 29) a USING (sample_id)""".replace("p.lon - a.lon", "round_even(p.lon * 1e7, 0) / 1e7 - a.lon").replace("p.lat - a.lat", "round_even(p.lat * 1e7, 0) / 1e7 - a.lat"),
    "gaps": "SELECT sample_id, step, us - lag(us) OVER (PARTITION BY sample_id ORDER BY step) AS d FROM points",
    "measured": """SELECT sample_id, any_value(mmsi) AS mmsi, any_value(segment_id) AS segment_id, max(ship_type) FILTER (step = 59) AS ship_type, max(us) FILTER (step = 29) AS hist_end, max(us) FILTER (step = 59) AS pred_end,
      avg(CAST(gap_imputed AS INT)) FILTER (step < 30) AS ih, avg(CAST(gap_imputed AS INT)) FILTER (step >= 30) AS if, avg(CAST(gap_imputed AS INT)) AS it,
      avg(CAST(grid_interp AS INT)) FILTER (step < 30) AS gh, avg(CAST(grid_interp AS INT)) FILTER (step >= 30) AS gf, avg(CAST(grid_interp AS INT)) AS gt,
      sqrt(pow(max(x) FILTER (step = 29) - max(x) FILTER (step = 0), 2) + pow(max(y) FILTER (step = 29) - max(y) FILTER (step = 0), 2)) AS hd,
      sqrt(pow(max(x) FILTER (step = 59) - max(x) FILTER (step = 30), 2) + pow(max(y) FILTER (step = 59) - max(y) FILTER (step = 30), 2)) AS fd FROM placed GROUP BY sample_id""",
    "samples": f"""SELECT *, CASE WHEN core THEN 'core' WHEN full_ok THEN 'full' ELSE 'drop' END AS tier FROM (SELECT *, full_ok AND ih <= 0.2 AND if <= 0.2 AND it <= 0.15 AS core FROM
      (SELECT *, hist_ok AND fut_ok AND hd >= 200 AND fd >= 200 AS full_ok, {ship_class("ship_type")} AS ship_class FROM measured JOIN
      (SELECT sample_id, max(d) FILTER (step BETWEEN 1 AND 29) <= 40000000 AS hist_ok, max(d) FILTER (step BETWEEN 31 AND 59) <= 40000000 AS fut_ok FROM gaps GROUP BY 1) USING (sample_id)))""",
}


def sql(body: str, last: str, **more: str) -> str:
    """A query over the chain up to a stage, and over further named stages."""
    names = list(CHAIN)
    parts = [f"{n} AS ({CHAIN[n]})" for n in names[: names.index(last) + 1]] + [f"{n} AS ({q})" for n, q in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
