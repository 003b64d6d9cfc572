"""Queries of the selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import reports, selection
from ..plans.stages import stage
from ..registry import query
from . import chain
from .fixtures import settled
from .samples import SPLIT

GROUP = """CASE WHEN regexp_matches(t, 'cargo|tanker|bulk|container') THEN 'cargo_tanker' WHEN regexp_matches(t, 'passenger|ferry') THEN 'passenger_ferry' WHEN t LIKE '%fishing%' THEN 'fishing'
  WHEN regexp_matches(t, 'tug|service|pilot|tow') THEN 'tug_service' WHEN regexp_matches(t, 'sailing|pleasure|yacht') THEN 'sailing_leisure' ELSE 'other_unknown' END"""
SPEED = "CASE WHEN kn < 5 THEN '0_5' WHEN kn < 10 THEN '5_10' WHEN kn < 15 THEN '10_15' WHEN kn < 20 THEN '15_20' ELSE 'gt20' END"
MOTION = "CASE WHEN fd < 700 THEN 'low' WHEN fd < 1700 THEN 'mid' ELSE 'high' END"
WRAP = "abs((({d}) + 540) - 360 * floor((({d}) + 540) / 360) - 180)"


def wrap(d: str) -> str:
    return WRAP.replace("{d}", d)


BINS = f"SELECT *, {GROUP} AS ship_group, {SPEED} AS speed_bin, {MOTION} AS motion_bin FROM (SELECT *, lower(concat_ws(' ', ship_type, ship_class)) AS t, 0.5 * (hd + fd) / 600 * 1.9438444924406 AS kn FROM samples)"
#: Steps of both sides; the future's first step is from the origin.
STEPS = """SELECT sample_id, side, k, sqrt(dx * dx + dy * dy) AS len, degrees(atan2(dy, dx)) AS dir FROM (SELECT sample_id, CASE WHEN step < 30 THEN 'hist' ELSE 'fut' END AS side, step AS k,
  x - CASE WHEN step = 30 THEN 0 ELSE lag(x) OVER w END AS dx, y - CASE WHEN step = 30 THEN 0 ELSE lag(y) OVER w END AS dy FROM placed WINDOW w AS (PARTITION BY sample_id ORDER BY step)) WHERE dx IS NOT NULL"""
TURNS = f"SELECT *, CASE WHEN lag(dir) OVER w IS NOT NULL THEN {wrap('dir - lag(dir) OVER w')} END AS turn, count(*) OVER (PARTITION BY sample_id, side) AS steps, row_number() OVER w AS nr FROM steps WINDOW w AS (PARTITION BY sample_id, side ORDER BY k)"
PATHS = """SELECT sample_id, side, sum(len) AS path, avg(turn) AS turn_mean, max(turn) AS turn_max, stddev_pop(len) / avg(len) AS cv, median(len) / 20 * 1.9438444924406 AS median_kn, max(len) / greatest(median(len), 1.0) AS outlier,
  avg(CAST(len >= 5 AS INT)) AS nonzero, avg(CAST(len <= 10 AS INT)) AS pause, degrees(atan2(sum(sin(radians(dir))) FILTER (nr > steps - 5), sum(cos(radians(dir))) FILTER (nr > steps - 5))) AS bearing FROM turns GROUP BY 1, 2"""
ENDS = "SELECT sample_id, sqrt(pow(max(x) FILTER (step = 59), 2) + pow(max(y) FILTER (step = 59), 2)) AS from_origin FROM placed GROUP BY 1"
ANGLES = """SELECT sample_id, step, degrees(atan2(round_even(sin(radians(coalesce(round_even(cog * 1e4, 0) / 1e4, 0))) * 1e6, 0) / 1e6, round_even(cos(radians(coalesce(round_even(cog * 1e4, 0) / 1e4, 0))) * 1e6, 0) / 1e6)) AS cog,
  degrees(atan2(round_even(sin(radians(coalesce(round_even(heading * 1e4, 0) / 1e4, 0))) * 1e6, 0) / 1e6, round_even(cos(radians(coalesce(round_even(heading * 1e4, 0) / 1e4, 0))) * 1e6, 0) / 1e6)) AS heading, coalesce(round_even(sog * 1e4, 0) / 1e4, 0) AS sog FROM points WHERE step < 30"""
MOVED = "SELECT sample_id, k, dir, row_number() OVER (PARTITION BY sample_id ORDER BY k DESC) AS back FROM steps WHERE side = 'hist' AND k >= 24 AND len >= 1e-6"
COURSE = f"""SELECT sample_id, avg({wrap('m.dir - a.cog')}) AS cog_mae, degrees(atan2(sum(sin(radians(m.dir))) FILTER (back <= 5), sum(cos(radians(m.dir))) FILTER (back <= 5))) AS recent
  FROM (SELECT *, 30 - back AS step FROM moved) m JOIN angles a USING (sample_id, step) GROUP BY 1"""
SIDES = f"SELECT sample_id, avg({wrap('cog - heading')}) AS heading_mae, median(sog) AS sog_median FROM angles GROUP BY 1"
METRICS = f"""SELECT b.*, h.path AS h_path, h.turn_mean AS h_turn_mean, h.turn_max AS h_turn_max, h.cv AS h_cv, h.outlier AS h_outlier, h.nonzero AS h_nonzero, h.pause AS h_pause, hd / h.path AS h_eff,
  f.path AS f_path, f.turn_mean AS f_turn_mean, f.turn_max AS f_turn_max, f.cv AS f_cv, f.outlier AS f_outlier, f.nonzero AS f_nonzero, f.pause AS f_pause, e.from_origin / f.path AS f_eff, fd / greatest(f.path, 1.0) AS linearity,
  {wrap('f.bearing - coalesce(c.recent, h.bearing)')} AS bridge, coalesce(c.cog_mae, 0) AS cog_mae, s.heading_mae, s.sog_median
  FROM bins b JOIN (SELECT * FROM paths WHERE side = 'hist') h USING (sample_id) JOIN (SELECT * FROM paths WHERE side = 'fut') f USING (sample_id) JOIN ends e USING (sample_id) LEFT JOIN course c USING (sample_id) JOIN sides s USING (sample_id)"""
FAILS = (
    ("ship_group_excluded", "ship_group NOT IN ('cargo_tanker', 'passenger_ferry')"), ("not_core_eligible", "NOT core"), ("avg_speed_out_of_range", "kn < 3.5 OR kn > 22"), ("low_hist_median_speed", "sog_median < 4"),
    ("hist_speed_variability", "h_cv > 0.35"), ("hist_efficiency", "h_eff < 0.9"), ("fut_efficiency", "f_eff < 0.94"), ("future_linearity", "linearity < 0.94"), ("hist_nonzero_ratio", "h_nonzero < 0.85"), ("fut_nonzero_ratio", "f_nonzero < 0.9"),
    ("hist_pause_ratio", "h_pause > 0.18"), ("fut_pause_ratio", "f_pause > 0.15"), ("bridge_turn", "bridge > 30"), ("hist_turn_mean", "h_turn_mean > 10"), ("fut_turn_mean", "f_turn_mean > 8"), ("hist_turn_max", "h_turn_max > 35"),
    ("fut_turn_max", "f_turn_max > 28"), ("step_outlier_ratio", "h_outlier > 3 OR f_outlier > 3"), ("interp_ratio_total", "it > 0.12"), ("interp_ratio_side", "ih > 0.1 OR if > 0.1"), ("interp_true_ratio", "ih > 0.12 OR if > 0.12"),
    ("hist_cog_motion_mae", "cog_mae > 22"), ("hist_heading_cog_mae", "heading_mae > 20"),
)


def c01(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


SCORE = "14 * f_eff + 10 * h_eff + 9 * linearity + " + " + ".join(f"{w} * {c01(f'1 - {m} / {d}')}" for m, w, d in (("f_turn_mean", 8, 8.0), ("h_cv", 8, 0.35), ("h_turn_mean", 6, 10.0), ("bridge", 6, 30.0), ("h_pause", 5, 0.18), ("f_pause", 5, 0.15), ("it", 5, 0.12), ("h_outlier", 4, 3.0), ("f_outlier", 4, 3.0), ("cog_mae", 4, 22.0), ("heading_mae", 4, 20.0))) + " + 6 * exp(-pow((kn - 12) / 4, 2) / 2) + CASE WHEN ship_group = 'cargo_tanker' THEN 6 ELSE 4.5 END"
HARD = f"30 * (1 - f_eff) + 20 * {c01('f_turn_mean / 20')} + 15 * {c01('bridge / 45')} + 15 * f_pause + 10 * {c01('f_outlier / 4')} + 10 * {c01('it / 0.2')}"
MARGIN = "least(kn - 3.5, 22 - kn, sog_median - 4, 0.35 - h_cv, h_eff - 0.9, f_eff - 0.94, linearity - 0.94, h_nonzero - 0.85, f_nonzero - 0.9, 0.18 - h_pause, 0.15 - f_pause, 30 - bridge, 10 - h_turn_mean, 8 - f_turn_mean, 35 - h_turn_max, 28 - f_turn_max, 3 - h_outlier, 3 - f_outlier, 0.12 - it, 0.1 - ih, 0.1 - if, 0.12 - ih, 0.12 - if, 22 - cog_mae, 20 - heading_mae)"
REASON = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in FAILS) + f" WHEN {SCORE} < 60 THEN 'quality_score' END"
MORE = {"bins": BINS, "steps": STEPS, "turns": TURNS, "paths": PATHS, "ends": ENDS, "angles": ANGLES, "moved": MOVED, "course": COURSE, "sides": SIDES, "metrics": METRICS}


def over(body: str, last: str) -> str:
    names = list(MORE)
    return chain.sql(body, "samples", **{n: MORE[n] for n in names[: names.index(last) + 1]})


def evaluated(spark, d):
    return stage(spark, "evaluated", d, lambda: selection.evaluate(chain.labelled(spark, d)))


@query(over("SELECT sample_id, ship_group FROM bins", "bins"))
def ship_groups(spark, d):
    return chain.labelled(spark, d).select("sample_id", text.ship_group(F.col("ship_type"), F.col("ship_class")).alias("ship_group"))


@query(over("SELECT sample_id, speed_bin, motion_bin, CASE WHEN fd < 600 THEN 'low' WHEN fd < 1500 THEN 'mid' ELSE 'high' END AS motion_bin_representative FROM bins", "bins"))
def speed_motion_bins(spark, d):
    return evaluated(spark, d).select("sample_id", "speed_bin", "motion_bin", selection.motion_bin(F.col("fut_displacement_m"), "representative").alias("motion_bin_representative"))


@query(over(f"SELECT sample_id, CASE WHEN t < 15 THEN 'straight' WHEN t < 60 THEN 'gentle' ELSE 'sharp' END AS turn_bin FROM (SELECT sample_id, {wrap('avg(cog) FILTER (step >= 20) - avg(cog) FILTER (step < 10)')} AS t FROM angles GROUP BY 1)", "angles"))
def turn_bins(spark, d):
    return chain.labelled(spark, d).select("sample_id", selection.turn_bin(selection.angles("hist_cog_sin", "hist_cog_cos")).alias("turn_bin"))


@query(over("SELECT sample_id, round(h_path, 4) AS hist_path, round(f_path, 4) AS fut_path, round(h_eff, 6) AS hist_eff, round(f_eff, 6) AS fut_eff, round(h_cv, 6) AS hist_cv, round(h_turn_mean, 5) AS hist_turn, round(f_turn_max, 5) AS fut_turn_max, round(bridge, 5) AS bridge, round(h_outlier, 5) AS hist_outlier, round(cog_mae, 5) AS cog_mae, round(heading_mae, 5) AS heading_mae FROM metrics", "metrics"))
def path_metrics(spark, d):
    names = {"hist_path": ("hist_path_length_m", 4), "fut_path": ("fut_path_length_m", 4), "hist_eff": ("hist_efficiency", 6), "fut_eff": ("fut_efficiency", 6), "hist_cv": ("hist_speed_cv", 6), "hist_turn": ("hist_turn_mean_abs_deg", 5), "fut_turn_max": ("fut_turn_max_abs_deg", 5), "bridge": ("bridge_turn_deg", 5), "hist_outlier": ("hist_step_outlier_ratio", 5), "cog_mae": ("hist_cog_motion_mae_deg", 5), "heading_mae": ("hist_heading_cog_mae_deg", 5)}
    return evaluated(spark, d).select("sample_id", *[F.round(c, k).alias(n) for n, (c, k) in names.items()])


@query(over(f"SELECT sample_id, {REASON} AS reject_reason FROM metrics", "metrics"))
def reject_reason(spark, d):
    return evaluated(spark, d).select("sample_id", "reject_reason")


@query(over(f"SELECT coalesce({REASON}, 'eligible') AS reason, count(*) AS n FROM metrics GROUP BY 1", "metrics"))
def reject_histogram(spark, d):
    return evaluated(spark, d).groupBy(F.coalesce("reject_reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query(over(f"SELECT sample_id, round({SCORE}, 5) AS quality_score FROM metrics", "metrics"))
def quality_score(spark, d):
    return evaluated(spark, d).select("sample_id", F.round("quality_score", 5).alias("quality_score"))


@query(over(f"SELECT sample_id, round({HARD}, 5) AS difficulty_score FROM metrics", "metrics"))
def difficulty_score(spark, d):
    return evaluated(spark, d).select("sample_id", F.round("difficulty_score", 5).alias("difficulty_score"))


@query(over(f"SELECT sample_id, round({MARGIN}, 5) AS hard_filter_margin FROM metrics", "metrics"))
def hard_margin(spark, d):
    return evaluated(spark, d).select("sample_id", F.round("hard_filter_margin", 5).alias("hard_filter_margin"))


COUNTS = "SELECT ship_group, speed_bin, motion_bin, count(*) AS n FROM bins GROUP BY 1, 2, 3"


@query(over(COUNTS, "bins"))
def strata_counts(spark, d):
    return reports.strata_counts(evaluated(spark, d))


def _quota(weight: str, target: int) -> str:
    return over(f"""SELECT ship_group, speed_bin, motion_bin, n, base + CASE WHEN is_open AND nr <= rest THEN 1 ELSE 0 END AS quota FROM (SELECT *, row_number() OVER (ORDER BY is_open DESC, exact - base DESC, n - base DESC, ship_group DESC, speed_bin DESC, motion_bin DESC) AS nr FROM (
      SELECT *, base < n AS is_open, {target} - sum(base) OVER () AS rest FROM (SELECT *, least(n, CAST(floor(exact) AS BIGINT)) AS base FROM (SELECT *, {target} * w / sum(w) OVER () AS exact FROM (SELECT *, {weight} AS w FROM ({COUNTS}))))))""", "bins")


@query(_quota("sqrt(n)", 100))
def quota_sqrt(spark, d):
    return selection.quota_sqrt(reports.strata_counts(evaluated(spark, d)), 100)


@query(_quota("""pow(n, 0.92) * CASE ship_group WHEN 'cargo_tanker' THEN 1.0 WHEN 'passenger_ferry' THEN 0.9 ELSE 0.5 END * CASE speed_bin WHEN '0_5' THEN 0.45 WHEN '15_20' THEN 0.82 WHEN 'gt20' THEN 0.55 ELSE 1.0 END
  * CASE motion_bin WHEN 'low' THEN 0.8 WHEN 'mid' THEN 1.0 ELSE 0.72 END""", 100))
def quota_weighted(spark, d):
    return selection.quota_weighted(reports.strata_counts(evaluated(spark, d)), 100)


@query(over("SELECT sample_id, ship_group, speed_bin, motion_bin FROM bins QUALIFY row_number() OVER (PARTITION BY ship_group, speed_bin, motion_bin ORDER BY md5(sample_id)) <= 5", "bins"))
def stratum_topk(spark, d):
    return reports.top_per_group(evaluated(spark, d), list(selection.STRATUM), [F.md5("sample_id")], 5).select("sample_id", *selection.STRATUM)


@query(over(f"SELECT ship_group, count(*) AS n, round(avg(q), 4) AS mean, round(median(q), 4) AS median, round(list_sort(list(q))[CAST(round_even(0.9 * (count(*) - 1), 0) AS INT) + 1], 4) AS p90, round(min(q), 4) AS min, round(max(q), 4) AS max FROM (SELECT ship_group, {SCORE} AS q FROM metrics) GROUP BY 1", "metrics"))
def numeric_summary(spark, d):
    return selection.numeric_summary(evaluated(spark, d), "quality_score", "ship_group")


@query(over(f"SELECT {SPLIT} AS split, count(*) AS samples, count(DISTINCT mmsi) AS vessels, count(DISTINCT segment_id) AS segments FROM bins GROUP BY 1", "bins"))
def split_report(spark, d):
    return reports.split_report(_candidates(spark, d)).select("split", "samples", "vessels", "segments")


def _candidates(spark, d):
    return evaluated(spark, d).withColumn("split", text.split_of(F.col("mmsi")))


@query()
def select_representative(spark, d):
    turn = selection.turn_bin(selection.angles("hist_cog_sin", "hist_cog_cos"))
    eligible = _candidates(spark, d).where("core_eligible").withColumns({"motion_bin": selection.motion_bin(F.col("fut_displacement_m"), "representative"), "turn_bin": turn})
    return selection.select_representative(selection.with_stable_hashes(eligible), [F.col("hash_frame")], 40)


@query()
def select_clean(spark, d):
    ordered = selection.with_stable_hashes(_candidates(spark, d).where("reject_reason is null"))
    return selection.select_quality_first(ordered, [-F.col("quality_score"), F.col("difficulty_score"), F.col("hash_blake")], 24)


@query()
def stable_hashes(spark, d):
    return selection.with_stable_hashes(chain.labelled(spark, d).select("sample_id"))
