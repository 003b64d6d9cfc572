"""Subset selection: bins, path metrics, ordered filters, scores, quotas, constrained greedy choice."""

from __future__ import annotations

import uuid
from decimal import Decimal
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.arrays import at, displacement, mean, median, pstdev, total
from ..plans.config import KNOTS_PER_MPS
from ..plans.stages import shared_folder, ship_code

#: Limits of the quality-first subset, quota weights, bin edges of the two builders.
LIMITS = {
    "min_avg_speed": 3.5, "max_avg_speed": 22.0, "min_hist_median_speed": 4.0, "max_hist_speed_cv": 0.35, "min_hist_efficiency": 0.9, "min_fut_efficiency": 0.94, "min_future_linearity": 0.94,
    "min_hist_nonzero": 0.85, "min_fut_nonzero": 0.9, "max_hist_pause": 0.18, "max_fut_pause": 0.15, "max_bridge_turn": 30.0, "max_hist_turn_mean": 10.0, "max_fut_turn_mean": 8.0,
    "max_hist_turn_max": 35.0, "max_fut_turn_max": 28.0, "max_outlier": 3.0, "max_interp_total": 0.12, "max_interp_side": 0.1, "max_interp_true": 0.12, "max_cog_mae": 22.0, "max_heading_mae": 20.0,
    "min_quality": 60.0,
}
SPEED_WEIGHTS = {"0_5": 0.45, "5_10": 1.0, "10_15": 1.0, "15_20": 0.82, "gt20": 0.55}
MOTION_WEIGHTS = {"low": 0.8, "mid": 1.0, "high": 0.72}
GROUP_WEIGHTS = {"cargo_tanker": 1.0, "passenger_ferry": 0.9}
MOTION_EDGES = {"representative": (600.0, 1500.0), "quality": (700.0, 1700.0)}
ALLOWED = ("cargo_tanker", "passenger_ferry")
STRATUM = ("ship_group", "speed_bin", "motion_bin")
#: Ranges of values that numeric_summary adds counts up in.
RANGES = 64


def average_speed(hist: Column, fut: Column) -> Column:
    return 0.5 * (hist + fut) / 600.0 * KNOTS_PER_MPS


def speed_bin(knots: Column) -> Column:
    return F.when(knots < 5, "0_5").when(knots < 10, "5_10").when(knots < 15, "10_15").when(knots < 20, "15_20").otherwise("gt20")


def motion_bin(displacement_m: Column, edges: str = "quality") -> Column:
    low, high = MOTION_EDGES[edges]
    return F.when(displacement_m < low, "low").when(displacement_m < high, "mid").otherwise("high")


def angles(sin: str, cos: str) -> Column:
    return F.zip_with(sin, cos, lambda s, c: F.degrees(F.atan2(s, c)))


def turn_bin(angle: Column) -> Column:
    """By the change between plain means of the first and last ten angles."""
    change = geo.turn_degrees(mean(F.slice(angle, 1, 10)), mean(F.slice(angle, F.greatest(F.size(angle) - 9, F.lit(1)), F.lit(10))))
    return F.when((F.size(angle) < 6) | F.exists(angle, lambda v: v.isNull() | F.isnan(v)), "unknown_turn").when(change < 15, "straight").when(change < 60, "gentle").otherwise("sharp")


def mean_angle(a: Column) -> Column:
    s, c = total(F.transform(a, lambda v: F.sin(F.radians(v)))), total(F.transform(a, lambda v: F.cos(F.radians(v))))
    return F.when(F.size(a) == 0, 0.0).when((F.abs(s) < 1e-9) & (F.abs(c) < 1e-9), at(a, -1)).otherwise(F.degrees(F.atan2(s, c)))


def angle_error(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, mean(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), geo.turn_degrees))).otherwise(0.0)


def steps(x: Column, y: Column, origin: bool) -> tuple[Column, Column]:
    """Lengths and bearings of the steps of a path, the first one from the origin if asked."""
    if origin:
        before = lambda c, i: F.when(i == 0, 0.0).otherwise(F.get(c, i - 1))
        pairs = F.transform(x, lambda v, i: F.struct((v - before(x, i)).alias("dx"), (F.get(y, i) - before(y, i)).alias("dy")))
    else:
        pairs = F.transform(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda v, i: F.struct((v - F.get(x, i)).alias("dx"), (F.get(y, i + 1) - F.get(y, i)).alias("dy")))
    return F.transform(pairs, lambda p: F.hypot(p["dx"], p["dy"])), F.transform(pairs, lambda p: F.degrees(F.atan2(p["dy"], p["dx"])))


def with_path_metrics(df: DataFrame, side: str, origin: bool) -> DataFrame:
    """Metrics of the path <side>_x, <side>_y as columns <side>_...; a path without steps gets the defaults."""
    x, y = F.col(f"{side}_x"), F.col(f"{side}_y")
    length, bearing = steps(x, y, origin)
    df = df.withColumns({"_len": length, "_dir": bearing})
    df = df.withColumns({
        "_kn": F.transform("_len", lambda v: v / 20.0 * KNOTS_PER_MPS),
        "_turn": F.transform(F.slice(F.col("_dir"), F.lit(2), F.greatest(F.size("_dir") - 1, F.lit(0))), lambda v, i: geo.turn_degrees(F.get("_dir", i), v)),
        "_disp": F.hypot(at(x, -1), at(y, -1)) if origin else displacement(f"{side}_x", f"{side}_y"),
    })
    n, path = F.size("_len"), total(F.col("_len"))
    share = lambda f: F.size(F.filter("_len", f)) / F.size("_len")
    metrics = {
        "path_length_m": (path, 0.0), "path_displacement_m": (F.col("_disp"), 0.0), "efficiency": (F.when(path > 1e-6, F.col("_disp") / path).otherwise(0.0), 0.0),
        "median_speed_knots": (median(F.col("_kn")), 0.0), "speed_cv": (F.when(mean(F.col("_kn")) > 1e-6, pstdev(F.col("_kn")) / mean(F.col("_kn"))).otherwise(0.0), 0.0),
        "nonzero_ratio": (share(lambda v: v >= 5.0), 0.0), "pause_ratio": (share(lambda v: v <= 10.0), 1.0), "turn_mean_abs_deg": (mean(F.col("_turn")), 180.0),
        "turn_max_abs_deg": (F.coalesce(F.array_max("_turn"), F.lit(0.0)), 180.0), "step_outlier_ratio": (F.array_max("_len") / F.greatest(median(F.col("_len")), F.lit(1.0)), 999.0),
        "recent_bearing_deg": (mean_angle(F.slice(F.col("_dir"), F.greatest(F.size("_dir") - 4, F.lit(1)), F.lit(5))), 0.0), "turn_count": (F.size("_turn").cast("double"), 0.0),
    }
    return df.withColumns({f"{side}_{k}": F.when(n > 0, v).otherwise(d) for k, (v, d) in metrics.items()}).drop("_len", "_dir", "_kn", "_turn", "_disp")


def recent_bearings(x: Column, y: Column, count: int = 6) -> Column:
    n = F.size(x)
    first = F.greatest(F.lit(1), n - count)
    index = F.when(n >= 2, F.sequence(first, n - 1)).otherwise(F.array().cast("array<int>"))
    moved = F.transform(index, lambda i: F.struct((F.get(x, i) - F.get(x, i - 1)).alias("dx"), (F.get(y, i) - F.get(y, i - 1)).alias("dy")))
    return F.transform(F.filter(moved, lambda p: F.hypot(p["dx"], p["dy"]) >= 1e-6), lambda p: F.degrees(F.atan2(p["dy"], p["dx"])))


def candidate_metrics(samples: DataFrame, bearing: str = "as_coded") -> DataFrame:
    """All metrics of a sample. bearing: as_coded compares compass courses with mathematical bearings, compass corrects it."""
    df = with_path_metrics(with_path_metrics(samples, "hist", False), "fut", True)
    motion = recent_bearings(F.col("hist_x"), F.col("hist_y"))
    df = df.withColumns({"_motion": motion, "_cog": angles("hist_cog_sin", "hist_cog_cos"), "_heading": angles("hist_heading_sin", "hist_heading_cos")})
    compared = F.col("_motion") if bearing == "as_coded" else F.transform("_motion", lambda v: 90.0 - v)
    last_cog = F.slice(F.col("_cog"), F.greatest(F.size("_cog") - F.size("_motion") + 1, F.lit(1)), F.size("_motion"))
    recent = F.when(F.size("_motion") > 0, mean_angle(F.slice(F.col("_motion"), F.greatest(F.size("_motion") - 4, F.lit(1)), F.lit(5)))).otherwise(F.col("hist_recent_bearing_deg"))
    return df.withColumns({
        "ship_group": text.ship_group(F.col("ship_type"), F.col("ship_class")),
        "avg_speed_knots": average_speed(F.col("hist_displacement_m"), F.col("fut_displacement_m")),
        "hist_median_sog_knots": median(F.col("hist_sog")), "future_linearity": F.col("fut_displacement_m") / F.greatest("fut_path_length_m", F.lit(1.0)),
        "bridge_turn_deg": geo.turn_degrees(recent, F.col("fut_recent_bearing_deg")),
        "hist_cog_motion_mae_deg": F.when((F.size("_motion") > 0) & (F.size("_cog") > 0), angle_error(last_cog, compared)).otherwise(0.0),
        "hist_heading_cog_mae_deg": angle_error(F.col("_heading"), F.col("_cog")),
        "hist_interp_true_ratio": mean(F.transform("hist_interp", lambda v: v.cast("double"))), "fut_interp_true_ratio": mean(F.transform("fut_interp", lambda v: v.cast("double"))),
    }).withColumns({"speed_bin": speed_bin(F.col("avg_speed_knots")), "motion_bin": motion_bin(F.col("fut_displacement_m"))}).drop("_motion", "_cog", "_heading")


#: Reason, and the metric's limits as (metric, sign, limit): sign 1 means at least, -1 at most. In order of testing.
CHECKS: tuple[tuple[str, tuple[tuple[str, int, str], ...]], ...] = (
    ("avg_speed_out_of_range", (("avg_speed_knots", 1, "min_avg_speed"), ("avg_speed_knots", -1, "max_avg_speed"))),
    ("low_hist_median_speed", (("hist_median_sog_knots", 1, "min_hist_median_speed"),)),
    ("hist_speed_variability", (("hist_speed_cv", -1, "max_hist_speed_cv"),)),
    ("hist_efficiency", (("hist_efficiency", 1, "min_hist_efficiency"),)),
    ("fut_efficiency", (("fut_efficiency", 1, "min_fut_efficiency"),)),
    ("future_linearity", (("future_linearity", 1, "min_future_linearity"),)),
    ("hist_nonzero_ratio", (("hist_nonzero_ratio", 1, "min_hist_nonzero"),)),
    ("fut_nonzero_ratio", (("fut_nonzero_ratio", 1, "min_fut_nonzero"),)),
    ("hist_pause_ratio", (("hist_pause_ratio", -1, "max_hist_pause"),)),
    ("fut_pause_ratio", (("fut_pause_ratio", -1, "max_fut_pause"),)),
    ("bridge_turn", (("bridge_turn_deg", -1, "max_bridge_turn"),)),
    ("hist_turn_mean", (("hist_turn_mean_abs_deg", -1, "max_hist_turn_mean"),)),
    ("fut_turn_mean", (("fut_turn_mean_abs_deg", -1, "max_fut_turn_mean"),)),
    ("hist_turn_max", (("hist_turn_max_abs_deg", -1, "max_hist_turn_max"),)),
    ("fut_turn_max", (("fut_turn_max_abs_deg", -1, "max_fut_turn_max"),)),
    ("step_outlier_ratio", (("hist_step_outlier_ratio", -1, "max_outlier"), ("fut_step_outlier_ratio", -1, "max_outlier"))),
    ("interp_ratio_total", (("interp_ratio_total", -1, "max_interp_total"),)),
    ("interp_ratio_side", (("interp_ratio_hist", -1, "max_interp_side"), ("interp_ratio_fut", -1, "max_interp_side"))),
    ("interp_true_ratio", (("hist_interp_true_ratio", -1, "max_interp_true"), ("fut_interp_true_ratio", -1, "max_interp_true"))),
    ("hist_cog_motion_mae", (("hist_cog_motion_mae_deg", -1, "max_cog_mae"),)),
    ("hist_heading_cog_mae", (("hist_heading_cog_mae_deg", -1, "max_heading_mae"),)),
)


def _slack(check: tuple[str, int, str], limits: dict[str, float]) -> Column:
    metric, sign, limit = check
    return (F.col(metric) - limits[limit]) * sign


def margin(limits: dict[str, float] = LIMITS) -> Column:
    """Smallest distance of any metric from its limit; negative if one fails."""
    return F.least(*[_slack(c, limits) for _, cs in CHECKS for c in cs])


def gauss(v: Column, center: float, scale: float) -> Column:
    return F.exp(-F.pow((v - center) / scale, 2) / 2)


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def quality_score() -> Column:
    terms = (("fut_turn_mean_abs_deg", 8, 8), ("hist_speed_cv", 8, 0.35), ("hist_turn_mean_abs_deg", 6, 10), ("bridge_turn_deg", 6, 30), ("hist_pause_ratio", 5, 0.18), ("fut_pause_ratio", 5, 0.15), ("interp_ratio_total", 5, 0.12), ("hist_step_outlier_ratio", 4, 3), ("fut_step_outlier_ratio", 4, 3), ("hist_cog_motion_mae_deg", 4, 22), ("hist_heading_cog_mae_deg", 4, 20))
    score = 14.0 * F.col("fut_efficiency") + 10.0 * F.col("hist_efficiency") + 9.0 * F.col("future_linearity")
    for metric, weight, limit in terms:
        score = score + float(weight) * clamp01(1.0 - F.col(metric) / float(limit))
    return score + 6.0 * gauss(F.col("avg_speed_knots"), 12.0, 4.0) + F.when(F.col("ship_group") == "cargo_tanker", 6.0).otherwise(4.5)


def difficulty_score() -> Column:
    part = lambda c, w, d: w * clamp01(F.col(c) / d)
    return 30.0 * (1.0 - F.col("fut_efficiency")) + part("fut_turn_mean_abs_deg", 20.0, 20.0) + part("bridge_turn_deg", 15.0, 45.0) + 15.0 * F.col("fut_pause_ratio") + part("fut_step_outlier_ratio", 10.0, 4.0) + part("interp_ratio_total", 10.0, 0.2)


def reject_reason(limits: dict[str, float] = LIMITS, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """The first failing check of a sample with metrics; null for candidates."""
    checks = [
        F.when(~F.col("ship_group").isin(*allowed), "ship_group_excluded"), F.when(~F.coalesce("core_eligible", F.lit(True)), "not_core_eligible"), F.when(F.col("quality_tier") != "core", "quality_tier_not_core"),
        F.when(~F.coalesce("hist_gap_ok", F.lit(True)), "hist_gap_not_ok"), F.when(~F.coalesce("fut_gap_ok", F.lit(True)), "fut_gap_not_ok"), F.when((F.size("hist_x") < 12) | (F.size("fut_x") < 12), "too_few_points"),
    ]
    for reason, cs in CHECKS:
        passed = F.lit(True)
        for metric, sign, limit in cs:
            passed = passed & (F.col(metric) >= limits[limit] if sign > 0 else F.col(metric) <= limits[limit])
        checks.append(F.when(~F.coalesce(passed, F.lit(False)), reason))
    return F.coalesce(*checks, F.when(quality_score() < limits["min_quality"], "quality_score"))


def evaluate(samples: DataFrame, bearing: str = "as_coded", limits: dict[str, float] = LIMITS) -> DataFrame:
    """Samples with metrics, scores, margin, step and reject_reason (null for candidates)."""
    df = candidate_metrics(samples, bearing)
    step = F.coalesce(F.element_at(F.split("sample_id", "_"), -1).try_cast("int"), F.lit(-1))
    return df.withColumns({"quality_score": quality_score(), "difficulty_score": difficulty_score(), "hard_filter_margin": margin(limits), "sample_step": step}).withColumn("reject_reason", reject_reason(limits))


def quotas(counts: DataFrame, weight: Column, target: int, n: str = "n") -> DataFrame:
    """Shares of a target by weight: whole parts, capped by the counts, then one more by largest remainder.

    counts has a row per stratum, some hundred at most. Ties of the remainder go to the larger room, then the larger stratum.
    """
    keys = [c for c in counts.columns if c != n]
    everything = Window.partitionBy(F.lit(0))
    df = counts.withColumn("_w", weight).withColumn("_exact", F.lit(float(target)) * F.col("_w") / F.sum("_w").over(everything))
    df = df.withColumn("_base", F.least(F.col(n), F.floor("_exact")))
    df = df.withColumns({"_rest": F.lit(target) - F.sum("_base").over(everything), "_open": F.col("_base") < F.col(n)})
    order = everything.orderBy(F.desc("_open"), F.desc(F.col("_exact") - F.col("_base")), F.desc(F.col(n) - F.col("_base")), *[F.desc(k) for k in keys])
    more = F.col("_open") & (F.row_number().over(order) <= F.col("_rest"))
    return df.withColumn("quota", (F.col("_base") + more.cast("int")).cast("long")).select(*keys, n, "quota")


def quota_sqrt(counts: DataFrame, target: int, n: str = "n") -> DataFrame:
    return quotas(counts, F.sqrt(F.col(n)), target, n)


def quota_weighted(counts: DataFrame, target: int, exponent: float = 0.92, n: str = "n") -> DataFrame:
    weight = lambda c, values, d: F.coalesce(text.class_value(F.col(c), values), F.lit(d))
    return quotas(counts, F.pow(F.col(n), exponent) * weight("ship_group", GROUP_WEIGHTS, 0.5) * weight("speed_bin", SPEED_WEIGHTS, 0.75) * weight("motion_bin", MOTION_WEIGHTS, 0.8), target, n)


class Caps:
    """What has been taken of each vessel and segment, and whether another sample fits."""

    def __init__(self, per_vessel: int, per_segment: int, step_gap: int):
        self.limits, self.vessels, self.segments, self.taken = (per_vessel, per_segment, step_gap), {}, {}, []

    def take(self, r) -> bool:
        per_vessel, per_segment, gap = self.limits
        steps = self.segments.get(r.segment_id, [])
        # samples without a step (-1) are apart from all others
        near = r.sample_step >= 0 and any(s >= 0 and abs(r.sample_step - s) < gap for s in steps)
        if self.vessels.get(r.mmsi, 0) >= per_vessel or len(steps) >= per_segment or near:
            return False
        self.vessels[r.mmsi] = self.vessels.get(r.mmsi, 0) + 1
        self.segments.setdefault(r.segment_id, []).append(r.sample_step)
        self.taken.append(r)
        return True


def shares(counts: dict[str, int], target: int) -> dict[str, int]:
    """Parts of a target by the square root of the counts, as quotas() divides them among strata."""
    whole = sum(n**0.5 for n in counts.values())
    exact = {k: target * n**0.5 / whole for k, n in counts.items()}
    base = {k: min(n, int(exact[k])) for k, n in counts.items()}
    order = sorted(counts, key=lambda k: (exact[k] - base[k], counts[k] - base[k], k), reverse=True)
    for k in [k for k in order if base[k] < counts[k]][: target - sum(base.values())]:
        base[k] += 1
    return base


def choose(pool: pd.DataFrame, target: int, per_vessel: int, per_segment: int, step_gap: int, open_strata: frozenset = frozenset()) -> tuple[pd.DataFrame, set]:
    """Greedy choice: strata by name, each in order of place up to its quota, then all others by place until the target is met.

    pool has each stratum's first rows with `place`, a rank over all strata; open_strata have more rows than the pool holds.
    Returns the choice, and those strata whose further rows could have changed it.
    """
    caps, filled, short = Caps(per_vessel, per_segment, step_gap), {}, set()
    pool = pool.sort_values([*STRATUM, "place"], kind="stable")
    for r in pool.itertuples():
        key = (r.ship_group, r.speed_bin, r.motion_bin)
        if filled.get(key, 0) < r.quota and caps.take(r):
            filled[key] = filled.get(key, 0) + 1
    last = pool.groupby(list(STRATUM))["place"].max().to_dict() if len(pool) else {}
    quota = pool.groupby(list(STRATUM))["quota"].first().to_dict() if len(pool) else {}
    short |= {k for k in open_strata if filled.get(k, 0) < quota.get(k, 0)}
    have = {r.Index for r in caps.taken}
    for r in pool.sort_values("place", kind="stable").itertuples():
        if len(caps.taken) >= target:
            break
        short |= {k for k in open_strata if last[k] < r.place}  # rows of that stratum would come before this one
        if r.Index not in have:
            caps.take(r)
    else:
        if len(caps.taken) < target:
            short |= set(open_strata)
    return pool.loc[[r.Index for r in caps.taken[:target]], ["split", "sample_id"]], short


def choose_nested(pool: pd.DataFrame, target: int, per_vessel: int, per_segment: int, step_gap: int) -> pd.DataFrame:
    """Greedy choice with nested quotas: in each stratum by bins of turn, then the stratum's rest, then the rest of all.

    pool has `place`, the order within and over strata; the choice is cut to the target in that order.
    """
    caps = Caps(per_vessel, per_segment, step_gap)
    for _, own in pool.sort_values([*STRATUM, "place"], kind="stable").groupby(list(STRATUM), sort=True):
        before, left = len(caps.taken), []
        quota = int(own["quota"].iloc[0])
        for turn, part in sorted(shares(own["turn_bin"].value_counts().to_dict(), quota).items()):
            taken = 0
            for r in own[own["turn_bin"] == turn].itertuples():
                if taken < part and caps.take(r):
                    taken += 1
                else:
                    left.append(r)
        for r in sorted(left, key=lambda r: r.place):
            if len(caps.taken) - before >= quota:
                break
            caps.take(r)
    have = {r.Index for r in caps.taken}
    for r in pool.sort_values("place", kind="stable").itertuples():
        if len(caps.taken) >= target:
            break
        if r.Index not in have:
            caps.take(r)
    best = sorted(caps.taken, key=lambda r: r.place)[:target]
    return pool.loc[[r.Index for r in best], ["split", "sample_id"]]


POOL = ("split", "sample_id", "mmsi", "segment_id", "sample_step", *STRATUM)


def _ranked(candidates: DataFrame, order: list[Column], target: int, weighted: bool, *more: str) -> DataFrame:
    """Candidates with their stratum's quota, rank in the stratum (_rank) and the values they are ordered by (o0, o1, ...)."""
    counts = candidates.groupBy("split", *STRATUM).agg(F.count("*").alias("n"))
    share = quota_weighted if weighted else quota_sqrt
    parts = [share(counts.where(F.col("split") == s).drop("split"), target).withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    quota = parts[0].unionByName(parts[1]).unionByName(parts[2])
    keys = ["split", *STRATUM]
    named = candidates.select(*POOL, *more, *[o.alias(f"o{k}") for k, o in enumerate(order)])
    named = named.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*[f"o{k}" for k in range(len(order))], "sample_id")))
    return named.join(F.broadcast(quota.withColumnRenamed("n", "_size")), keys)


def _placed(pool: pd.DataFrame, n: int) -> pd.DataFrame:
    """The pool with each row's place in the order of o0, o1, ..., sample_id."""
    pool = pool.sort_values([*[f"o{k}" for k in range(n)], "sample_id"], kind="stable").reset_index(drop=True)
    return pool.assign(place=range(len(pool)))


def select_quality_first(candidates: DataFrame, order: list[Column], target: int, per_vessel: int = 12, per_segment: int = 3, step_gap: int = 20, head: int = 4) -> DataFrame:
    """(split, sample_id) of a constrained choice per split from all candidates, in the given order.

    The choice is sequential by nature. It runs over the head of each stratum, some times its quota; where a stratum's
    further rows could change the choice, as caps used up its head, its head is doubled and the choice made again. So the
    driver holds some times the target unless the caps reject more.
    """
    spark = candidates.sparkSession
    path = f"{shared_folder(spark)}/tidewake-ranked-{uuid.uuid4().hex}"
    _ranked(candidates, order, target, True).write.parquet(path)
    ranked = spark.read.parquet(path)
    strata = ranked.select("split", *STRATUM, "_size", "quota").distinct().toPandas()
    strata["cap"] = [max(head * q, q + 20) for q in strata["quota"]]
    chosen = []
    for split, own in strata.groupby("split"):
        while True:
            caps = spark.createDataFrame(own[[*STRATUM, "cap"]])
            pool = ranked.where(F.col("split") == split).join(F.broadcast(caps), list(STRATUM)).where("_rank <= cap").drop("cap")
            still_open = frozenset(tuple(r[c] for c in STRATUM) for _, r in own.iterrows() if r["cap"] < r["_size"])
            picked, short = choose(_placed(pool.toPandas(), len(order)), target, per_vessel, per_segment, step_gap, still_open)
            if not short:
                break
            own = own.assign(cap=[2 * r["cap"] if tuple(r[c] for c in STRATUM) in short else r["cap"] for _, r in own.iterrows()])
        chosen.append(picked)
    rows = pd.concat(chosen) if chosen else pd.DataFrame({"split": [], "sample_id": []})
    return spark.createDataFrame([tuple(r) for r in rows.itertuples(index=False)], "split string, sample_id string")


def select_representative(candidates: DataFrame, order: list[Column], target: int, per_vessel: int = 25, per_segment: int = 8, step_gap: int = 10) -> DataFrame:
    """(split, sample_id) of a choice per split with quotas by stratum and, within each, by turn_bin.

    It runs over each stratum's pool: its first rows, six times the quota, the quota and 20, or 50, whichever is most.
    """
    cap, n = F.greatest(F.col("quota") * 6, F.col("quota") + 20, F.lit(50)), len(order)
    pools = _ranked(candidates, order, target, False, "turn_bin").where(F.col("_rank") <= cap)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return choose_nested(_placed(group, n), target, per_vessel, per_segment, step_gap)

    ship_code()
    return pools.groupBy("split").applyInPandas(run, "split string, sample_id string")


def selected_rows(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """All columns of the rows whose sample_id was chosen."""
    return rows.join(chosen.select("sample_id").distinct(), "sample_id", "left_semi")


def numeric_summary(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Mean, median, nearest-rank p90, min, max to 4 decimals.

    Values are counted first, and the counts added up range by range between approximate quantiles: neither a group nor
    the whole table is in one task. The ranges decide where the work is done, never the result. Nulls are left out; without
    keys a table of nothing else gives one row of nulls.
    """
    ends = df.agg(F.percentile_approx(column, [k / RANGES for k in range(1, RANGES)])).first()[0] or []
    range_of = F.size(F.filter(F.array(*map(F.lit, sorted(set(ends)))), lambda end: end <= F.col(column))) if ends else F.lit(0)
    values = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n")).withColumn("_range", range_of)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = values.groupBy(*keys, "_range").agg(F.sum("_n").alias("_own"))
    sums = sums.withColumns({"_before": F.sum("_own").over(group.orderBy("_range")) - F.col("_own"), "_all": F.sum("_own").over(group)})
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "_range")], "_before", "_all")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "_range")])
    within = F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy(column))
    values = values.withColumn("_within", within).join(sums, same).withColumn("_to", F.col("_before") + F.col("_within")).select(*keys, column, "_n", "_to", "_all")
    place = F.bround(0.9 * (F.col("_all") - 1)).cast("long")
    pick = lambda k: F.min(F.when(F.col("_to") > k, F.col(column)))
    middle = (pick(F.floor((F.col("_all") - 1) / 2)) + pick(F.floor(F.col("_all") / 2))) / 2
    agg = (F.sum("_n").alias("n"), (F.sum(F.col(column) * F.col("_n")) / F.sum("_n")).alias("mean"), middle.alias("median"), pick(place).alias("p90"), F.min(column).alias("min"), F.max(column).alias("max"))
    out = values.groupBy(*keys).agg(*agg)
    return out.select(*keys, "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "p90", "min", "max")])


def stable_hash_blake(ids: pd.Series) -> pd.Series:
    import hashlib

    return ids.map(lambda s: None if s is None else Decimal(int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big")))


def stable_hash_pandas(ids: pd.Series) -> pd.Series:
    return pd.Series([Decimal(int(h)) for h in pd.util.hash_pandas_object(ids, index=False)], index=ids.index, dtype=object)


def with_stable_hashes(df: DataFrame, column: str = "sample_id") -> DataFrame:
    """hash_blake and hash_frame: the two hash families that order the released selections, unsigned, as decimals of 20 digits."""
    ship_code()
    blake, frame = F.pandas_udf(stable_hash_blake, "decimal(20,0)"), F.pandas_udf(stable_hash_pandas, "decimal(20,0)")
    return df.withColumns({"hash_blake": blake(column), "hash_frame": frame(column)})
