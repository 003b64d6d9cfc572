"""Thresholds of the cleaning and sampling stages. Defaults are those of the released data set."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

#: Units, ids and caps in knots.
KNOTS_PER_MPS = 1.9438444924406
EARTH_RADIUS_M = 6_371_000.0
SHIP_CLASS_IDS = {"unknown": 0, "cargo": 1, "tanker": 2, "bulk": 3, "container": 4, "passenger": 5, "ferry": 6, "fishing": 7, "tug": 8, "service": 9}
SHIP_CLASS_CAPS = {"cargo": 35.0, "tanker": 35.0, "bulk": 35.0, "container": 35.0, "passenger": 45.0, "ferry": 45.0, "fishing": 25.0, "tug": 20.0, "service": 20.0}


@dataclass(frozen=True)
class Thresholds:
    sog_sentinel: float = 102.2
    cog_sentinel: float = 360.0
    heading_sentinel: float = 511.0
    lat_sentinel: float = 91.0
    lon_sentinel: float = 181.0
    hard_cap_knots: float = 55.0
    segment_gap_s: float = 600.0
    implied_speed_factor: float = 1.4
    implied_speed_margin_knots: float = 5.0
    anchor_run_s: float = 300.0
    low_speed_knots: float = 0.5
    low_speed_run_s: float = 300.0
    low_displacement_window_s: int = 1200
    low_displacement_m: float = 150.0
    step_s: int = 20
    short_gap_s: float = 120.0
    medium_gap_s: float = 300.0
    sog_interp_diff_knots: float = 8.0
    anomaly_offset_m: float = 200.0
    anomaly_margin_knots: float = 8.0
    anomaly_gap_s: float = 40.0
    min_points: int = 80
    min_duration_s: float = 1500.0
    hist_points: int = 30
    fut_points: int = 30
    window_step: int = 5
    max_gap_s: float = 40.0
    min_displacement_m: float = 200.0
    min_fut_displacement_m: float = 200.0
    core_interp_hist: float = 0.20
    core_interp_fut: float = 0.20
    core_interp_total: float = 0.15
    caps: dict[str, float] = field(default_factory=lambda: dict(SHIP_CLASS_CAPS))


DEFAULT = Thresholds()

#: Names of thresholds in a configuration file, and the fields that they set.
NAMES = {
    "sog_unavailable_knots": "sog_sentinel", "cog_unavailable_degrees": "cog_sentinel", "heading_unavailable_value": "heading_sentinel", "global_hard_speed_cap_knots": "hard_cap_knots",
    "segmentation_gap_seconds": "segment_gap_s", "implied_speed_factor": "implied_speed_factor", "underway_low_speed_knots": "low_speed_knots", "underway_low_speed_duration_seconds": "low_speed_run_s",
    "anchor_moored_duration_seconds": "anchor_run_s", "low_displacement_window_seconds": "low_displacement_window_s", "low_displacement_window_meters": "low_displacement_m",
    "short_gap_max_seconds": "short_gap_s", "medium_gap_max_seconds": "medium_gap_s", "sog_interp_diff_max_knots": "sog_interp_diff_knots", "resample_interval_seconds": "step_s",
    "secondary_anomaly_offset_meters": "anomaly_offset_m", "secondary_anomaly_speed_margin_knots": "anomaly_margin_knots", "min_resampled_points": "min_points", "min_segment_duration_seconds": "min_duration_s",
    "sliding_window_hist_points": "hist_points", "sliding_window_fut_points": "fut_points", "sliding_window_step_points": "window_step", "max_unprocessed_gap_seconds": "max_gap_s",
    "min_hist_displacement_meters": "min_displacement_m", "min_fut_displacement_meters": "min_fut_displacement_m",
    "core_interp_ratio_hist_max": "core_interp_hist", "core_interp_ratio_fut_max": "core_interp_fut", "core_interp_ratio_total_max": "core_interp_total",
}


def thresholds_of(config: dict) -> Thresholds:
    """Thresholds of a configuration with sections `thresholds` and `ship_type_caps`; what it leaves out keeps its default.

    An unknown name is an error, so a misspelt threshold doesn't pass for a default.
    """
    given = config.get("thresholds") or {}
    if unknown := sorted(set(given) - set(NAMES)):
        raise KeyError(f"unknown thresholds: {unknown}")
    kinds = {f: type(getattr(DEFAULT, f)) for f in NAMES.values()}
    caps = {k: float(v) for k, v in (config.get("ship_type_caps") or {}).items()}
    return replace(DEFAULT, **{NAMES[k]: kinds[NAMES[k]](v) for k, v in given.items()}, caps=DEFAULT.caps | caps)


def load_thresholds(path: str) -> Thresholds:
    """From a YAML file (if PyYAML is there) or a JSON file."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return thresholds_of(json.loads(text))
    import yaml

    return thresholds_of(yaml.safe_load(text) or {})
