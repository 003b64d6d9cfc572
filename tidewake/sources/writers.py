"""Sinks: partitioned stages, exports, previews, summaries. All overwrite, so a stage can be run again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import utc_text
from ..operators.spatial import LABELS


def write_partitions(df: DataFrame, path: str, parts: int = 64) -> None:
    """By vessel number modulo parts."""
    df.withColumn("part", F.pmod("mmsi", F.lit(parts))).repartition(parts, "part").write.mode("overwrite").partitionBy("part").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Gzip CSV with header; arrays become JSON text."""
    plain = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*plain).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


#: Columns of the candidates' metadata and of the anchors' file.
METADATA = (
    "sample_id", "hash_value", "split", "mmsi", "segment_id", "sample_step", "ship_group", "speed_bin", "motion_bin", "quality_score", "difficulty_score", "avg_speed_knots", "hist_median_speed_knots", "hist_speed_cv",
    "hist_efficiency", "fut_efficiency", "future_linearity", "hist_nonzero_ratio", "fut_nonzero_ratio", "hist_pause_ratio", "fut_pause_ratio", "bridge_turn_deg", "hist_turn_mean_abs_deg", "fut_turn_mean_abs_deg",
    "hist_turn_max_abs_deg", "fut_turn_max_abs_deg", "hist_step_outlier_ratio", "fut_step_outlier_ratio", "interp_ratio_hist", "interp_ratio_fut", "interp_ratio_total", "hist_interp_true_ratio", "fut_interp_true_ratio",
    "hist_cog_motion_mae_deg", "hist_heading_cog_mae_deg", "hist_displacement_m", "fut_displacement_m", "future_path_length_m", "hard_filter_margin",
)
ANCHOR = ("sample_id", "split", "mmsi", "segment_id", "hist_end_ts", "pred_end_ts", "anchor_lat", "anchor_lon", "tile_id")


def _plain_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, which an empty table has as well; times as ISO text in UTC."""
    times = {c: utc_text(F.col(c)) for c, kind in df.dtypes if kind.startswith("timestamp")}
    df = df.withColumns(times)
    (df.coalesce(1) if df.isEmpty() else df).write.mode("overwrite").option("header", True).csv(path)


def write_metadata(candidates: DataFrame, path: str) -> None:
    """The candidates' metadata, those columns in that order; a column that is missing is empty."""
    _plain_csv(candidates.select(*[F.col(c) if c in candidates.columns else F.lit(None).cast("string").alias(c) for c in METADATA]), path)


def write_anchors(anchors: DataFrame, path: str) -> None:
    """Anchors of all samples, in `all`, and of each split, in folders `split=`."""
    own = anchors.select(*ANCHOR)
    _plain_csv(own, f"{path}/all")
    own.withColumns({c: utc_text(F.col(c)) for c in ("hist_end_ts", "pred_end_ts")}).write.mode("overwrite").partitionBy("split").option("header", True).csv(f"{path}/by_split")


def write_export(versions: DataFrame, path: str) -> None:
    """The tree version=/split=."""
    versions.write.mode("overwrite").partitionBy("version", "split").parquet(path)


def write_ids(df: DataFrame, path: str) -> None:
    """Sample ids as sorted text."""
    df.select("sample_id").orderBy("sample_id").write.mode("overwrite").text(path)


def write_vectors(segments: DataFrame, path: str) -> None:
    """Clipped segments of each sample as gzip JSON lines, coordinates to two decimals."""
    point = lambda x, y: F.array(F.round(x, 2), F.round(y, 2))
    item = F.struct("osm_id", "subtype", F.array(point("x0", "y0"), point("x1", "y1")).alias("xy"))
    rows = segments.groupBy("sample_id").pivot("category", [c for names in LABELS.values() for c in names]).agg(F.collect_list(item))
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def summary_json(df: DataFrame) -> str:
    """A one-row summary as JSON with sorted keys."""
    return json.dumps(df.first().asDict(recursive=True), sort_keys=True, indent=2, default=str)


def write_selected(rows: DataFrame, chosen: DataFrame, path: str) -> None:
    """All columns of the chosen samples as gzip CSV."""
    write_csv(rows.join(chosen.select("sample_id").distinct(), "sample_id", "left_semi").orderBy("sample_id"), path)


def sample_json(samples: DataFrame) -> DataFrame:
    """(sample_id, meta): what identifies and qualifies each sample, as JSON; null fields are kept."""
    fields = ("sample_id", "mmsi", "segment_id", "ship_type", "ship_class", "quality_tier", "core_eligible", "full_eligible", "interp_ratio_total")
    return samples.select("sample_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("meta"))


def split_summary_json(summary: DataFrame, config: dict[str, float | int | str]) -> str:
    """Rows by split and the configuration they were made with, as one JSON text with sorted keys."""
    splits = {r["split"]: {k: v for k, v in r.asDict(recursive=True).items() if k != "split"} for r in summary.collect()}
    return json.dumps({"config": config, "splits": splits}, sort_keys=True, indent=2, default=str)
