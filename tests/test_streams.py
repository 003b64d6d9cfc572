"""Streams against the batch operators: order of arrival, restarts, late rows, repeated times."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidewake.operators import samples, tracks
from tidewake.plans.config import DEFAULT
from tidewake.streaming import runs
from tidewake.streaming import tracks as streams

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
MESSAGE = "mmsi long, timestamp_utc timestamp, _ingest_order long, lat double, lon double, sog double, shiptype_soft_cap_knots double, note string"
POINT = "mmsi long, segment_id string, timestamp_utc timestamp, lat double, lon double, sog double, cog double, heading double, is_gap_imputed_point boolean, is_grid_interpolated_point boolean, is_interpolated_point boolean, gap_class_before string, ship_type string"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def messages(seed=1):
    """Two vessels with gaps, jumps, nulls and repeated times."""
    chance, rows = random.Random(seed), []
    for mmsi in (1, 2):
        t, lat = 0, 55.0
        for i in range(120):
            t += chance.choice([10, 10, 20, 0, 600, 601])
            lat += chance.choice([0.0005, 0.0005, 0.3 if i % 17 == 0 else 0.0005])
            rows.append((mmsi, at(t), i, lat, 10.0, chance.choice([None, 9.0, 12.0]), chance.choice([None, 35.0]), f"n{i}"))
    return rows


def closing(rows):
    """Far later rows of another vessel: twice, as a stream acts on a watermark one batch late."""
    last = max(r[1] for r in rows)
    return [[(0, last + dt.timedelta(days=d), *rows[0][2:])] for d in (1, 2)]


def facts(frame):
    return sorted((r.mmsi, r.timestamp_utc, r.segment_id, r.segment_break_before, r.dt_to_prev_seconds, None if r.implied_speed_from_prev_knots is None else round(r.implied_speed_from_prev_knots, 6), r.note) for r in frame.where("mmsi > 0").collect())


@pytest.mark.parametrize("cuts, seed", [((), 1), ((0.1, 0.6), 2)])
def test_segments(spark, tmp_path, cuts, seed):
    rows = messages(seed)
    frame = spark.createDataFrame(rows, MESSAGE)
    # each batch in any order; batches by time, but the last seconds of one come with the next
    span = max(r[1] for r in rows) - T0
    number = lambda r: sum(r[1] > T0 + span * c - dt.timedelta(seconds=120 * (r[2] % 2)) for c in cuts)
    parts = [random.Random(k).sample(own, len(own)) for k in range(len(cuts) + 1) if (own := [r for r in rows if number(r) == k])]
    batches = [spark.createDataFrame(p, MESSAGE) for p in [*parts, *closing(rows)]]
    got = runs.fed(spark, batches, streams.segment_stream, str(tmp_path / "rows"), 2)
    assert facts(got) == facts(tracks.segment_tracks(frame))
    ends = runs.fed(spark, batches, streams.segment_ends, str(tmp_path / "ends"), 2).where("mmsi > 0")
    assert sorted(map(tuple, ends.collect())) == sorted(map(tuple, tracks.segment_summary(tracks.segment_tracks(frame)).collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark changes nothing; one within the lateness is taken in its place."""
    row = lambda s, i: (1, at(s), i, 55.0, 10.0, 9.0, 35.0, "x")
    batches = [[row(0, 0), row(2000, 1)], [row(1500, 2), row(2100, 3)], [row(100, 4), row(2200, 5)]]
    frames = [spark.createDataFrame(b, MESSAGE) for b in [*batches, *closing([r for b in batches for r in b])]]
    got = runs.fed(spark, frames, streams.segment_stream, str(tmp_path / "late"), 2).where("mmsi > 0")
    assert sorted((r.timestamp_utc.replace(tzinfo=dt.timezone.utc) - T0).total_seconds() for r in got.collect()) == [0, 1500, 2000, 2100, 2200]


def test_windows(spark, tmp_path):
    limits = replace(DEFAULT, hist_points=4, fut_points=3, window_step=2)
    rows = []
    for mmsi, segment, n in ((1, "a", 6), (1, "b", 7), (2, "c", 30), (2, "d", 9)):
        rows += [(mmsi, segment, at(20 * i + (5000 if segment == "d" else 0)), 55 + i / 1000, 10.0, None if i % 5 == 0 else 9.0, 1.0, None, i % 3 == 0, False, False, "none", "cargo") for i in range(n)]
    shuffled = random.Random(3).sample(rows, len(rows))
    last = max(r[2] for r in rows)
    ends = [[(0, "z", last + dt.timedelta(days=d), *rows[0][3:])] for d in (1, 2)]
    cut = at(200)
    batches = [spark.createDataFrame(b, POINT) for b in ([r for r in shuffled if r[2] <= cut], [r for r in shuffled if r[2] > cut], *ends)]
    got = runs.fed(spark, batches, lambda s: streams.window_stream(s, limits=limits), str(tmp_path / "windows"), 2).where("mmsi > 0")
    want = samples.make_windows(spark.createDataFrame(rows, POINT), limits)
    assert got.columns == want.columns
    text = lambda df: sorted(r.j for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect())
    assert text(got) == text(want) and want.count() == 1 + 12 + 2


def test_state_is_spread_as_shuffles_are(spark, tmp_path, monkeypatch):
    """Unless told otherwise a stream has as many partitions of state as the session has of shuffles, not a fixed few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = [(m, at(10 * i), i, 55.0, 10.0, 9.0, 35.0, "x") for m in (1, 2) for i in range(3)]
        frames = [spark.createDataFrame(b, MESSAGE) for b in (rows, *closing(rows))]
        got = runs.fed(spark, frames, streams.segment_stream, str(tmp_path / "rows")).where("mmsi > 0")
        assert got.count() == 6 and len([p for p in (tmp_path / "rows" / "checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]) == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
