"""Small hand-made cases of the trajectory operators."""

import datetime as dt
import hashlib
import json
import math
import statistics
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewake.functions import arrays, geo, text
from tidewake.operators import ingest, samples, selection, social, spatial, tracks
from tidewake.plans import stages
from tidewake.sources import readers, writers
from tidewake.streaming import messages

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
HEADER = ["# Timestamp", "MMSI", "Latitude", "Longitude", "SOG", "COG", "Heading", "Navigational status", "Ship type", "Length", "Width", "Draught", "IMO"]
ROW = ["01/09/2025 00:00:05", "219001000", "55.1", "10.2", "12.3", "45.0", "44", "Under way using engine", "Cargo", "120", "20", "6.1", "9111111"]


def raw(spark, *changes):
    rows = []
    for i, c in enumerate(changes):
        r = dict(zip(HEADER, ROW)) | c
        rows.append((*[r[h] for h in HEADER], i))
    return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in HEADER) + ", _ingest_order long")


def test_standardize_and_filter(spark):
    df = raw(spark, {}, {"SOG": "102.3"}, {"COG": "360.0", "Heading": "511"}, {"Latitude": "91"}, {"SOG": "-1"}, {"# Timestamp": "xx"}, {"Ship type": "Undefined"}, {"Heading": "400"})
    std = {r["_ingest_order"]: r for r in ingest.standardize(df).collect()}
    assert std[0].nav_status == "under way using engine" and std[0].ship_type == "cargo" and std[0].timestamp_utc == dt.datetime(2025, 9, 1, 0, 0, 5)
    assert std[1].sog is None and std[2].cog is None and std[2].heading is None and std[3].lat is None and std[5].timestamp_utc is None and std[6].ship_type is None
    kept = {r["_ingest_order"]: r for r in ingest.basic_filter(ingest.standardize(df)).collect()}
    assert set(kept) == {0, 1, 2, 6, 7} and kept[7].heading is None


def test_each_text_is_parsed_once(spark):
    df = ingest.speed_filter(ingest.dedup_messages(ingest.basic_filter(ingest.standardize(raw(spark, {}, {"Draught": " ", "IMO": "", "Length": "NaN", "Width": "None"})))))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(Latitude#") == 2  # the text is looked at, then cast
    assert plan.count("trim(SOG#") == 2 and plan.count("trim(# Timestamp#") == 1
    row = ingest.standardize(raw(spark, {"Draught": " ", "IMO": "", "Length": "NaN", "Width": "None"})).first()
    assert (row.draught, row.imo, row.length, row.width) == (None, None, None, None)


def test_stages_are_compiled(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), stages.short_methods(spark):
        assert int(spark.conf.get(name)) == 8000
        raise ValueError
    assert spark.conf.get(name) == before


def test_kinematics(spark):
    df = spark.createDataFrame([("a", [0.0, 1.0, 3.0, 7.0], [0.0, -1.0, None, 4.0], [1.0], [2.0]), ("b", [], [], [], [])], "sample_id string, hist_x array<double>, hist_y array<double>, fut_x array<double>, fut_y array<double>")
    got = {r.sample_id: r for r in samples.kinematics(df).collect()}
    assert got["a"].hist == [[0, 0, 0, 0, 0, 0], [1, -1, 1, -1, 1, -1], [3, None, 2, None, 1, None], [7, 4, 4, None, 2, None]] and got["a"].fut == [[1, 2]] and got["b"].hist == []
    plan = samples.kinematics(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 2  # none within another, which would be made anew for each element


def test_array_statistics(spark):
    df = spark.createDataFrame([([4.0, 1.0, 3.0],), ([2.0, None, 1.0],), ([5.0],), ([],)], "c array<double>")
    spread = df.select(arrays.pstdev(F.col("c")).alias("s"))
    assert [r[0] for r in spread.collect()] == [pytest.approx(statistics.pstdev([4, 1, 3])), None, 0.0, 0.0]
    assert [r[0] for r in df.select(arrays.median(F.col("c"))).collect()] == [3.0, 2.0, 5.0, 0.0]
    assert spread._jdf.queryExecution().analyzed().toString().count("aggregate(") == 2  # the mean isn't taken for each element
    x, y = F.array(F.lit(3.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(5.0))
    assert [r[0] for r in df.limit(1).select(selection.steps(x, y, True)[0]).collect()] == [[5.0, 1.0]]


def test_hashes_are_shipped(spark):
    package = sys.modules["tidewake"]
    if "tidewake" in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.unregister_pickle_by_value(package)
    selection.with_stable_hashes(spark.createDataFrame([("a",)], "sample_id string"))
    assert "tidewake" in cloudpickle.list_registry_pickle_by_value()


def test_codes(spark):
    df = spark.createDataFrame([("70",), ("89",), ("65",), ("30",), ("52",), ("33",), ("36",), ("99",), ("70.0",), (" ",), (None,)], "c string")
    assert [r[0] for r in df.select(text.ship_type_of_code(F.col("c"))).collect()] == ["cargo", "tanker", "passenger", "fishing", "tug", "service", "unknown", "unknown", "70.0", None, None]
    df = spark.createDataFrame([("1",), ("5",), ("9",), ("drifting",)], "c string")
    assert [r[0] for r in df.select(text.nav_status_of_code(F.col("c"))).collect()] == ["at anchor", "moored", "undefined", "drifting"]


def test_dedup_policies(spark):
    std = ingest.standardize(raw(spark, {}, {"COG": "", "Width": ""}, {"COG": ""}))
    assert ingest.dedup_messages(std).first()["_ingest_order"] == 1
    assert ingest.dedup_messages(std, keep="fewest_missing").first()["_ingest_order"] == 0
    assert ingest.dedup_messages(ingest.standardize(raw(spark, {}, {})), exact=True).count() == 1


def test_speed_caps(spark):
    df = ingest.standardize(raw(spark, {"SOG": "36"}, {"SOG": "56", "Ship type": "yacht"}, {"SOG": "26", "Ship type": "Fishing"}, {"SOG": ""}, {"SOG": "45", "Ship type": "HSC Ferry"}))
    assert sorted(r["_ingest_order"] for r in ingest.speed_filter(df).collect()) == [3, 4]


def track(spark, rows, **over):
    """rows: (seconds, lat, lon)"""
    full = [(1, T0 + dt.timedelta(seconds=s), float(a), float(o), over.get("sog", 10.0), c, None, over.get("nav", "under way"), "cargo", "cargo", 35.0) for s, a, o, c in [(*r, None)[:4] for r in rows]]
    return spark.createDataFrame(full, "mmsi long, timestamp_utc timestamp, lat double, lon double, sog double, cog double, heading double, nav_status string, ship_type string, ship_class string, shiptype_soft_cap_knots double")


def test_segments_break_on_time_then_speed(spark):
    df = track(spark, [(0, 55, 10), (600, 55.01, 10), (1201, 55.02, 10), (1221, 56, 10), (2000, 57, 10)])
    got = [(r.segment_break_before, r.segment_id) for r in tracks.segment_tracks(df).orderBy("timestamp_utc").collect()]
    assert got == [("start", "1_000000"), ("continue", "1_000000"), ("time_gap", "1_000001"), ("implied_speed", "1_000002"), ("time_gap", "1_000003")]


def test_labels_runs_and_displacement(spark):
    still = tracks.segment_tracks(track(spark, [(s, 55, 10) for s in range(0, 1300, 100)], sog=0.2, nav="At anchor"))
    r = tracks.segment_labels(still).first()
    assert r.longest_anchor_or_moored_seconds == 1200 and r.longest_low_speed_seconds == 1200 and r.has_low_displacement_20min_window and r.exclude_from_underway_only
    moving = tracks.segment_tracks(track(spark, [(s, 55 + s * 5e-5, 10) for s in range(0, 1300, 100)]))
    r = tracks.segment_labels(moving).first()
    assert r.longest_anchor_or_moored_seconds == 0 and not r.exclude_from_underway_only
    assert tracks.underway_only(still, tracks.segment_labels(still)).count() == 0


@pytest.mark.parametrize("gap,inserted,kind", [(20, 0, "none"), (21, 1, "short"), (40, 1, "short"), (120, 5, "short"), (121, 0, "medium"), (300, 0, "medium"), (301, 0, "long")])
def test_gap_fill(spark, gap, inserted, kind):
    seg = tracks.segment_tracks(track(spark, [(0, 55, 10), (gap, 55.001, 10)]))
    rows = tracks.fill_short_gaps(seg).orderBy("timestamp_utc").collect()
    assert sum(r.is_interpolated_obs for r in rows) == inserted and rows[-1].gap_class_before == kind


def test_gap_fill_values_wrap(spark):
    seg = tracks.segment_tracks(track(spark, [(0, 55, 10, 350.0), (40, 55.002, 10, 10.0)]))
    mid = tracks.fill_short_gaps(seg).where("is_interpolated_obs").first()
    assert mid.lat == pytest.approx(55.001) and min(mid.cog, 360 - mid.cog) == pytest.approx(0, abs=1e-9) and mid.heading is None and mid.segment_break_before == "start"


def test_resample_grid_and_numbering(spark):
    rows = [(3, 55, 10), (23, 55.001, 10), (43, 55.002, 10), (400, 55.003, 10), (600, 55.004, 10), (620, 55.005, 10)]
    got = tracks.resample(tracks.fill_short_gaps(tracks.segment_tracks(track(spark, rows)))).orderBy("timestamp_utc").collect()
    assert [(int((r.timestamp_utc.replace(tzinfo=dt.timezone.utc) - T0).total_seconds()), r.segment_id[-3:]) for r in got] == [(20, "r00"), (40, "r00"), (600, "r01"), (620, "r01")]
    assert [r.is_grid_interpolated_point for r in got] == [True, True, False, False]


def test_anomaly_spike_and_short_segments(spark):
    rows = [(20 * i, 55 + 0.0015 * i + (0.006 if i == 5 else 0), 10) for i in range(11)]
    seg = track(spark, rows).withColumn("segment_id", F.lit("a"))
    out = tracks.reject_anomalies(seg)
    assert out.count() == 10 and {r.segment_id for r in out.select("segment_id").distinct().collect()} == {"a_c00"}
    two = track(spark, rows[:2]).withColumn("segment_id", F.lit("b"))
    assert tracks.reject_anomalies(two).first().segment_id == "b"


@pytest.mark.parametrize("n,windows", [(59, 0), (60, 1), (64, 1), (65, 2), (80, 5)])
def test_window_counts(spark, n, windows):
    df = track(spark, [(20 * i, 55 + 0.0003 * i, 10) for i in range(n)]).withColumns({"segment_id": F.lit("a"), "gap_class_before": F.lit("none"), "is_interpolated_point": F.lit(False), "is_gap_imputed_point": F.lit(False), "is_grid_interpolated_point": F.lit(False)})
    w = samples.make_windows(df)
    assert w.count() == windows
    if windows:
        s = samples.label_samples(w).orderBy("sample_id").first()
        assert s.hist_x[-1] == 0 and s.hist_y[-1] == 0 and len(s.fut_x) == 30 and s.quality_tier == "core" and s.sample_id == "a_00000"


def test_split_matches_md5(spark):
    ids = [219001000 + i for i in range(200)]
    want = {i: {0: "val", 1: "test"}.get(int(hashlib.md5(str(i).encode()).hexdigest(), 16) % 10, "train") for i in ids}
    got = {r.m: r.s for r in spark.createDataFrame([(i,) for i in ids], "m long").select("m", text.split_of(F.col("m")).alias("s")).collect()}
    assert got == want


def test_quotas_and_choice(spark):
    counts = spark.createDataFrame([("cargo_tanker", "10_15", "mid", 100), ("cargo_tanker", "5_10", "low", 3), ("passenger_ferry", "gt20", "high", 50)], "ship_group string, speed_bin string, motion_bin string, n long")
    for q in (selection.quota_sqrt(counts, 40), selection.quota_weighted(counts, 40)):
        rows = q.collect()
        assert sum(r.quota for r in rows) <= 40 and all(r.quota <= r.n for r in rows)
    import pandas as pd

    pool = pd.DataFrame([dict(split="train", sample_id=f"s{i:03d}", mmsi=i % 2, segment_id=f"g{i % 4}", sample_step=i * 5, ship_group="a", speed_bin="b", motion_bin="c", place=i, quota=5) for i in range(60)])
    out = pool[pool.sample_id.isin(selection.choose(pool, 20, per_vessel=6, per_segment=3, step_gap=20)[0].sample_id)]
    assert out.groupby("mmsi").size().max() <= 6 and out.groupby("segment_id").size().max() <= 3
    for _, g in out.groupby("segment_id"):
        assert min(abs(a - b) for i, a in enumerate(g.sample_step) for b in list(g.sample_step)[:i]) >= 20


def test_clean_choice_takes_all_candidates(spark, monkeypatch):
    from tidewake.queries import selection as queries

    stratum = ("train", "cargo_tanker", "10_15", "mid")
    rows = [(*stratum, 1, "g1", i, f"a{i:03d}", 90.0 - i / 100, True, None) for i in range(200)]  # one vessel's segment holds the best rows
    rows += [(*stratum, 100 + i, f"h{i}", 0, f"b{i:03d}", 50.0, True, None) for i in range(30)]
    rows += [(*stratum, 200 + i, f"r{i}", 0, f"c{i:03d}", 95.0, True, "quality_score") for i in range(30)]
    names = "split string, ship_group string, speed_bin string, motion_bin string, mmsi long, segment_id string, sample_step int, sample_id string, quality_score double, core_eligible boolean, reject_reason string"
    rows = [r[:9] + (1.0,) + r[9:] for r in rows]
    names = names.replace("core_eligible", "difficulty_score double, core_eligible")
    monkeypatch.setattr(queries, "_candidates", lambda spark, d: spark.createDataFrame(rows, names))
    got = sorted(r.sample_id for r in queries.select_clean(spark, "").collect())
    assert got[:3] == ["a000", "a020", "a040"] and len(got) == 24 and all(x.startswith("b") for x in got[3:])  # ties go by hash


def _plain_quality_first(rows, quotas, target, per_vessel, per_segment, gap):
    """The same choice over all rows, one by one; rows: (stratum, mmsi, segment, step, id) in order."""
    vessels, segments, taken = {}, {}, []

    def take(r):
        _, v, s, step, i = r
        if vessels.get(v, 0) < per_vessel and len(segments.get(s, [])) < per_segment and all(abs(step - x) >= gap for x in segments.get(s, [])):
            vessels[v] = vessels.get(v, 0) + 1
            segments.setdefault(s, []).append(step)
            taken.append(i)
            return True
        return False

    for stratum in sorted(quotas):
        n = 0
        for r in rows:
            if r[0] == stratum and n < quotas[stratum] and take(r):
                n += 1
    for r in rows:
        if len(taken) < target and r[4] not in taken:
            take(r)
    return taken[:target]


def test_quality_first_reads_on_where_heads_run_out(spark):
    import random

    chance = random.Random(9)
    rows = [(chance.choice("abc"), 1 if i < 300 else 2 + i % 40, f"g{1 if i < 300 else i % 60}", i % 97, f"s{i:04d}", float(i)) for i in range(600)]
    df = spark.createDataFrame([("train", "cargo_tanker", "10_15", m, v, s, step, i, q) for m, v, s, step, i, q in rows], "split string, ship_group string, speed_bin string, motion_bin string, mmsi long, segment_id string, sample_step int, sample_id string, score double")
    counts = df.groupBy("ship_group", "speed_bin", "motion_bin").agg(F.count("*").alias("n"))
    quotas = {r.motion_bin: r.quota for r in selection.quota_weighted(counts, 40).collect()}
    got = [r.sample_id for r in selection.select_quality_first(df, [F.col("score")], 40, per_vessel=4, per_segment=2, step_gap=20, head=1).collect()]
    assert sorted(got) == sorted(_plain_quality_first([r[:5] for r in rows], quotas, 40, 4, 2, 20)) and len(got) == 40


def test_nested_choice_and_hashes(spark):
    import hashlib

    import pandas as pd

    pool = pd.DataFrame([dict(split="train", sample_id=f"s{i:03d}", mmsi=i, segment_id=f"g{i}", sample_step=-1, ship_group="a", speed_bin="b", motion_bin="c" if i < 30 else "d", place=i, quota=6, turn_bin="sharp" if i % 10 == 9 else "straight") for i in range(60)])
    out = pool[pool.sample_id.isin(selection.choose_nested(pool, 12, 25, 8, 10).sample_id)]
    assert len(out) == 12 and (out.groupby("motion_bin").size() == 6).all() and (out[out.turn_bin == "sharp"].groupby("motion_bin").size() == selection.shares({"sharp": 3, "straight": 27}, 6)["sharp"]).all()
    got = selection.with_stable_hashes(spark.createDataFrame([(f"x{i}",) for i in range(50)], "sample_id string")).collect()
    assert all(int(r.hash_blake) == int.from_bytes(hashlib.blake2b(r.sample_id.encode(), digest_size=8).digest(), "big") for r in got)
    assert max(int(r.hash_frame) for r in got) > 2**63 and min(int(r.hash_frame) for r in got) >= 0


def test_clip_stays_inside(spark):
    cases = [(-10.0, 0.0, 10.0, 0.0), (0.0, 0.0, 0.0, 0.0), (9.0, 9.0, 20.0, 20.0), (6.0, 0.0, 6.0, 5.0), (-6.0, 4.0, -4.0, 6.0), (1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(cases, "a double, b double, c double, d double")
    enter, leave = geo.clip_square(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 5.0)
    got = [(r[0], r[1]) if r[0] <= r[1] else None for r in df.select(enter, leave).collect()]
    assert got[0] == (0.25, 0.75) and got[1] == (0.0, 1.0) and got[2] is None and got[3] is None and got[4] == (0.5, 0.5) and got[5] == (0.0, 1.0)


def test_regions_join_diagonally(spark):
    tiles = spark.createDataFrame([("+055.000_+0010.000",), ("+055.250_+0010.250",), ("+055.500_+0011.000",)], "tile_id string")
    got = {r.tile_id: r.region_cluster for r in spatial.region_clusters(tiles).collect()}
    assert got == {"+055.000_+0010.000": "region_000", "+055.250_+0010.250": "region_000", "+055.500_+0011.000": "region_001"}


def test_sources_and_sinks(spark, tmp_path):
    import gzip

    lines = [",".join(HEADER), ",".join(ROW)]
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in/a.csv.gz", "wt") as f:
        f.write("\n".join(lines))
    got = readers.read_raw(spark, str(tmp_path / "in"))
    assert got.first().source_file == "a.csv.gz" and ingest.standardize(got).first().mmsi == 219001000
    with zipfile.ZipFile(tmp_path / "in/b.zip", "w") as z:
        z.writestr("b.csv", "\n".join(lines))
    assert readers.read_raw_zip(spark, str(tmp_path / "in"), HEADER).first().source_file == "b.zip"
    assert readers.output_name("x.csv.gz") == "x"
    df = spark.createDataFrame([(65, [1.0, None])], "mmsi long, a array<double>")
    writers.write_partitions(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first().part == 1
    writers.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().a == "[1.0,null]"
    assert json.loads(writers.summary_json(df.agg(F.count("*").alias("n")))) == {"n": 1}


def test_files_of_different_headers(spark, tmp_path):
    turned = HEADER[1:] + HEADER[:1]
    second = ["mmsi", "base_date_time", "latitude", "longitude", "sog", "cog", "heading", "status", "vessel_type", "length", "width", "draft", "imo"]
    (tmp_path / "a.csv").write_text("\n".join([",".join(HEADER), ",".join(ROW)]))
    (tmp_path / "b.csv").write_text("\n".join([",".join(turned), ",".join(ROW[1:] + ROW[:1])]))
    got = {r.mmsi: r for r in ingest.standardize(readers.read_raw(spark, str(tmp_path))).collect()}
    assert len(got) == 1 and got[219001000].lat == 55.1 and readers.read_raw(spark, str(tmp_path)).count() == 2
    (tmp_path / "n").mkdir()
    (tmp_path / "n/c.csv").write_text("\n".join([",".join(second), "219001001,2025-09-01T00:00:05,55.1,10.2,12.3,45.0,511,1,75,120,20,6.1,IMO9"]))
    r = ingest.standardize(readers.read_raw(spark, str(tmp_path / "n"))).first()
    assert (r.mmsi, r.lat, r.heading, r.nav_status, r.ship_type, r.imo) == (219001001, 55.1, None, "at anchor", "cargo", None) and r.timestamp_utc == dt.datetime(2025, 9, 1, 0, 0, 5)
    assert readers.read_raw(spark, str(tmp_path), glob="*.none").count() == 0


def test_stage_files(spark, tmp_path):
    import gzip

    for name in ("part-000", "underway_only", "sub/messages", "sub/other", "sub/part-001", "sub/segment_labels"):
        (tmp_path / f"{name}.csv.gz").parent.mkdir(exist_ok=True)
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt") as f:
            f.write(f"a\n{name}")
    schema = spark.createDataFrame([], "a string").schema
    assert {r.a for r in readers.read_stage_csv(spark, str(tmp_path), schema).collect()} == {"part-000", "sub/messages", "sub/part-001"}
    assert readers.read_stage_csv(spark, str(tmp_path), schema, primary=False).count() == 6


def test_selected_and_summaries(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i}", i) for i in range(5)], "sample_id string, n int")
    writers.write_selected(rows, rows.where("n > 2"), str(tmp_path / "x"))
    assert [r.sample_id for r in spark.read.option("header", True).csv(str(tmp_path / "x")).orderBy("sample_id").collect()] == ["s3", "s4"]
    out = json.loads(writers.split_summary_json(spark.createDataFrame([("train", 3), ("val", 1)], "split string, n int"), {"radius_m": 5.0}))
    assert out == {"config": {"radius_m": 5.0}, "splits": {"train": {"n": 3}, "val": {"n": 1}}}


@pytest.mark.parametrize("n", [1, 2, 999])
def test_numeric_summary(spark, n):
    values = [(i * 37 % 101 - 40) / 8 for i in range(n)]
    keyed = [(None if i % 3 == 0 else "a", v) for i, v in enumerate(values)]
    df = spark.createDataFrame([*keyed, ("a", None)], "k string, v double")

    def want(own):
        own = sorted(own)
        return (len(own), *[round(x, 4) for x in (math.fsum(own) / len(own), statistics.median(own), own[round(0.9 * (len(own) - 1))], own[0], own[-1])])

    assert [tuple(r) for r in selection.numeric_summary(df, "v").collect()] == [pytest.approx(want(values), abs=1e-4)]
    got = {r.k: tuple(r)[1:] for r in selection.numeric_summary(df, "v", "k").collect()}
    assert got == {k: pytest.approx(want([v for j, v in keyed if j == k]), abs=1e-4) for k in {j for j, _ in keyed}}


def test_numeric_summary_of_nothing(spark):
    empty = spark.createDataFrame([("a", None)], "k string, v double")
    assert selection.numeric_summary(empty, "v", "k").count() == 0
    assert [tuple(r) for r in selection.numeric_summary(empty, "v").collect()] == [(None,) * 6]


def test_nearby_tracks(spark):
    """The last points of near segments only, fewer where a segment is young."""
    time = lambda k: T0 + dt.timedelta(seconds=20 * k)
    lanes = {"a": (1, 55.0, 0), "b": (2, 55.001, 0), "c": (3, 55.001, 27), "d": (4, 55.5, 0)}
    points = spark.createDataFrame([(m, s, time(k), lat, 10.0 + k * 1e-4) for s, (m, lat, first) in lanes.items() for k in range(first, 40)], "mmsi long, segment_id string, timestamp_utc timestamp, lat double, lon double")
    targets = spark.createDataFrame([("x", 1, "a", time(30))], "sample_id string, mmsi long, segment_id string, hist_end_ts timestamp")
    snaps = points.where(F.col("timestamp_utc") == F.lit(time(30)))
    got = sorted((r.segment_id, r.back, r.timestamp_utc) for r in social.nearby_tracks(targets, snaps, points).collect())
    want = [("b", k + 1, time(30 - k)) for k in range(15)] + [("c", k + 1, time(30 - k)) for k in range(4)]
    assert [(s, b) for s, b, _ in got] == [(s, b) for s, b, _ in want] and [t.timestamp() for *_, t in got] == [t.timestamp() for *_, t in want]


def test_stream_sessions(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(seconds=s)) for s in (0, 0, 60, 2000, 2060, 9000)]
    spark.createDataFrame(rows, "mmsi long, timestamp_utc timestamp").coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("mmsi long, timestamp_utc timestamp").parquet(str(tmp_path / "s"))
    q = messages.sessions(messages.dedup_stream(stream)).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.start_time.timestamp(), r.num_points) for r in spark.sql("select * from sessions").collect())
    assert [n for _, n in got] == [2, 2]


def test_geo_values(spark):
    r = spark.range(1).select(geo.haversine_m(F.lit(55.0), F.lit(10.0), F.lit(56.0), F.lit(10.0)), geo.wrap_degrees(F.lit(190.0)), geo.turn_degrees(F.lit(350.0), F.lit(10.0)), *geo.approach(F.lit(100.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0)), *geo.approach(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0))).first()
    assert r[0] == pytest.approx(math.pi * 6371000 / 180) and r[1] == -170 and r[2] == 20 and r[3] == pytest.approx(0) and r[4] == 100 and r[5] is None and r[6] is None


def test_queries_without_a_session():
    """Names of queries can be listed before there is a session."""
    import subprocess
    import sys
    from pathlib import Path

    ran = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 100)"], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert ran.stdout.strip().endswith("True"), ran.stderr[-1000:]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stages_keep_their_partitioning(spark, tmp_path_factory):
    """Windows over stage tables in buckets by vessel need no exchange, nor does the next stage."""
    from tidewake.plans import stages

    rows = [(m, T0 + dt.timedelta(seconds=20 * i), 55 + i / 2000, 10.0 + m, 9.0, 0.0, 0.0, "under way", "cargo", None, i) for m in range(6) for i in range(120)]
    clean = spark.createDataFrame(rows, "mmsi long, timestamp_utc timestamp, lat double, lon double, sog double, cog double, heading double, nav_status string, ship_type string, shiptype_soft_cap_knots double, _ingest_order long")
    source = str(tmp_path_factory.mktemp("kept"))
    kept = lambda name, df: stages.stage(spark, name, source, lambda: df, "mmsi")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    steps = (tracks.segment_tracks, tracks.underway, tracks.fill_short_gaps, tracks.resample, tracks.reject_anomalies, tracks.long_segments, samples.make_windows)
    df = kept("clean", tracks.co_located(clean))
    assert exchanges(tracks.segment_labels(tracks.segment_tracks(df))) == 0
    for step in steps:
        assert exchanges(step(df)) == 0, step.__name__
        df = kept(step.__name__, step(df))
    assert df.count() == 6 * 13


def test_underway_is_underway_only(spark):
    """Rows of segments that labels don't exclude, by windows or by a join."""
    import random

    chance, rows = random.Random(9), []
    for m in range(12):
        slow = chance.choice([0.1, 9.0, 9.0])
        rows += [(m, T0 + dt.timedelta(seconds=20 * i), 55 + i * slow / 20000, 10.0, chance.choice([slow, slow, None]), chance.choice(["at anchor", "under way", "under way"]) if m % 3 else "under way", None, i) for i in range(90)]
    df = tracks.segment_tracks(spark.createDataFrame(rows, "mmsi long, timestamp_utc timestamp, lat double, lon double, sog double, nav_status string, shiptype_soft_cap_knots double, _ingest_order long"))
    a, b = tracks.underway(df), tracks.underway_only(df, tracks.segment_labels(df))
    assert a.columns == df.columns and sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())) and 0 < a.count() < df.count()


def test_last_anchor_counts(spark):
    points = spark.createDataFrame([(1, "a", T0, 1.0, 2.0, 5), (1, "a", T0, 3.0, 0.0, 9), (1, "a", T0, 2.0, 9.0, 7)], "mmsi long, segment_id string, timestamp_utc timestamp, lat double, lon double, line int")
    wanted = spark.createDataFrame([("s", 1, "a", T0)], "sample_id string, mmsi long, segment_id string, hist_end_ts timestamp")
    assert spatial.recover_anchors(wanted, points, order=("line",)).first()[4:6] == (3.0, 0.0)
    with pytest.raises(Exception, match="no anchor"):
        spatial.recover_anchors(wanted.withColumn("segment_id", F.lit("b")), points).collect()


def test_configuration(tmp_path):
    from tidewake.plans import config

    given = "thresholds:\n  segmentation_gap_seconds: 900\n  core_interp_ratio_hist_max: 0.5\nship_type_caps:\n  tug: 15\nother: [1, 2]\n"
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(given)
    (tmp_path / "c.json").write_text('{"thresholds": {"segmentation_gap_seconds": 900, "core_interp_ratio_hist_max": 0.5}, "ship_type_caps": {"tug": 15}}')
    a, b = config.load_thresholds(str(tmp_path / "c.yaml")), config.load_thresholds(str(tmp_path / "c.json"))
    assert a == b and a.segment_gap_s == 900.0 and a.core_interp_hist == 0.5 and a.caps["tug"] == 15.0 and a.caps["cargo"] == 35.0 and a.hist_points == 30
    (tmp_path / "empty.yaml").write_text("")
    assert config.load_thresholds(str(tmp_path / "empty.yaml")) == config.DEFAULT
    with pytest.raises(KeyError):
        config.thresholds_of({"thresholds": {"segmentation_gap": 1}})
    assert set(config.NAMES.values()) <= set(config.Thresholds.__dataclass_fields__)


def test_spaced_json(spark):
    from tidewake.functions import text

    df = spark.sql("""select array(1.5D, null, -2.0D) as a, array('x, y', 'say "z"', null) as b, array(array(1, 2), array()) as c, cast(array() as array<int>) as d, cast(null as array<int>) as e""")
    assert tuple(df.select(*[text.spaced_json(F.col(c)) for c in "abcde"]).first()) == ("[1.5, null, -2.0]", '["x, y", "say \\"z\\"", null]', "[[1,2], []]", "[]", None)
