"""As-of joins, histories at wanted times, and the index of way segments, against plain versions."""

import bisect
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import social, spatial
from tidewake.operators.asof import asof_join

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def matches(frame):
    return {r.id: None if r.match is None else ((r.match.t - T0).total_seconds(), r.match.v) for r in frame.collect()}


def plain(left, right, direction, tolerance, later):
    out = {}
    for i, k, s in left:
        own = [(t, v) for q, t, v in right if q == k and k is not None and t is not None and s is not None]
        own = [x for x in own if (x[0] <= s if direction == "backward" else x[0] >= s if direction == "forward" else True) and (tolerance is None or abs(x[0] - s) <= tolerance)]
        out[i] = min(own, key=lambda x: (abs(x[0] - s), -x[0] if later else x[0], (x[1] is not None, x[1] or 0)), default=None)
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("block, tolerance, later", [(86_400.0, None, False), (50.0, None, True), (7.0, 12, False)])
def test_asof(spark, direction, block, tolerance, later):
    chance = random.Random(5)
    key = lambda: chance.choice(["a", "b", "c", None])
    left = [(i, key(), chance.choice([None, *range(0, 300, 2)])) for i in range(120)] + [(900, "only left", 5)]
    right = [(key(), chance.choice([None, *range(0, 300, 3)]), chance.choice([None, 1, 2, 3])) for _ in range(90)] + [("only right", 5, 1), ("b", 30, 7), ("b", 30, 6)]
    time = lambda rows: [tuple(at(x) if j == w and x is not None else x for j, x in enumerate(r)) for r, w in rows]
    a = spark.createDataFrame(time([(r, 2) for r in left]), "id long, k string, t timestamp").withColumn("match_", F.lit(1))
    b = spark.createDataFrame(time([(r, 1) for r in right]), "k string, t timestamp, v long")
    got = asof_join(a, b, ["k"], "t", "t", ["v"], direction, tolerance, later, block)
    assert got.columns == [*a.columns, "match"] and matches(got) == plain(left, right, direction, tolerance, later)


def test_asof_of_one_long_segment(spark):
    """100,000 rows of one key, in blocks; no row meets more than its neighbours."""
    n = 100_000
    points = spark.range(n).select(F.lit(1).cast("long").alias("mmsi"), F.lit("s").alias("segment_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 20).alias("timestamp_utc"), F.col("id").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    targets = spark.range(0, n, 7).select(F.col("id").cast("string").alias("sample_id"), F.lit(1).cast("long").alias("mmsi"), F.lit("s").alias("segment_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 20 + F.col("id") % 20).alias("hist_end_ts"))
    found = social.nearest_in_time(points, targets)
    wrong = found.where(F.col("lat") != F.least(F.lit(n - 1.0), F.col("sample_id").cast("long") + F.when(F.col("sample_id").cast("long") % 20 > 10, 1).otherwise(0)))
    assert found.count() == -(-n // 7) and wrong.count() == 0
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_asof_asks_for_a_direction(spark):
    with pytest.raises(ValueError):
        asof_join(spark.range(1), spark.range(1), ["id"], "id", "id", [], "sideways")


@pytest.mark.parametrize("history", [1, 4, 30])
def test_histories_at_wanted_times(spark, history):
    chance, rows = random.Random(history), []
    for segment, n in (("a", 29), ("b", 30), ("c", 31), ("d", 95)):
        rows += [(1, segment, at(20 * i), "cargo", 55 + i / 100, float(i), None if i % 7 == 0 else 9.0, 1.0, None) for i in range(n)]
    points = spark.createDataFrame(chance.sample(rows, len(rows)), "mmsi long, segment_id string, timestamp_utc timestamp, ship_type string, lat double, lon double, sog double, cog double, heading double")
    wanted = [at(20 * i) for i in (0, 3, 28, 29, 30, 30, 59, 60, 94, 500)]
    got = {(r.segment_id, r.timestamp_utc): (list(r.hist_lon), list(r.hist_sog)) for r in social.snapshots(points, spark.createDataFrame([(t,) for t in wanted], "timestamp_utc timestamp"), history).collect()}
    want = {}
    for segment in "abcd":
        own = [r for r in rows if r[1] == segment]
        for i, r in enumerate(own):
            if r[2] in wanted and i + 1 >= history:
                want[segment, r[2]] = ([x[5] for x in own[i + 1 - history : i + 1]], [x[6] for x in own[i + 1 - history : i + 1]])
    assert got == want


def boxed(anchors, ways, radius):
    """(sample, way, segment) of segments that meet the square about an anchor, by stepping along them."""
    r, out = 6371000.0, set()
    for sample, lat, lon in anchors:
        for way, nodes in ways:
            for k, ((a, b), (c, d)) in enumerate(zip(nodes, nodes[1:])):
                p = [math.radians(x - lon) * math.cos(math.radians(lat)) * r for x in (b, d)], [math.radians(y - lat) * r for y in (a, c)]
                low, high = 0.0, 1.0
                for u, v in p:
                    if u == v:
                        low, high = (low, high) if abs(u) <= radius else (1, 0)
                    else:
                        s, t = sorted(((-radius - u) / (v - u), (radius - u) / (v - u)))
                        low, high = max(low, s), min(high, t)
                if low <= high:
                    out.add((sample, way, k))
    return out


@pytest.mark.parametrize("hot", [2000, 3])
def test_line_index(spark, monkeypatch, hot):
    """Random ways near the pole, the equator and the date line's east, meridians and parallels; divided cells or not."""
    monkeypatch.setattr(spatial, "HOT", hot)
    chance = random.Random(hot)
    places = [(0.0, 0.0), (55.1, 10.2), (-74.9, -120.01), (84.0, 30.0)]
    anchors = [(f"s{i}", y + chance.uniform(-0.1, 0.1), x + chance.uniform(-0.15, 0.15)) for i, (y, x) in enumerate(places * 12)]
    ways = []
    for i, (y, x) in enumerate(places * 15):
        step = chance.choice([0.01, 0.1, 0.5])
        nodes = [(y + chance.uniform(-0.1, 0.1), x + chance.uniform(-0.15, 0.15))]
        for _ in range(chance.randrange(1, 6)):
            nodes.append((nodes[-1][0] + chance.choice([0, 0, chance.uniform(-step, step)]), nodes[-1][1] + chance.choice([0, chance.uniform(-step, step)])))
        ways.append((i, nodes))
    a = spark.createDataFrame(anchors, "sample_id string, anchor_lat double, anchor_lon double")
    w = spark.createDataFrame([(i, "c", "s", n) for i, n in ways], "osm_id long, category string, subtype string, geom array<struct<lat double, lon double>>")
    got = spatial.clipped_segments(a, w, 2048.0).groupBy("sample_id", "osm_id").agg(F.count("*").alias("n")).collect()
    want = {}
    for sample, way, _ in boxed(anchors, ways, 2048.0):
        want[sample, way] = want.get((sample, way), 0) + 1
    assert {(r.sample_id, r.osm_id): r.n for r in got} == want and len(want) > 20


def test_copies_follow_the_cells_crossed(spark):
    """One way of 2,000 segments across 200 cells, and one segment across as many, aren't copied to their box's 40,000 cells."""
    n = 2000
    long_way = [(i * 50 / n, i * 50 / n) for i in range(n + 1)]
    ways = spark.createDataFrame([(1, "c", "s", long_way), (2, "c", "s", [(0.0, 0.0), (50.0, 50.0)])], "osm_id long, category string, subtype string, geom array<struct<lat double, lon double>>")
    copies = {r.osm_id: (r["count"], r.cells) for r in spatial.by_cells(spatial.way_segments(ways), 2048.0, 0.25).groupBy("osm_id").agg(F.count("*").alias("count"), F.count_distinct("_y", "_x").alias("cells")).collect()}
    assert copies[1][0] < 2 * n and 200 <= copies[2][1] == copies[2][0] < 900


def test_ways_are_filed_where_anchors_are(spark):
    """Near a pole a radius spans every meridian: only cells with anchors are listed, and a way beyond them costs nothing."""
    anchors = spark.createDataFrame([("a", 89.93, 10.0), ("b", 55.0, 10.0)], "sample_id string, anchor_lat double, anchor_lon double")
    nodes = [(i, [(95.0 + i, 1.0), (95.1 + i, 1.1)]) for i in range(50)] + [(100, [(89.93, 15.0), (89.931, 15.0)]), (101, [(55.0, 10.001), (55.001, 10.001)])]
    ways = spark.createDataFrame([(i, "c", "s", n) for i, n in nodes], "osm_id long, category string, subtype string, geom array<struct<lat double, lon double>>")
    cells = spark.createDataFrame([(359, 40), (220, 40)], "_y long, _x long")
    filed = spatial.by_cells(spatial.way_segments(ways), 2048.0, 0.25, occupied=cells)
    assert sorted((r.osm_id, r._y, r._x) for r in filed.collect()) == [(100, 359, 40), (101, 220, 40)]
    got = spatial.clipped_segments(anchors, ways, 2048.0).select("sample_id", "osm_id").collect()
    assert sorted(map(tuple, got)) == [("a", 100), ("b", 101)]


def test_states_are_snapshots_without_histories(spark):
    """The same rows, numbers and neighbours, but neither step nor column for what lies before."""
    rows = [(m, f"{m}_a", at(20 * i), "cargo", 55 + m / 200, 10 + i / 1000, 9.0, 90.0, None) for m in range(1, 5) for i in range(28 + m)]
    points = spark.createDataFrame(rows, "mmsi long, segment_id string, timestamp_utc timestamp, ship_type string, lat double, lon double, sog double, cog double, heading double")
    targets = spark.createDataFrame([(f"t{m}_{i}", m, f"{m}_a", at(20 * i)) for m in (2, 3, 4) for i in (28, 29, 30)], "sample_id string, mmsi long, segment_id string, hist_end_ts timestamp")
    times = targets.select(F.col("hist_end_ts").alias("timestamp_utc"))
    whole, short = social.snapshots(points, times), social.states(points, times)
    own = [c for c in whole.columns if not c.startswith("hist_")]
    assert short.columns == own and sorted(short.collect()) == sorted(whole.select(*own).collect()) and short.count() == 5
    assert "collect_list" not in short._jdf.queryExecution().executedPlan().toString()
    full, met = social.social_features(targets, whole), social.social_features(targets, short)
    assert [c for c in full.columns if "_hist_" not in c or c.startswith("target_")] == [c for c in met.columns if c not in ("neighbor_hist_sog",)]
    text = lambda df: sorted(r.j for r in df.select(F.to_json(F.struct(*met.columns)).alias("j")).collect())
    assert text(full) == text(met) and met.where("neighbor_count_used > 0").count() > 3
