"""Floods and distance maps against a plain queue and all pairs, and what is kept of version 2's rasters."""

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.functions import grids
from tidewake.operators import spatial


def plain_flood(barrier):
    n = len(barrier)
    c = n // 2
    start = next(((c + y, c + x) for _, y, x in sorted((max(abs(y), abs(x)), y, x) for y in range(-4, 5) for x in range(-4, 5)) if 0 <= c + y < n and 0 <= c + x < n and not barrier[c + y, c + x]), None)
    water = np.zeros_like(barrier)
    if start:
        water[start] = True
    todo = deque([start] if start else [])
    while todo:
        y, x = todo.popleft()
        for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= a < n and 0 <= b < n and not barrier[a, b] and not water[a, b]:
                water[a, b] = True
                todo.append((a, b))
    return water


@pytest.mark.parametrize("n, share", [(1, 0.5), (7, 1.0), (16, 0.4), (33, 0.5), (128, 0.41), (128, 0.0)])
def test_flood(n, share):
    barrier = np.random.default_rng(n).random((8, n, n)) < share
    assert (grids.flooded(barrier) == np.stack([plain_flood(b) for b in barrier])).all()


def test_flood_of_mazes():
    """A corridor that winds through all rows, one that spirals inwards, and the first without its last gap."""
    n = 128
    winding = np.ones((n, n), bool)
    winding[::2] = False
    for r in range(1, n, 2):
        winding[r, n - 1 if r // 2 % 2 else 0] = False
    spiral, y, x, dy, dx = np.ones((n, n), bool), 0, 0, 0, 1
    free = lambda a, b: 0 <= a < n and 0 <= b < n and spiral[a, b]
    for _ in range(n * n):
        spiral[y, x] = False
        if not (free(y + dy, x + dx) and (not (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n) or spiral[y + 2 * dy, x + 2 * dx])):
            dy, dx = dx, -dy
            if not (free(y + dy, x + dx) and (not (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n) or spiral[y + 2 * dy, x + 2 * dx])):
                break
        y, x = y + dy, x + dx
    shut = winding.copy()
    shut[n // 2 + 1] = True
    mazes = np.stack([winding, spiral, shut])
    water = grids.flooded(mazes)
    assert (water == np.stack([plain_flood(b) for b in mazes])).all() and (water[0] == ~winding).all() and not water[2, n // 2 + 2 :].any()


@pytest.mark.parametrize("n, share", [(1, 1.0), (5, 0.1), (40, 0.01), (40, 0.3), (64, 0.0005)])
def test_distances(n, share):
    mask = np.random.default_rng(n).random((6, n, n)) < share
    mask[0] = False
    y, x = np.mgrid[0:n, 0:n]
    want = np.stack([np.min([(y - a) ** 2 + (x - b) ** 2 for a, b in np.argwhere(m)], axis=0) if m.any() else np.full((n, n), np.inf) for m in mask])
    assert (grids.squared_distances(mask) == want).all()
    metres = grids.distances_m(mask, 8.0)
    assert (metres[0] == 8.0).all() and metres[1:] == pytest.approx(np.where(np.isfinite(want), np.sqrt(want) * 16 / n, 8.0)[1:], rel=1e-6)


def test_rasters_of_version_2(spark):
    """A wall beside the anchor: masks and distances come back cell by cell."""
    size, lat, lon = 32, 55.0, 10.0
    anchors = spark.createDataFrame([("a", lat, lon), ("b", lat, lon + 5)], "sample_id string, anchor_lat double, anchor_lon double").withColumn("tile_id", spatial.tile_id(F.col("anchor_lat"), F.col("anchor_lon")))
    east = float(lon + np.degrees(1000.0 / (6371000.0 * np.cos(np.radians(lat)))))
    ways = spark.createDataFrame([(1, "natural_boundary", "coastline", [(lat - 0.1, east), (lat + 0.1, east)])], "osm_id long, category string, subtype string, geom array<struct<lat double, lon double>>")
    env = spatial.environment_v2(anchors, ways, 5000.0, size, 32.0).cache()
    rows = {(r.sample_id, r.gy, r["mask"]): r.cells for r in spatial.mask_rows(env, size).collect()}
    wall = size // 2 + 3  # 1,000 m of 312.5 m a cell
    assert all(rows["a", y, "natural"] == "0" * wall + "1" + "0" * (size - wall - 1) for y in range(size))
    assert rows["a", 5, "water"] == "1" * wall + "0" * (size - wall) and rows["a", 5, "navigable"] == "1" * (wall - 1) + "0" * (size - wall + 1)
    assert ("b", 0, "barrier") not in rows and rows["b", 0, "water"] == "1" * size
    at = {(r.sample_id, r.gy, r.gx): r for r in spatial.distances_at(env, 4, size).collect()}
    assert at["a", 2, 2].shore_m == pytest.approx((wall - 2) * 312.5) and at["a", 2, 30].shore_m == pytest.approx((wall - 30) * 312.5) and at["b", 2, 2].shore_m == 5000.0
    assert at["a", 2, 2].navigable_m == pytest.approx((wall - 3) * 312.5) and at["a", 2, 30].navigable_m == 0
    one = env.where("sample_id = 'a'").first()
    assert one.water_ratio == pytest.approx(wall / size) and one.scene_type == "nearshore" and one.nearest_shore_dist_m == pytest.approx(1000, abs=1)


def test_rasters_are_made_after_all_joins(spark):
    """Wide rows aren't shuffled: no exchange above the step that makes them; distances and masks asked for come without kept maps."""
    size, chance = 32, np.random.default_rng(4)
    anchors = spark.createDataFrame([(f"s{i}", 55.0 + i / 50, 10.0, [True, False]) for i in range(70)], "sample_id string, anchor_lat double, anchor_lon double, flags array<boolean>").withColumn("tile_id", spatial.tile_id(F.col("anchor_lat"), F.col("anchor_lon")))
    nodes = [[(55.0 + k / 100 + chance.uniform(-0.02, 0.02), 10.0 + chance.uniform(-0.05, 0.05)) for _ in range(4)] for k in range(40)]
    ways = spark.createDataFrame([(k, ("natural_boundary", "manmade_boundary")[k % 2], "s", n) for k, n in enumerate(nodes)], "osm_id long, category string, subtype string, geom array<struct<lat double, lon double>>")
    plan = spatial.environment_v2(anchors, ways, 5000.0, size, 32.0)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(word in plan[: plan.index("MapInArrow")] for word in ("Exchange", "Join", "Sort"))
    outlines = spatial.outlines_v2(anchors, ways, 5000.0, size, 32.0).cache()
    env = spatial.scenes_v2(spatial.with_rasters(outlines, 5000.0, size)).cache()
    assert env.columns == spatial.environment_v2(anchors, ways, 5000.0, size, 32.0).columns and env.where("barrier_density > 0").count() > 20
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spatial.distances_of(outlines, 4, 5000.0, size)) == rows(spatial.distances_at(env, 4, size))
    sums = {}
    for r in spatial.mask_rows(env, size).where("mask in ('water', 'natural')").collect():
        at = [i for i, c in enumerate(r.cells) if c == "1"]
        sums.setdefault((r.sample_id, r.gy), {})[r["mask"]] = (len(at), sum(at))
    got = {(r.sample_id, r.gy): ((r.water, r.sum_water), (r.natural, r.sum_natural)) for r in spatial.mask_sums(outlines, ("water", "natural"), 5000.0, size).collect()}
    assert got == {k: (v.get("water", (0, 0)), v.get("natural", (0, 0))) for k, v in sums.items()}
    cells = {r.sample_id: (r.water, r.natural) for r in spatial.mask_cells(env, ("water", "natural"), size).collect()}
    assert cells == {s: tuple(sum(v.get(m, (0, 0))[0] for (own, _), v in sums.items() if own == s) for m in ("water", "natural")) for s in cells} and len(cells) == 70
