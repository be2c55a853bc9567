"""Trails: land by regions, water around a place, control points and their repair, the job and its store."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import listings, polygons, routing, tracks, trails

CAPE = [(48.2, -123.5), (48.4, -123.5), (48.4, -123.3), (48.2, -123.3)]
LAND = routing.Land([CAPE])
HOUR = 3_600_000
FIX = "mmsi long, id long, t long, lat double, lon double, speed double, length int, tier string, fake boolean"


@pytest.fixture(scope="module")
def fixes(spark):
    """A vessel that is lost west of the cape and heard again east of it, one that stays at sea, one with a single fix."""
    west = [(1, k, k * 600_000, 48.30, -123.70 + 0.03 * k, 9.0, 90, "local", False) for k in range(4)]
    east = [(1, 10 + k, 4 * HOUR + k * 600_000, 48.30, -123.22 + 0.03 * k, 9.0, 90, "direct", False) for k in range(4)]
    sea = [(2, 20 + k, k * 600_000, 48.0 + 0.01 * k, -124.0, 9.0, None, "local", False) for k in range(5)]
    return spark.createDataFrame([*west, *east, *sea, (3, 40, 0, 48.0, -124.0, 9.0, None, "local", False)], FIX)


def test_regions_decide_in_their_boxes():
    coarse = [(48.0, -124.0), (49.0, -124.0), (49.0, -123.0), (48.0, -123.0)]
    fine = routing.Region((48.2, -123.6, 48.6, -123.2), [CAPE])
    wet = routing.Region((48.6, -123.9, 48.9, -123.1), [], [([(48.7, -123.8), (48.8, -123.8), (48.8, -123.2), (48.7, -123.2)], [])])
    shore = routing.RegionLand([], [], [coarse], [fine, wet])
    lat, lon = np.array([48.3, 48.5, 48.1, 48.75, 48.65, 47.0]), np.full(6, -123.4)
    assert shore.is_land(lat, lon).tolist() == [True, False, True, False, True, False]
    assert shore.within(48.25, -123.5, 48.3, -123.4).regions == [fine]
    assert shore.is_land(np.array([]), np.array([])).tolist() == []


def test_water_around_places(spark):
    d = spark.createDataFrame([(48.3, -123.49), (48.3, -123.4)], "lat double, lon double")
    out = d.select(trails.nearest_water(F.col("lat"), F.col("lon"), LAND).alias("w"), trails.depth_km(F.col("lat"), F.col("lon"), LAND).alias("d")).collect()
    assert out[0].w.lon < -123.5 and not LAND.is_land([out[0].w.lat], [out[0].w.lon])[0] and out[0].d == pytest.approx(0.75)
    assert out[1].w is None and out[1].d == 2.0


def test_control_points_go_around_the_cape(spark, fixes):
    points = trails.control_points(fixes, LAND)
    mine = points.filter("mmsi = 1").orderBy("t").collect()
    assert any(r.fake for r in mine) and [r.t for r in mine] == sorted(r.t for r in mine)
    assert not any(LAND.crosses((a.lat, a.lon), (b.lat, b.lon)) for a, b in zip(mine, mine[1:]))
    assert not any(r.fake for r in trails.control_points(fixes, LAND, routed=False).collect())


def test_repair_never_makes_a_curve_worse(spark):
    """A straight line through the cape gets a way around it, and one that clips a corner is pulled off."""
    rows = [(1, 0, 1, 0.0, 48.3, -123.7, False), (1, 0, 2, 1e7, 48.3, -123.1, False), (2, 0, 1, 0.0, 48.45, -123.6, False), (2, 0, 2, 1e6, 48.402, -123.51, False), (2, 0, 3, 2e6, 48.402, -123.29, False), (2, 0, 4, 3e6, 48.45, -123.2, False), (3, 0, 1, 0.0, 47.0, -124.0, False), (3, 0, 2, 1e6, 47.1, -124.0, False)]
    points = spark.createDataFrame(rows, "mmsi long, journey long, id long, t double, lat double, lon double, fake boolean")
    count = lambda p: {r.mmsi: r.n for r in tracks.spline(p).filter(routing.is_land(F.col("lat"), F.col("lon"), LAND)).groupBy("mmsi").agg(F.count("*").alias("n")).collect()}
    before, out = count(points), trails.repaired(points, LAND)
    after = count(out)
    assert before[1] > 0 and after.get(1, 0) < before[1] and all(after[m] <= before[m] for m in after)
    assert {r.mmsi: r.ashore for r in out.select("mmsi", "ashore").distinct().collect()} == {m: after.get(m, 0) for m in (1, 2, 3)}
    ends = {(r.mmsi, r.lat, r.lon) for r in out.collect()}
    assert {(m, y, x) for m, _, _, _, y, x, _ in rows if m == 3} <= ends and (1, 48.3, -123.7) in ends and (1, 48.3, -123.1) in ends


def test_job_stores_what_a_trail_needs_once(spark, fixes):
    vessel = spark.createDataFrame([(m, 1, 0, 5 * HOUR) for m in (1, 2, 3)], "mmsi long, of_interest int, first_direct_at long, last_pos_ts long")
    stored = spark.createDataFrame([(1, "old", 0, 1.0, 48.3, -123.4, "local")], "mmsi long, segment string, seq int, t double, lat double, lon double, tier string")
    state = spark.createDataFrame([], "mmsi long, done long")
    made = trails.job(fixes, vessel, stored, state, LAND)
    assert [tuple(r) for r in made.delete.collect()] == [(1, "old")]
    rows = made.insert.orderBy("seq").collect()
    assert rows and {r.mmsi for r in rows} == {1} and {r.tier for r in rows} == {"local"} and [r.seq for r in rows] == list(range(len(rows)))
    assert {r.mmsi for r in made.state.collect()} == {1, 2, 3}
    store = trails.applied(stored, made.delete, made.insert)
    assert sorted(map(tuple, store.collect())) == sorted(map(tuple, trails.applied(store, made.delete, made.insert).collect()))
    again = trails.job(fixes, vessel, store, state, LAND)
    assert again.insert.count() == 0 and again.delete.count() == 0
    assert trails.job(fixes, vessel, store, made.state, LAND).state.count() == 0


def test_points_in_many_rings(spark):
    rng = np.random.default_rng(3)
    places = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform((48.0, -123.8), (48.6, -123.0), (300, 2)))]
    shapes = [CAPE, [(48.1, -123.7), (48.5, -123.4), (48.1, -123.1)]]
    rings = spark.createDataFrame([("r", k, [{"lat": a, "lon": b} for a, b in s]) for k, s in enumerate(shapes)], f"region string, ring_id int, ring {polygons.RING}")
    found = {(r.id, r.ring_id) for r in trails.in_polygons(spark.createDataFrame(places, "id int, lat double, lon double"), rings).collect()}
    lat, lon = np.array([p[1] for p in places]), np.array([p[2] for p in places])
    assert found == {(int(i), k) for k, s in enumerate(shapes) for i in np.flatnonzero(routing.inside(lat, lon, np.array(s)))}


def test_thinning_by_place(spark):
    """The same bend of 0.2 km stays near home and goes far out."""
    bend = lambda y, x: [{"lat": y, "lon": x}, {"lat": y + 0.0018, "lon": x + 0.05}, {"lat": y, "lon": x + 0.1}]
    d = spark.createDataFrame([(0, bend(48.43, -123.4)), (1, bend(58.0, -140.0))], f"id int, ring {polygons.RING}")
    out = {r.id: r.n for r in d.select("id", F.size(polygons.thinned(F.col("ring"), polygons.thin_km)).alias("n")).collect()}
    assert out == {0: 3, 1: 2}


def test_fixes_of_different_vessels_share_no_trust(spark):
    """A sample near a fix of its own vessel excuses no sample of another vessel that has the same number."""
    samples = spark.createDataFrame([(1, "-1/0", 48.3, -123.4), (2, "-1/0", 48.3, -123.4)], "mmsi long, id string, lat double, lon double")
    reals = spark.createDataFrame([(1, 48.3, -123.4)], "mmsi long, lat double, lon double")
    found = listings.curve_land_free(samples, reals, lambda lat, lon: routing.is_land(lat, lon, LAND)).collect()
    assert {r.mmsi: (r.bad, r.land_free) for r in found} == {1: (0, True), 2: (1, False)}


def test_stretches_of_fixes_equal_runs_of_samples(spark):
    """Journeys of one fix, of one kind and of changing kinds, with equal times."""
    rng = np.random.default_rng(2)
    rows = [(v, j, v * 1000 + j * 100 + k, 1000 * (k // 2 if v == 2 else k), 48.0 + float(rng.normal()) / 50, -123.0 + 0.01 * k, bool(rng.random() < (0.4 if j else 0.0))) for v in range(4) for j in range(2) for k in range(1 if v == 3 else 30)]
    points = spark.createDataFrame(rows, "mmsi long, journey long, id long, t long, lat double, lon double, fake boolean")
    found, wanted = tracks.stretches(points), tracks.runs(tracks.spline(points))
    assert sorted(map(tuple, found.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))


def test_equal_segments_meet_as_in_a_full_join(spark):
    rows = [(1, "a", 0, True, True), (1, "a", 1, True, False), (1, "b", 2, True, False), (2, "a", 3, False, True), (None, "c", 4, True, True), (3, "d", 5, False, False)]
    g = spark.createDataFrame(rows, "mmsi long, seg string, id long, h boolean, w boolean")
    found = sorted((r.mmsi or 0, r.seg, r.action) for r in tracks.segment_changes(g, F.col("h"), F.col("w")).collect())
    assert found == [(0, "c", "delete"), (0, "c", "insert"), (1, "a", "keep"), (1, "a", "keep"), (1, "b", "delete"), (2, "a", "insert")]
