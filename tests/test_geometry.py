"""Routes over water, polygon work, file sources, streams."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from tidewake.operators import coast, polygons, routing, tracks
from tidewake.sources import adapter, files
from tidewake.streaming import ingest as stream

SMALL = "/root/testdata/sf0.001"
#: A cape between two bays, with a lagoon in it and an island in the lagoon.
CAPE = [(48.2, -123.5), (48.4, -123.5), (48.4, -123.3), (48.2, -123.3)]
LAGOON = ([(48.22, -123.45), (48.28, -123.45), (48.28, -123.35), (48.22, -123.35)], [[(48.24, -123.42), (48.26, -123.42), (48.26, -123.38), (48.24, -123.38)]])
LAND = routing.Land([CAPE], [LAGOON])


def test_land_and_water(spark):
    lat, lon = np.array([48.3, 48.23, 48.25, 47.0]), np.array([-123.4, -123.4, -123.4, -123.4])
    assert LAND.is_land(lat, lon).tolist() == [True, False, True, False]
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lat, lon)], "lat double, lon double")
    assert [r[0] for r in d.select(routing.is_land(F.col("lat"), F.col("lon"), LAND)).collect()] == [True, False, True, False]


def test_route_keeps_off_land_and_is_the_same_each_time():
    a, b = (48.3, -123.6), (48.3, -123.2)
    way = routing.route(a, b, LAND, max_cells=150)
    assert way[0] == a and way[-1] == b and len(way) > 2
    assert not any(LAND.crosses(p, q) for p, q in zip(way, way[1:]))
    assert way == routing.route(a, b, LAND, max_cells=150)
    soft = routing.smoothed(way, LAND)
    few = routing.simplified(soft, LAND)
    assert len(few) <= len(soft) and not any(LAND.crosses(p, q) for p, q in zip(few, few[1:]))


def test_no_way_through_a_wall():
    wall = routing.Land([[(40.0, -123.5), (56.0, -123.5), (56.0, -123.3), (40.0, -123.3)]])
    assert routing.route((48.3, -123.6), (48.3, -123.2), wall, max_cells=80) is None


def test_routes_of_gaps(spark):
    rows = [(1, 1, 0, 48.3, -123.7, 5.0, "local"), (1, 2, 600_000, 48.3, -123.6, 5.0, "local"), (1, 3, 9_000_000, 48.3, -123.2, 5.0, "local"), (1, 4, 9_600_000, 48.3, -123.1, 5.0, "local")]
    d = spark.createDataFrame(rows, "mmsi bigint, id bigint, t bigint, lat double, lon double, speed double, tier string").withColumn("length", F.lit(200).cast("bigint")).withColumn("fake", F.lit(False))
    gaps = routing.land_gaps(d, LAND)
    assert [(r.a_t, r.b_t) for r in gaps.collect()] == [(600_000, 9_000_000)]
    few, full = (routing.water_routes(gaps, LAND, 120, full=f).orderBy("seq").collect() for f in (False, True))
    assert 0 < len(few) <= len(full)
    assert all(600_000 < r.t < 9_000_000 for r in few)
    assert {r.segment for r in few} == {"600000-9000000-200-v1"}


def ring(spark, points):
    return spark.createDataFrame([([{"lat": a, "lon": b} for a, b in points],)], f"ring {polygons.RING}")


def test_clip_and_thin(spark):
    out = ring(spark, [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]).select(polygons.clip(F.col("ring"), 1, 1, 3, 9).alias("r")).first()["r"]
    assert {(p.lat, p.lon) for p in out} == {(1.0, 1.0), (1.0, 4.0), (3.0, 4.0), (3.0, 1.0)}
    assert ring(spark, [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]).select(polygons.clip(F.col("ring"), 5, 5, 6, 6).alias("r")).first()["r"] == []
    line = [(0.0, k / 100) for k in range(50)] + [(0.3, 0.5)]
    out = ring(spark, line).select(polygons.thinned(F.col("ring"), 0.1).alias("r"), polygons.span_km(F.col("ring")).alias("d")).first()
    assert [(p.lat, p.lon) for p in out.r] == [line[0], line[49], line[50]]
    assert 60 < out.d < 70


def test_ways_holes_and_checks(spark):
    ways = spark.createDataFrame([("r", 1, [1, 2, 3]), ("r", 2, [3, 4, 1]), ("r", 1, [1, 2, 3]), ("r", 9, [7, 8])], "region string, id bigint, nodes array<bigint>")
    found = {(r.closed, tuple(r.nodes)) for r in polygons.joined_ways(ways).collect()}
    assert found == {(True, (1, 2, 3, 4, 1)), (False, (7, 8))}
    box = lambda a, b: [{"lat": a, "lon": a}, {"lat": a, "lon": b}, {"lat": b, "lon": b}, {"lat": b, "lon": a}]
    outer = spark.createDataFrame([("r", 1, box(0.0, 9.0)), ("r", 2, box(20.0, 29.0))], f"region string, ring_id int, ring {polygons.RING}")
    inner = spark.createDataFrame([("r", box(1.0, 2.0)), ("r", box(3.0, 4.0))], f"region string, ring {polygons.RING}")
    assert {r.ring_id: len(r.holes) for r in coast.with_holes(outer, inner).collect()} == {1: 2, 2: 0}
    bad = spark.createDataFrame([("r", 1, box(0.0, 9.0)[:3]), ("r", 2, box(80.0, 99.0)), ("r", 3, box(0.0, 1.0))], f"region string, ring_id int, ring {polygons.RING}")
    assert {r.ring_id: r.problem for r in polygons.problems(bad).collect()} == {1: "too few points", 2: "off the globe"}


def test_file_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"mmsi": 5, "name": "A", "points": [{"lat": 2.0, "lon": 2.0, "speed": 1.0, "t": 20, "tier": "local"}, {"lat": 1.0, "lon": 1.0, "speed": 1.0, "t": 10, "tier": "local"}]}))
    rows = files.captured_tracks(spark, str(tmp_path / "t.json")).orderBy("t", "id").collect()
    assert [(r.t, r.lat) for r in rows] == [(10, 1.0), (20, 2.0)] and rows[0].id < rows[1].id
    (tmp_path / "d.json").write_text(json.dumps([{"results": [{"lat": 1.0, "ts": 5}, {"lat": 2.0, "ts": 3}]}]))
    assert [r.ts for r in files.store_dump(spark, str(tmp_path / "d.json")).collect()] == [3, 5]
    shape = {"features": [{"geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [5, 6], [1, 2]]]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[[[7, 8], [9, 10]]], [[[1, 1], [2, 2]]]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(shape))
    rings = files.geojson_rings(spark, str(tmp_path / "g.json")).orderBy("feature", "part").collect()
    assert [(r.feature, r.part, r.ring[0].lat, r.ring[0].lon) for r in rings] == [(0, 0, 2.0, 1.0), (1, 0, 8.0, 7.0), (1, 1, 1.0, 1.0)]
    for k in (1, 2):
        (tmp_path / f"osm{k}.json").write_text(json.dumps({"elements": [{"type": "way", "id": 1, "nodes": [1, 2]}, {"type": "way", "id": k + 1, "nodes": [2, 3]}, {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0}]}))
    ways, nodes = files.osm_elements(spark, str(tmp_path / "osm*.json"))
    assert ways.count() == 3 and nodes.count() == 1


def test_stream_compressor_equals_fold(spark, tmp_path):
    fix = adapter.fixes(spark, SMALL, fast=True).select("mmsi", F.col("event_id").alias("id"), F.col("ts").alias("t"), "lat", "lon", "speed", "heading", "vessel_type", "tier")
    cut = fix.approxQuantile("t", [0.4], 0.0)[0]
    for k, part in enumerate((fix.filter(F.col("t") <= cut), fix.filter(F.col("t") > cut))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(fix.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.compressed(read).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {(r.mmsi, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.mmsi, i) for r in tracks.compress(fix).collect() for i in r.kept}
    assert got == want


def test_stream_scans_and_replay(spark, tmp_path):
    fix = adapter.fixes(spark, SMALL)
    raw = adapter.messages(fix, hours=240).withColumn("scan_ts", (F.col("scan_id") + 1) * 240 * 3_600_000).drop("scan_id")
    for (ts,) in raw.select("scan_ts").distinct().orderBy("scan_ts").collect():
        raw.filter(F.col("scan_ts") == ts).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = stream.Store(spark, str(tmp_path / "store"))
    stream.run(read, store, "global", str(tmp_path / "check")).awaitTermination(300)
    again = stream.Store(spark, str(tmp_path / "store"))
    assert again.version == store.version and again.version >= 1
    vessels, positions = again.vessels(), again.positions()
    assert vessels.count() == fix.select("mmsi").distinct().count() == vessels.select("mmsi").distinct().count()
    assert positions.select("id").distinct().count() == positions.count() > 0
    n = positions.count()
    stream.apply_scan(again, again.version, raw.select("seq", "value"), "global", 0)  # a batch that is in already
    assert again.positions().count() == n


def test_bands_of_a_ring_equal_the_test_of_all_edges():
    rng = np.random.default_rng(5)
    for n in (3, 31, 32, 33, 500, 5000):
        angle = np.sort(rng.random(n)) * 2 * np.pi
        ring = np.stack([48 + np.sin(angle) * (1 + rng.random(n) / 3), -123 + np.cos(angle) * (1 + rng.random(n) / 3)], axis=1)
        ring[: n // 3, 0] = np.round(ring[: n // 3, 0], 1)  # level edges, and vertices at the height of points
        lat, lon = rng.uniform(46, 50, 4000), rng.uniform(-125, -121, 4000)
        lat[:500], lon[:20], lat[:20] = np.round(lat[:500], 1), ring[:20, 1] if n > 20 else lon[:20], ring[:20, 0] if n > 20 else lat[:20]
        near = (lat >= ring[:, 0].min()) & (lat <= ring[:, 0].max()) & (lon >= ring[:, 1].min()) & (lon <= ring[:, 1].max())
        assert (routing.Banded([tuple(p) for p in ring.tolist()]).holds(lat, lon) == (near & routing.inside(lat, lon, ring))).all()


def test_nearest_water_cell_equals_a_search_ring_by_ring():
    """From places in the cape, beside it and at sea, with squares of rings and with single rings."""
    rings = type("Rings", (routing.Grid,), {"SQUARES": ()})
    for a in ((48.3, -123.4), (48.21, -123.49), (48.39, -123.31), (48.1, -123.6)):
        found = [kind(a, (48.3, -123.1), LAND, 400).cell(*a) for kind in (routing.Grid, rings)]
        assert found[0] == found[1] and found[0] is not None


def test_many_lines_cross_land_as_one_by_one():
    rng = np.random.default_rng(5)
    a, b = (rng.uniform((48.1, -123.6), (48.5, -123.2), (300, 2)) for _ in range(2))
    b[:100] = a[:100] + (b[:100] - a[:100]) * 1e-3
    assert LAND.crossed(a, b).tolist() == [LAND.crosses(tuple(p), tuple(q)) for p, q in zip(a, b)]
    assert LAND.crossed(a[:0], b[:0]).tolist() == []


def test_equal_gaps_share_a_way(spark):
    """Each of 40 vessels on one course gets its own points and times."""
    rows = [(m, 600_000 * m, 600_000 * m + 8_400_000, 48.3, -123.6, 48.3, -123.2, None, 90.0) for m in range(1, 41)]
    gaps = spark.createDataFrame(rows, "mmsi bigint, a_t bigint, b_t bigint, a_lat double, a_lon double, b_lat double, b_lon double, entry double, leave double").withColumn("length", F.lit(200).cast("bigint"))
    found = routing.water_routes(gaps, LAND, 120).collect()
    per = {m: sorted((r.seq, r.t - 600_000 * m, r.lat, r.lon) for r in found if r.mmsi == m) for m in range(1, 41)}
    assert len(per[1]) > 0 and all([x[0] for x in v] == [x[0] for x in per[1]] and [x[2:] for x in v] == [x[2:] for x in per[1]] for v in per.values())
