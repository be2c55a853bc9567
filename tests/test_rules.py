"""Golden cases of rules that the tables do not reach."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewake.functions import dims, vessels
from tidewake.functions import sql as sqlfuncs
from tidewake.operators import ingest, polygons, routing, tracks, views
from tidewake.sources import ais

FIX = "mmsi bigint, id bigint, t bigint, lat double, lon double, speed double, heading int, vessel_type int, tier string"
MIN = 60_000


def kept(spark, rows):
    d = spark.createDataFrame([(1, k, t, lat, lon, s, h, kind, tier) for k, (t, lat, lon, s, h, kind, tier) in enumerate(rows)], FIX)
    return tracks.compress(d).first()["kept"]


@pytest.mark.parametrize(
    ("second", "moves"),
    [
        ((1 * MIN, 48.3 + 0.0005, -123.4, 10.0, 90, 70, "direct"), False),  # below the floor
        ((1 * MIN, 48.3 + 0.0012, -123.4, 10.0, 90, 70, "direct"), False),  # straight on
        ((1 * MIN, 48.3 + 0.0012, -123.4, 10.0, 105, 70, "direct"), True),  # a turn of exactly the limit
        ((1 * MIN, 48.3 + 0.0012, -123.4, 11.0, 90, 70, "direct"), True),  # faster by exactly the limit
        ((3 * MIN, 48.3 + 0.0012, -123.4, 10.0, 90, 70, "direct"), True),  # long ago
        ((3 * MIN, 48.3 + 0.0012, -123.4, 10.0, 90, 31, "direct"), False),  # a tug may wait twice as long
        ((1 * MIN, 48.3 + 0.0026, -123.4, 10.0, 90, 70, "direct"), True),  # far away
        ((1 * MIN, 48.3 + 0.0012, -123.4, 10.0, None, 70, "direct"), False),  # unknown heading
    ],
)
def test_significant_move(spark, second, moves):
    assert kept(spark, [(0, 48.3, -123.4, 10.0, 90, 70, "direct"), second]) == ([0, 1] if moves else [0])


def test_start_alone_counts(spark):
    """From 0.4 to 0.9 kn: too small a change of speed, but a start."""
    assert kept(spark, [(0, 48.3, -123.4, 0.4, 90, 70, "direct"), (MIN, 48.3012, -123.4, 0.9, 90, 70, "direct")]) == [0, 1]
    assert kept(spark, [(0, 48.3, -123.4, 0.6, 90, 70, "direct"), (MIN, 48.3012, -123.4, 0.9, 90, 70, "direct")]) == [0]


def test_merge_last_word_wins_with_nulls(spark):
    rows = [(1, 1, "PositionReport", 7, "A", 48.1, -123.1, 5.0, 10, None, None, None), (1, 2, "ShipStaticData", 7, "B", None, None, None, None, 70, 100, "X"), (1, 3, "PositionReport", 7, None, 48.2, -123.2, None, None, None, None, None), (1, 4, "ShipStaticData", 7, None, None, None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "scan_id bigint, seq bigint, kind string, mmsi bigint, name string, lat double, lon double, speed double, heading int, vessel_type int, length bigint, destination string")
    r = ais.merge(d).first()
    assert (r.name, r.lat, r.speed, r.heading, r.vessel_type, r.destination, r.has_position) == (None, 48.2, None, None, None, None, True)


def test_parse_sets_bad_frames_aside(spark):
    good = '{"MessageType":"PositionReport","MetaData":{"MMSI":316000001,"ShipName":"  ","latitude":1.0,"longitude":2.0},"Message":{"PositionReport":{"Sog":3.0,"TrueHeading":511}}}'
    static = '{"MessageType":"ShipStaticData","MetaData":{"MMSI":316000001},"Message":{"ShipStaticData":{"Type":0,"Dimension":{"A":0,"B":0},"Destination":" ","Name":"N"}}}'
    raw = spark.createDataFrame([(1, good), (2, "{broken"), (3, static), (4, '{"MessageType":"Other","MetaData":{"MMSI":1}}'), (5, None)], "seq bigint, value string")
    rows = {r.seq: r for r in ais.parse(raw).collect()}
    assert sorted(rows) == [1, 3]
    assert rows[1].heading is None and rows[1].name is None
    assert (rows[3].vessel_type, rows[3].length, rows[3].destination, rows[3].name) == (None, None, None, "N")


def test_phantom_is_forced_once(spark):
    heard = spark.createDataFrame([(1, "A", 48.3, -123.4, 9.0, 90, 70, 100, None)], "mmsi bigint, name string, lat double, lon double, speed double, heading int, vessel_type int, length bigint, destination string")
    state = "mmsi bigint, known boolean, o_flag double, o_seen bigint, o_interest int, o_extent string, o_entries bigint, o_type int, o_length bigint, o_lat double, o_lon double, o_speed double, o_heading int, o_ts bigint"
    now = 10_000_000
    for flag, outcome in ((9.0, "phantom"), (0.0, "skipped")):
        s = spark.createDataFrame([(1, True, flag, now - 1000, 1, "direct", 1, 70, 100, 48.3, -123.4, 9.0, 90, now - 1_500_000)], state)
        done = ingest.scan("direct", heard, s, dims.zones(spark), now)
        row = done.judged.first()
        assert (row.outcome, row.effective_speed) == (outcome, 0.0)
        assert done.upserts.count() == (1 if outcome == "phantom" else 0)


def test_zone_edge_goes_to_the_first_zone(spark):
    from tidewake.operators.views import zone_of

    d = spark.createDataFrame([(1, 48.43, -123.41), (2, 0.0, 0.0)], "id int, lat double, lon double")
    assert [(r.id, r.zone_id) for r in zone_of(d, dims.zones(spark)).collect()] == [(1, "victoria-harbour")]


def test_rotation_and_lock():
    assert ingest.rotation(41, 36) == ([36, 37, 38, 39, 40, 0, 1, 2, 3, 4, 5, 6], 7)
    assert ingest.lock_transition("a", 10, "b", 5, 20) is None
    assert ingest.lock_transition("a", 10, "b", 10, 20) == ("b", 20)


def test_sql_functions(spark):
    assert "tier_of" in sqlfuncs.register(spark)
    row = spark.sql("SELECT tier_of(48.3D, -123.4D) AS a, worker_class(75) AS b, round(haversine_km(0D, 0D, 0D, 1D), 3) AS c, is_large(NULL, 60) AS d").first()
    assert (row.a, row.b, row.c, row.d) == ("direct", "cargo", 111.195, True)


def test_flag_and_age(spark):
    d = spark.createDataFrame([("CA", 59_999), ("US", 3_600_000), (None, 120_000)], "iso string, age bigint")
    assert [tuple(r) for r in d.select(vessels.flag(F.col("iso")), vessels.age_label(F.col("age"))).collect()] == [("🇨🇦", "59s ago"), ("🇺🇸", "1h ago"), (None, "2m ago")]


def test_smoothing_keeps_fixes_off_land(spark):
    """The middle fix moves towards its neighbours' line, unless land lies there."""
    rows = [(1, 0, 0, 0.0, 0.0), (1, 1, 1, 0.1, 1.0), (1, 2, 2, 0.0, 2.0)]
    fixes = spark.createDataFrame(rows, "mmsi bigint, id bigint, t bigint, lat double, lon double").withColumn("journey", F.lit(0))

    def middle(ring):
        shore = routing.Land([ring])
        out = {r.id: (r.lat, r.lon) for r in tracks.denoised(fixes, lambda lat, lon: routing.is_land(lat, lon, shore)).collect()}
        assert out[0] == (0.0, 0.0) and out[2] == (0.0, 2.0)
        return out[1]

    assert middle([(-0.5, 0.5), (0.09, 0.5), (0.09, 1.5), (-0.5, 1.5)]) == (0.1, 1.0)
    lat, lon = middle([(-0.5, 0.5), (0.07, 0.5), (0.07, 1.5), (-0.5, 1.5)])  # the second pass would reach land
    assert 0.07 < lat < 0.09 and lon == 1.0


def test_running_totals_with_ties_and_nulls(spark):
    rows = [(None if k % 17 == 0 else k % 5 if k % 3 else k, k, k % 4 or None) for k in range(700)]
    got = ingest.running(spark.createDataFrame(rows, "at bigint, id bigint, n int"), ("at", "id"), {"total": F.col("n"), "place": F.lit(1)})
    want, total = {}, 0
    for place, (at, k, n) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 1):
        total += n or 0
        want[k] = (total, place)
    assert {r.id: (r.total, r.place) for r in got.collect()} == want
    none = spark.createDataFrame([], "at bigint, id bigint, n int")
    assert ingest.running(none, ("at", "id"), {"total": F.col("n")}).count() == 0


def test_a_backslash_in_a_search_is_itself(spark):
    rows = [(1, "A\\B"), (2, "AB"), (3, "A_B"), (4, "AxB"), (5, None)]
    vessel = spark.createDataFrame(rows, "mmsi bigint, name string").selectExpr("*", "1 AS vessel_type", "1 AS length", "1 AS of_interest", "'direct' AS max_extent", "mmsi AS last_seen")
    found = lambda term: sorted(r.mmsi for r in views.search(vessel, term).collect())
    assert found("a\\b") == [1] and found("\\") == [1] and found("a_b") == [1, 3, 4] and found("b\\") == []


def test_ring_problems_with_boxes(spark):
    ring = lambda *p: [{"lat": float(a), "lon": float(b)} for a, b in p]
    nan = float("nan")
    rows = [("a", 1, ring((0, 0), (0, 1), (1, 1), (1, 0))), ("a", 2, ring((0, 0), (0, 1), (1, 1))), ("a", 3, ring((0, 0), (0, 9), (1, 1), (1, 0))), ("a", 4, ring((0, 0), (0, nan), (1, 1), (1, 0))), ("a", 5, ring((0, 0), (0, 1.5), (1, 1), (1.5, 0)))]
    rings = spark.createDataFrame(rows, "region string, ring_id int, ring array<struct<lat:double,lon:double>>")
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 0.0, 0.0, 1.0, 1.0), ("c", 1.0, 0.0, 1.0, 1.0)], "region string, south double, west double, north double, east double")
    got = sorted((r.region, r.ring_id or 0, r.problem) for r in polygons.problems(rings, boxes).collect())
    assert got == [("a", 2, "too few points"), ("a", 3, "outside the region"), ("a", 4, "off the globe"), ("b", 0, "no rings"), ("c", 0, "malformed box"), ("c", 0, "no rings")]
