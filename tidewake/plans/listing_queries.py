"""Queries of ordered listings, of filters of what is shown and of rules on trails, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import dims, geo, vessels
from tidewake.operators import listings, routing, tracks, views
from tidewake.plans import function_queries, sql, track_queries, view_queries
from tidewake.plans.function_queries import _edges, ring
from tidewake.sources import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SHOWN, HIDDEN = ("distant_visitor", "passing_through"), ("ferry", "tug", "unknown")
#: Two boxes that are asked for together: the north and the south of the local box.
BOXES = ((48.2, -123.9, 48.6, -123.2), (49.0, -123.6, 49.4, -122.9))
FADE = 0.8


def query(name: str, oracle: str):
    """Registers a function of (fixes, positions, vessels, session) under a name."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            fix = adapter.fixes(spark, sf_dir)
            return f(fix, adapter.positions(fix), adapter.vessel_table(fix), spark)

        QUERIES[name], ORACLE_SQL[name] = run, oracle
        return f

    return put


STATUS = "mmsi, name, vessel_type, last_speed, last_seen, CASE WHEN last_speed >= 15E-1 THEN 'moving' ELSE 'stopped' END AS status"


@query("recent_top", sql.over(f"SELECT {STATUS} FROM vessels ORDER BY last_seen DESC, mmsi LIMIT 20"))
def _recent(fix, positions, vessel, spark):
    return listings.newest(vessel, "last_seen", 20, "mmsi").selectExpr(*STATUS.split(", "))


SHIPS = "mmsi, name, vessel_type, length, of_interest, max_extent, last_seen AS last_seen_utc, times_seen, coalesce(direct_entry_count, 0) AS direct_entry_count"


@query("list_ships_top", sql.over(f"SELECT {SHIPS} FROM vessels ORDER BY last_seen DESC, mmsi LIMIT 50"))
def _ships(fix, positions, vessel, spark):
    return listings.newest(vessel, "last_seen", 50, "mmsi").select("mmsi", "name", "vessel_type", "length", "of_interest", "max_extent", F.col("last_seen").alias("last_seen_utc"), "times_seen", F.coalesce("direct_entry_count", F.lit(0)).alias("direct_entry_count"))


@query("of_interest_top", sql.over("SELECT mmsi, name, max_extent, first_direct_at AS first_direct_utc, last_seen AS last_seen_utc FROM vessels WHERE of_interest = 1 ORDER BY last_seen DESC, mmsi LIMIT 10"))
def _interest(fix, positions, vessel, spark):
    return listings.newest(vessel.filter("of_interest = 1"), "last_seen", 10, "mmsi").select("mmsi", "name", "max_extent", F.col("first_direct_at").alias("first_direct_utc"), F.col("last_seen").alias("last_seen_utc"))


def _lines(where: str, limit: int) -> str:
    return sql.over(f"SELECT p.id, p.mmsi, v.name, p.lat, p.lon, p.speed, p.heading, p.tier, p.ts AS ts_utc FROM positions p LEFT JOIN vessels v ON v.mmsi = p.mmsi WHERE {where} ORDER BY p.ts DESC, p.id LIMIT {limit}")


@query("timeline_top", _lines("p.tier = 'local'", 40))
def _timeline(fix, positions, vessel, spark):
    return listings.timeline(positions, vessel, 40, tier="local")


@query("positions_top", _lines("p.mmsi = 316000007", 15))
def _positions(fix, positions, vessel, spark):
    return listings.timeline(positions, vessel, 15, mmsi=316_000_007)


@query("list_page", sql.over(f"SELECT mmsi, coalesce(name, '') AS name, {sql.rounded(sql.haversine(*function_queries.HERE, 'last_lat', 'last_lon'))} AS distance_nm FROM vessels ORDER BY distance_nm DESC, mmsi LIMIT 25"))
def _page(fix, positions, vessel, spark):
    home = [F.lit(x) for x in view_queries.HOME]
    listed = views.listed(vessel, F.lit(None).cast("string"), geo.haversine_nm(*home, F.col("last_lat"), F.col("last_lon")))
    return listings.page(listed, "distance_nm", True, 25).select("mmsi", "name", "distance_nm")


JOURNEY = "CASE WHEN max_extent = 'global' THEN 'distant_visitor' WHEN max_extent = 'direct' OR direct_entry_count >= 3 THEN 'local_boat' ELSE 'passing_through' END"


@query("extent_filter", sql.over(f"SELECT mmsi, max_extent, direct_entry_count FROM vessels WHERE {JOURNEY} IN {SHOWN}"))
def _extent(fix, positions, vessel, spark):
    return vessel.filter(listings.passes_extent(F.col("max_extent"), F.col("direct_entry_count"), SHOWN)).select("mmsi", "max_extent", "direct_entry_count")


def _category(vessel: DataFrame) -> DataFrame:
    return vessel.select("mmsi", "name", vessels.display_class(*(F.col(c) for c in ("mmsi", "name", "vessel_type", "length"))).alias("category"))


@query("type_filter", sql.over(f"SELECT mmsi, name, category FROM (SELECT *, {view_queries._display()} AS category FROM vessels) x WHERE category NOT IN {HIDDEN}"))
def _type(fix, positions, vessel, spark):
    return _category(vessel).filter(listings.passes_type(F.col("category"), HIDDEN))


def _named(values: dict[str, str]) -> str:
    return "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query("class_labels", sql.over(f"SELECT mmsi, category, {_named(listings.LABELS)} AS label, {_named(listings.COLOURS)} AS colour FROM (SELECT *, {view_queries._display()} AS category FROM vessels) x"))
def _labels(fix, positions, vessel, spark):
    c = F.col("category")
    return _category(vessel).select("mmsi", "category", listings.looked_up(c, listings.LABELS).alias("label"), listings.looked_up(c, listings.COLOURS).alias("colour"))


#: Numbers as a user may type them: with a sign, a leading zero, a letter, too many digits or none.
TYPED = "CASE event_id % 7 WHEN 0 THEN '-' || mmsi WHEN 1 THEN '0' || mmsi WHEN 2 THEN mmsi || 'x' WHEN 3 THEN mmsi || '7' WHEN 4 THEN '' ELSE CAST(mmsi AS STRING) END"


@query("number_validation", sql.over(f"SELECT event_id, regexp_matches(t, '^[1-9][0-9]{{5,8}}$') AS mmsi_ok, regexp_matches(t, '^[1-9][0-9]*$') AS int_ok FROM (SELECT event_id, {TYPED} AS t FROM fix) x"))
def _valid(fix, positions, vessel, spark):
    t = F.expr(TYPED)
    return fix.select("event_id", listings.valid_mmsi(t).alias("mmsi_ok"), listings.positive_int(t).alias("int_ok"))


@query("boxes_filter", sql.over(f"SELECT event_id, mmsi FROM fix WHERE {' OR '.join(sql.box('lat', 'lon', b) for b in BOXES)}"))
def _boxes(fix, positions, vessel, spark):
    return fix.filter(listings.in_boxes(F.col("lat"), F.col("lon"), BOXES)).select("event_id", "mmsi")


NEXT = "SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM fix WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id)"
TURN = f"abs({sql.degrees(sql.bearing('lat', 'lon', 'lat2', 'lon2'))} - {sql.degrees(sql.bearing('lat0', 'lon0', 'lat', 'lon'))}) % 360"


@query("turn_angles", sql.over(f"SELECT event_id, mmsi, {sql.rounded('CASE WHEN d > 180 THEN 360 - d ELSE d END', 5)} AS turn FROM (SELECT *, {TURN} AS d FROM ({NEXT}) n WHERE lat0 IS NOT NULL AND lat2 IS NOT NULL) x"))
def _turns(fix, positions, vessel, spark):
    return listings.turns(fix).withColumn("turn", geo.rounded(F.col("turn"), 5))


DAY_RINGS = "day_rings AS (SELECT CAST(mmsi AS VARCHAR) AS region, CAST(ts // 86400000 AS INT) AS ring_id, lat, lon FROM fix)"


def _rings(fix: DataFrame) -> DataFrame:
    """Each day of a vessel as a ring of the region that has its number."""
    return fix.groupBy(F.col("mmsi").cast("string").alias("region"), F.floor(F.col("ts") / 86_400_000.0).cast("int").alias("ring_id")).agg(F.collect_list(F.struct("lat", "lon")).alias("ring"))


@query("ring_boxes", sql.over("SELECT region, ring_id, CAST(count(*) AS INT) AS vertices, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM day_rings GROUP BY region, ring_id", DAY_RINGS))
def _ring_boxes(fix, positions, vessel, spark):
    return listings.boxes_of(_rings(fix))


@query("largest_rings", sql.over("SELECT region, ring_id, CAST(count(*) AS INT) AS vertices FROM day_rings GROUP BY region, ring_id ORDER BY vertices DESC, region, ring_id LIMIT 30", DAY_RINGS))
def _largest(fix, positions, vessel, spark):
    return listings.boxes_of(_rings(fix)).select("region", "ring_id", "vertices").orderBy(F.desc("vertices"), "region", "ring_id").limit(30)


@query("region_vertices", sql.over("SELECT region, count(DISTINCT ring_id) AS rings, count(*) AS vertices FROM day_rings GROUP BY region", DAY_RINGS))
def _region_vertices(fix, positions, vessel, spark):
    return listings.boxes_of(_rings(fix)).groupBy("region").agg(F.count("*").alias("rings"), F.sum("vertices").alias("vertices"))


def _points(fix: DataFrame) -> DataFrame:
    return fix.select("mmsi", F.col("ts").alias("t"), F.col("event_id").alias("id"), "lat", "lon")


CHUNKS = f"""chunks AS (SELECT *, i - i % 8 AS s FROM (SELECT mmsi, ts AS t, row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY mmsi) AS n,
    min(ts) OVER (PARTITION BY mmsi) AS t0, max(ts) OVER (PARTITION BY mmsi) AS t1 FROM fix) x)"""


@query("trail_fade", sql.over(f"SELECT mmsi, i // 8 AS chunk, {sql.rounded(f'CASE WHEN t1 > t0 THEN {FADE}E0 * 1E-1 + {FADE}E0 * 9E-1 * (CAST(t - t0 AS DOUBLE) / CAST(t1 - t0 AS DOUBLE)) ELSE {FADE}E0 END')} AS opacity FROM chunks WHERE s < n - 1 AND i = s + (least(s + 9, n) - s - 1) // 2", CHUNKS))
def _fade(fix, positions, vessel, spark):
    return listings.faded(_points(fix), FADE)


@query("trail_signature", sql.over("SELECT mmsi, count(*) || '|' || min(ts) || '|' || max(ts) || '|' || arg_max(CAST(floor(lat * 1E5 + 5E-1) AS BIGINT) || ',' || CAST(floor(lon * 1E5 + 5E-1) AS BIGINT), (ts - 1704067200000) * 10000000 + event_id) AS signature FROM fix GROUP BY mmsi"))
def _signature(fix, positions, vessel, spark):
    return listings.signatures(_points(fix))


def _land(lat, lon):
    return geo.in_ring(lat, lon, ring(function_queries.RING))


ON_LAND = f"({_edges(function_queries.RING)})"


@query("land_runs", sql.over(f"""SELECT mmsi, min(i) AS first, max(i) AS last, min(ts) AS t0, max(ts) AS t1 FROM (SELECT *, sum(CASE WHEN land THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi ORDER BY i) AS run FROM
    (SELECT mmsi, ts, {ON_LAND} AS land, row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) - 1 AS i FROM fix) x) y WHERE land GROUP BY mmsi, run"""))
def _runs(fix, positions, vessel, spark):
    return listings.runs(_points(fix), _land(F.col("lat"), F.col("lon"))).select("mmsi", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "t0", "t1")


NEAR = sql.haversine("r.lat", "r.lon", "s.lat", "s.lon", radius=6371.0)


@query("near_real_fix", sql.over(f"SELECT event_id AS id, mmsi FROM fix s WHERE event_id % 11 = 0 AND EXISTS (SELECT 1 FROM fix r WHERE r.mmsi = s.mmsi AND r.event_id % 11 <> 0 AND {NEAR} < 1.5E0)"))
def _near(fix, positions, vessel, spark):
    return listings.trusted(_points(fix.filter("event_id % 11 = 0")), fix.filter("event_id % 11 <> 0")).select("id", "mmsi")


REAL_ASHORE = f"real_ashore AS (SELECT mmsi, lat, lon FROM fix WHERE event_id % 13 <> 0 AND {ON_LAND})"
NEAR_CURVE = sql.haversine("r.lat", "r.lon", "c.lat", "c.lon", radius=6371.0)
CURVE_BAD = f"SELECT c.mmsi, {ON_LAND} AND NOT EXISTS (SELECT 1 FROM real_ashore r WHERE r.mmsi = c.mmsi AND {NEAR_CURVE} < 1.5E0) AS bad FROM curve c"


@query("curve_land_free", sql.over(f"SELECT mmsi, count(*) AS samples, count(*) FILTER (bad) AS bad, NOT bool_or(bad) AS land_free FROM ({CURVE_BAD}) x GROUP BY mmsi", track_queries.SEQ, track_queries.JOURNEYS, track_queries.SPLINE, REAL_ASHORE))
def _curve(fix, positions, vessel, spark):
    """Of each vessel's curve, whether all that is on land is near a real fix that is on land itself."""
    p = track_queries.points(fix)
    curve = tracks.spline(tracks.journeys(p)).select("mmsi", (F.col("id") * 100 + F.col("i")).alias("id"), "lat", "lon")
    shore = routing.Land([function_queries.RING])
    return listings.curve_land_free(curve, p.filter("not fake"), lambda lat, lon: routing.is_land(lat, lon, shore))


COURSE = sql.degrees(sql.bearing("lat0", "lon0", "lat", "lon"))


@query("marker_heading", sql.over(f"""SELECT event_id, mmsi, {sql.rounded('last_value(own IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)')} AS shown FROM
    (SELECT *, coalesce(CAST(heading AS DOUBLE), CASE WHEN speed > 5E-1 AND (lat0 <> lat OR lon0 <> lon) THEN {COURSE} END) AS own FROM ({NEXT}) n) x"""))
def _marker(fix, positions, vessel, spark):
    return listings.marker_headings(fix)


BEFORE = "LATERAL (SELECT ts, tier FROM positions p WHERE p.mmsi = i.mmsi AND p.ts <= i.t ORDER BY ts DESC, id DESC LIMIT 1) b"
AFTER = "LATERAL (SELECT ts, tier FROM positions p WHERE p.mmsi = i.mmsi AND p.ts > i.t ORDER BY ts, id LIMIT 1) a"


@query("inferred_brackets", sql.over(f"SELECT i.mmsi, i.t, b.ts AS before_t, b.tier AS before_tier, a.ts AS after_t, a.tier AS after_tier FROM inferred i LEFT JOIN {BEFORE} ON true LEFT JOIN {AFTER} ON true", view_queries.INFERRED))
def _brackets(fix, positions, vessel, spark):
    real = positions.select("mmsi", F.col("ts").alias("t"), "id", "tier", F.lit(False).alias("fake"))
    return listings.brackets(real.unionByName(view_queries.inferred(fix).select("mmsi", "t", F.lit(None).cast("bigint").alias("id"), "tier", F.lit(True).alias("fake"))))


@query("tier_widening", sql.over("SELECT mmsi, string_agg(tier, ',' ORDER BY tier) AS tiers FROM (SELECT DISTINCT mmsi, tier FROM (SELECT mmsi, tier FROM positions WHERE id % 5 = 0 UNION ALL SELECT DISTINCT mmsi, unnest(['direct', 'local']) FROM positions WHERE id % 5 = 0) u) d GROUP BY mmsi"))
def _widening(fix, positions, vessel, spark):
    return listings.widened(positions.filter("id % 5 = 0"), ("direct", "local"))


@query("vessels_json", sql.over("SELECT mmsi, CAST(to_json({'mmsi': mmsi, 'name': name, 'of_interest': of_interest, 'max_extent': max_extent, 'last_seen': last_seen}) AS VARCHAR) AS body FROM vessels"))
def _json(fix, positions, vessel, spark):
    return listings.as_json(vessel.select("mmsi", "name", "of_interest", "max_extent", "last_seen"))
