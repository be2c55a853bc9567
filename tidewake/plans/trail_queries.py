"""Queries of the trail job and of land, with their SQL where routes over water have no part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import dims, geo, vessels
from tidewake.operators import polygons, quality, routing, tracks, trails
from tidewake.plans import function_queries, sql, track_queries
from tidewake.plans.function_queries import HOLE, RING, _edges
from tidewake.plans.track_queries import DEDUP, JOURNEYS, RUNS, SEQ, SPLINE, land
from tidewake.sources import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (points of tracks, vessels, session) under a name."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            fix = adapter.fixes(spark, sf_dir)
            return f(track_queries.points(fix), adapter.vessel_table(fix), spark)

        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


ON_LAND = f"(({_edges(RING)}) AND NOT ({_edges(HOLE)}))"
#: A coarse coast, a region with fine land and water of its own, and one with water only; users bring their own.
COARSE = [(47.9, -123.9), (49.3, -123.8), (49.2, -123.1), (48.0, -123.1)]
FINE = routing.Region((48.9, -124.0, 49.1, -123.7), [[(48.95, -123.95), (49.08, -123.92), (49.05, -123.75), (48.96, -123.78)]], [([(49.0, -123.9), (49.04, -123.9), (49.04, -123.85), (49.0, -123.85)], [])])
WET = routing.Region((48.0, -123.8, 48.5, -123.2), [], [([(48.32, -123.55), (48.4, -123.55), (48.4, -123.3), (48.32, -123.3)], [])])
INLAND, COASTAL = f"({_edges(FINE.land[0])} OR {_edges(RING)}) AND NOT ({_edges(FINE.water[0][0])} OR {_edges(HOLE)})", f"({_edges(RING)} OR {_edges(COARSE)}) AND NOT ({_edges(HOLE)} OR ({sql.box('lat', 'lon', WET.box)} AND {_edges(WET.water[0][0])}))"


@query("region_land", sql.over(f"SELECT event_id AS id, CASE WHEN {sql.box('lat', 'lon', FINE.box)} THEN {INLAND} ELSE {COASTAL} END AS land FROM fix"))
def _region_land(p, vessel, spark):
    shore = routing.RegionLand([RING], [(HOLE, [])], [COARSE], [FINE, WET])
    return p.select("id", routing.is_land(F.col("lat"), F.col("lon"), shore).alias("land"))


def _rings_out(step: float, most: float, places: int) -> str:
    """Places on rings around the fixes on land, in water."""
    k = f"{step!r}E0 * k"
    at = f"SELECT event_id, k, a, y + {k} / 11132E-2 * sin(a / {places}E0 * 2 * pi()) AS lat, x + {k} / (11132E-2 * cos(radians(y))) * cos(a / {places}E0 * 2 * pi()) AS lon FROM ashore, LATERAL (SELECT unnest(range(1, {round(most / step) + 1})) AS k) r, LATERAL (SELECT unnest(range(0, {places})) AS a) s"
    return f"SELECT event_id, min(k * 100 + a) AS first FROM ({at}) x WHERE NOT {ON_LAND} GROUP BY event_id"


ASHORE = f"ashore AS (SELECT event_id, lat AS y, lon AS x FROM fix WHERE {ON_LAND})"
OUT = "(1E-1 * (w.first // 100) + 2E-1)"


@query("land_depth", sql.over(f"SELECT s.event_id AS id, {sql.rounded('coalesce(5E-2 * (d.first // 100), 2E0)')} AS depth_km FROM ashore s LEFT JOIN ({_rings_out(*trails.DEPTH_RINGS)}) d ON d.event_id = s.event_id", ASHORE))
def _depth(p, vessel, spark):
    shore = land()
    ashore = p.filter(routing.is_land(F.col("lat"), F.col("lon"), shore))
    return ashore.select("id", geo.rounded(trails.depth_km(F.col("lat"), F.col("lon"), shore)).alias("depth_km"))


@query("nearest_water", sql.over(f"SELECT s.event_id AS id, {sql.rounded(f'y + {OUT} / 11132E-2 * sin(w.first % 100 / 24E0 * 2 * pi())', 5)} AS lat, {sql.rounded(f'x + {OUT} / (11132E-2 * cos(radians(y))) * cos(w.first % 100 / 24E0 * 2 * pi())', 5)} AS lon FROM ashore s JOIN ({_rings_out(*trails.WATER_RINGS)}) w ON w.event_id = s.event_id", ASHORE))
def _nearest(p, vessel, spark):
    shore = land()
    ashore = p.filter(routing.is_land(F.col("lat"), F.col("lon"), shore))
    found = ashore.select("id", trails.nearest_water(F.col("lat"), F.col("lon"), shore).alias("w")).filter("w is not null")
    return found.select("id", geo.rounded(F.col("w.lat"), 5).alias("lat"), geo.rounded(F.col("w.lon"), 5).alias("lon"))


CORNERS = "diamond AS (SELECT zone_id, unnest([south, (south + north) / 2, north, (south + north) / 2]) AS ya, unnest([(west + east) / 2, east, (west + east) / 2, west]) AS xa, unnest([(south + north) / 2, south, (south + north) / 2, north]) AS yb, unnest([west, (west + east) / 2, east, (west + east) / 2]) AS xb FROM zones)"


@query("fixes_in_polygons", sql.over("SELECT event_id AS id, zone_id AS region FROM fix JOIN diamond ON (ya > lat) <> (yb > lat) AND lon < (xb - xa) * ((lat - ya) / (yb - ya)) + xa GROUP BY event_id, zone_id HAVING count(*) % 2 = 1", sql.ZONES, CORNERS))
def _polygons(p, vessel, spark):
    """Fixes in the diamond that touches the middles of a zone's sides."""
    y, x = (F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2
    corner = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    ring = F.array(corner(F.col("south"), x), corner(y, F.col("east")), corner(F.col("north"), x), corner(y, F.col("west")))
    rings = dims.zones(spark).select(F.col("zone_id").alias("region"), F.lit(0).alias("ring_id"), ring.alias("ring"))
    return trails.in_polygons(p.select("id", "lat", "lon"), rings).select("id", "region")


@query("coast_detail", sql.over(f"SELECT event_id AS id, CASE WHEN {' OR '.join(sql.box('lat', 'lon', b) for b in polygons.FINE_BOXES)} OR km <= 60 THEN 25E-3 WHEN km <= 160 THEN 12E-2 WHEN km <= 2600 THEN 3E-1 ELSE 6E-1 END AS thin_km, CASE WHEN {' OR '.join(sql.box('lat', 'lon', b) for b in polygons.FINE_BOXES)} OR km <= 60 THEN 5E-2 WHEN km <= 160 THEN 3E-1 WHEN km <= 2600 THEN 1E0 ELSE 2E0 END AS drop_km FROM (SELECT *, {sql.haversine('4842990E-5', '-12336220E-5', 'lat', 'lon', 6371.0)} AS km FROM fix) x"))
def _detail(p, vessel, spark):
    """How much detail of the coast is kept at each fix."""
    d = polygons.detail(F.col("lat"), F.col("lon"))
    return p.select("id", d["thin_km"].alias("thin_km"), d["drop_km"].alias("drop_km"))


KEPT = "kept AS (SELECT s.* FROM seq s JOIN walk w ON w.mmsi = s.mmsi AND w.n = s.n WHERE w.kept)"
KEPT_JOURNEYS = JOURNEYS.replace("FROM seq", "FROM kept")
SHOWN = "SELECT mmsi, journey, run, synthetic, count(*) + CASE WHEN max(t_next) IS NULL OR bool_or(t_next IS NULL) THEN 0 ELSE 1 END AS n, CAST(floor(min(t)) AS BIGINT) AS t_first, CAST(floor(coalesce(CASE WHEN bool_or(t_next IS NULL) THEN NULL ELSE max(t_next) END, max(t))) AS BIGINT) AS t_last FROM runs GROUP BY mmsi, journey, run, synthetic"


def _shown(runs: DataFrame) -> DataFrame:
    return runs.select("mmsi", "journey", "run", "synthetic", "n", F.floor("t_first").alias("t_first"), F.floor("t_last").alias("t_last"))


@query("client_runs", sql.over(SHOWN, SEQ, DEDUP, KEPT, KEPT_JOURNEYS, SPLINE, RUNS))
def _client(p, vessel, spark):
    """What a map draws of fixes and inferred points: less those that hardly move, by journeys, as stretches."""
    return _shown(tracks.stretches(tracks.journeys(tracks.dedup(p))))


def _pass(k: int) -> str:
    """One pass of smoothing, as d{k} from d{k-1}."""
    near = ", ".join(f"{f}({c}) OVER w AS {c}_{f}" for c in ("lat", "lon") for f in ("lag", "lead"))
    legs = "lon - lon_lag AS ax, lat - lat_lag AS ay, lon_lead - lon AS bx, lat_lead - lat AS by_"
    pull = "2E-1 * greatest(0E0, coalesce((ax * bx + ay * by_) / nullif(sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_), 0), 0E0))"
    to = ", ".join(f"CASE WHEN lat_lag IS NULL OR lat_lead IS NULL THEN {c} ELSE {c} + pull * (({c}_lag + {c}_lead) / 2 - {c}) END AS {c}" for c in ("lat", "lon"))
    return f"""d{k} AS (SELECT mmsi, journey, event_id, ts, fake, CASE WHEN land THEN y ELSE lat END AS lat, CASE WHEN land THEN x ELSE lon END AS lon FROM (SELECT *, {ON_LAND} AS land FROM (
        SELECT mmsi, journey, event_id, ts, fake, lat AS y, lon AS x, {to} FROM (SELECT *, {pull} AS pull FROM (SELECT *, {legs} FROM (SELECT *, {near} FROM d{k - 1} WINDOW w AS (PARTITION BY mmsi, journey ORDER BY ts, event_id)) a) b) c) d) e)"""


SMOOTHED = (SEQ, JOURNEYS, "d0 AS (SELECT mmsi, journey, event_id, ts, fake, lat, lon FROM journeys)", _pass(1), _pass(2))


@query("smooth_track", sql.over(f"SELECT mmsi, journey, event_id AS id, ts AS t, {sql.rounded('lat')} AS lat, {sql.rounded('lon')} AS lon FROM d2", *SMOOTHED))
def _smooth(p, vessel, spark):
    shore = land()
    d = tracks.denoised(tracks.journeys(p), lambda lat, lon: routing.is_land(lat, lon, shore))
    return d.select("mmsi", "journey", "id", "t", geo.rounded(F.col("lat")).alias("lat"), geo.rounded(F.col("lon")).alias("lon"))


#: An island that lies between two fixes of some tracks, so that trails have to go around it.
ISLAND = [(48.058, -123.50), (48.062, -123.50), (48.062, -123.45), (48.058, -123.45)]


def shore() -> routing.Land:
    return routing.Land([RING, ISLAND], [(HOLE, [])])


@query("trail_runs")
def _trail(p, vessel, spark):
    """Stretches of real and inferred curve of all trails, over water and repaired."""
    return _shown(trails.runs_of(p.withColumn("fake", F.lit(False)), shore()))


def _middle(g: DataFrame, east: float) -> DataFrame:
    """A stored point for each gap: its middle, moved to the east."""
    middle = lambda c: (F.col(c) + F.col(f"before_{c}")) / 2
    return g.select("mmsi", "segment", F.lit(0).alias("seq"), ((F.col("t") + F.col("before_t")) / 2).alias("t"), middle("lat").alias("lat"), (middle("lon") + east).alias("lon"), "tier")


def _segments(p: DataFrame) -> DataFrame:
    g = tracks.gaps(p).filter("before_t is not null")
    return g.withColumn("segment", vessels.segment_key(F.col("before_t"), F.col("t"), F.col("length")))


GAPS = "g AS (SELECT *, concat_ws('-', t0, ts, coalesce(CAST(length AS VARCHAR), 'n'), 'v1') AS segment, (lat + lat0) / 2 AS y, (lon + lon0) / 2 AS x FROM (SELECT *, lag(ts) OVER w AS t0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM fix WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id)) a WHERE t0 IS NOT NULL)"


@query("store_apply", sql.over(f"SELECT mmsi, segment, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS INT) AS version, {sql.rounded('y')} AS lat, {sql.rounded('CASE WHEN event_id % 3 = 0 THEN x + 1E-3 ELSE x END')} AS lon FROM g WHERE event_id % 4 <> 0", GAPS))
def _store(p, vessel, spark):
    """The stored points after segments went that no longer hold and others came; those that stay keep their points."""
    g = _segments(p)
    have, want, key = _middle(g.filter("id % 3 <> 0"), 0.0), _middle(g.filter("id % 4 <> 0"), 1e-3), ["mmsi", "segment"]
    old, new = have.withColumn("version", F.lit(1)), want.join(have, key, "left_anti").withColumn("version", F.lit(0))
    after = trails.applied(old, have.join(want, key, "left_anti"), new)
    return after.select("mmsi", "segment", "version", geo.rounded(F.col("lat")).alias("lat"), geo.rounded(F.col("lon")).alias("lon"))


@query("trail_job")
def _job(p, vessel, spark):
    """What the trail job deletes, inserts and notes, for a store with a point in each third gap that is current for some vessels."""
    p = p.withColumn("fake", F.lit(False))
    stored = _middle(_segments(p).filter("id % 3 = 0"), 0.0)
    state = p.filter("mmsi % 3 = 0").groupBy("mmsi").agg(F.max("t").alias("done"))
    made = trails.job(p, vessel, stored, state, shore())
    changes = [d.withColumn("action", F.lit(a)) for a, d in (("insert", made.insert.drop("t")), ("delete", made.delete), ("state", made.state))]
    return changes[0].unionByName(changes[1], allowMissingColumns=True).unionByName(changes[2], allowMissingColumns=True)


#: Inferred points that lie off the track, so that curves turn sharply far from any real fix.
ASTRAY = "lat + CASE WHEN event_id % 13 = 0 THEN 8E-2 ELSE 0E0 END"
SEQ_ASTRAY = SEQ.replace("SELECT *,", f"SELECT * REPLACE ({ASTRAY} AS lat),")
TURNED = "CASE WHEN d > 180 THEN 360 - d ELSE d END"
QUALITY = (
    f"""turns AS (SELECT mmsi, journey, event_id, i, lat, lon, {TURNED} AS turn FROM (SELECT *, abs({sql.degrees(sql.bearing('lat', 'lon', 'y2', 'x2'))} - {sql.degrees(sql.bearing('y0', 'x0', 'lat', 'lon'))}) % 360 AS d FROM
        (SELECT *, lag(lat) OVER w AS y0, lag(lon) OVER w AS x0, lead(lat) OVER w AS y2, lead(lon) OVER w AS x2 FROM curve WINDOW w AS (PARTITION BY mmsi, journey ORDER BY t, event_id, i)) n WHERE y0 IS NOT NULL AND y2 IS NOT NULL) a)""",
    f"far AS (SELECT mmsi, turn FROM turns s WHERE turn >= 60 AND NOT EXISTS (SELECT 1 FROM journeys r WHERE r.mmsi = s.mmsi AND r.journey = s.journey AND NOT r.fake AND {sql.haversine('r.lat', 'r.lon', 's.lat', 's.lon', 6371.0)} <= 2))",
    "legs AS (SELECT *, cos(radians((lat1 + lat2) / 2)) * 111.32E0 AS kx FROM ctl WHERE lat2 IS NOT NULL)",
    """away AS (SELECT mmsi, journey, event_id, i, min(sqrt(pow(px - (ax + t * dx), 2) + pow(py - (ay + t * dy), 2))) AS km FROM (SELECT *, greatest(0E0, least(1E0, coalesce(((px - ax) * dx + (py - ay) * dy) / nullif(dx * dx + dy * dy, 0), 0E0))) AS t
        FROM (SELECT c.mmsi, c.journey, c.event_id, c.i, c.lat * 111.32E0 AS py, c.lon * kx AS px, lat1 * 111.32E0 AS ay, lon1 * kx AS ax, (lat2 - lat1) * 111.32E0 AS dy, (lon2 - lon1) * kx AS dx FROM curve c JOIN legs l ON l.mmsi = c.mmsi AND l.journey = c.journey) a) b GROUP BY ALL)""",
)


@query("curve_quality", sql.over(f"""SELECT mmsi, samples, coalesce(kinks, 0) AS kinks, {sql.rounded('coalesce(turn, 0E0)', 4)} AS max_far_turn, {sql.rounded('coalesce(km, 0E0)')} AS max_overshoot_km FROM (SELECT mmsi, count(*) AS samples FROM curve GROUP BY mmsi)
    LEFT JOIN (SELECT mmsi, count(*) AS kinks, max(turn) AS turn FROM far GROUP BY mmsi) USING (mmsi) LEFT JOIN (SELECT mmsi, max(km) AS km FROM away GROUP BY mmsi) USING (mmsi)""", SEQ_ASTRAY, JOURNEYS, SPLINE, *QUALITY))
def _quality(p, vessel, spark):
    """Sharp turns far from real fixes, and how far a curve strays from the lines between its control points."""
    track = tracks.journeys(p.withColumn("lat", F.col("lat") + F.when(F.col("fake"), 8e-2).otherwise(0.0)))
    out = quality.report(tracks.spline(track), track)
    return out.select("mmsi", "samples", "kinks", geo.rounded(F.col("max_far_turn"), 4).alias("max_far_turn"), geo.rounded(F.col("max_overshoot_km")).alias("max_overshoot_km"))
