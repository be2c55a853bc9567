"""Queries on coasts that are made of tracks: pieces of chains in boxes, rings of arcs, tiles, regions; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions import dims, geo
from tidewake.operators import coast, polygons, views
from tidewake.plans import sql
from tidewake.sources import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str):
    """Registers a function of (fixes, session) under a name."""

    def put(f):
        QUERIES[name], ORACLE_SQL[name] = (lambda spark, sf_dir: f(adapter.fixes(spark, sf_dir), spark)), oracle
        return f

    return put


#: Boxes that the tracks come into and go out of: south, west, north, east.
BOXES = [("a", 48.12, -123.62, 48.30, -123.35), ("b", 49.1, -123.9, 49.4, -123.2), ("c", 48.06, -123.5, 48.09, -123.3), ("d", 33.65, -118.3, 33.75, -118.2)]
#: A track that goes to and fro, so that it has several pieces in a box.
WIGGLE = "lat + CASE WHEN seq % 7 < 3 THEN 5E-2 ELSE 0E0 END"


def _boxes(spark: SparkSession, rows=BOXES) -> DataFrame:
    return spark.createDataFrame(rows, "box string, south double, west double, north double, east double")


def _values(rows) -> str:
    return "boxes(box, south, west, north, east) AS (VALUES " + ", ".join(f"('{b[0]}', " + ", ".join(f"{x!r}E0" for x in b[1:]) + ")" for b in rows) + ")"


def _crossing(n: str, a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    """Valid shares of the way to each edge, as columns n1 .. n4, and the place of the first."""
    (y0, x0), (y1, x1) = a, b
    at = [f"(west - {x0}) / nullif({x1} - {x0}, 0)", f"(east - {x0}) / nullif({x1} - {x0}, 0)", f"(south - {y0}) / nullif({y1} - {y0}, 0)", f"(north - {y0}) / nullif({y1} - {y0}, 0)"]
    y, x = (lambda t: f"{y0} + ({y1} - {y0}) * ({t})"), (lambda t: f"{x0} + ({x1} - {x0}) * ({t})")
    near = [f"{y(t)} BETWEEN south - 1E-9 AND north + 1E-9" for t in at[:2]] + [f"{x(t)} BETWEEN west - 1E-9 AND east + 1E-9" for t in at[2:]]
    columns = ", ".join(f"CASE WHEN {t} > 0 AND {t} <= 1 AND {ok} THEN {t} END AS {n}{k + 1}" for k, (t, ok) in enumerate(zip(at, near)))
    first = f"least({n}1, {n}2, {n}3, {n}4)"
    pick = lambda v: "CASE " + " ".join(f"WHEN {n}{k + 1} = {first} THEN {e}" for k, e in enumerate(v)) + " END"
    lat, lon = pick([y(f"{n}1"), y(f"{n}2"), "south", "north"]), pick(["west", "east", x(f"{n}3"), x(f"{n}4")])
    return columns, f"{lat} AS lat, {lon} AS lon"


COME, CAME = _crossing("c", ("lat0", "lon0"), ("lat", "lon"))
GO, WENT = _crossing("g", ("lat", "lon"), ("lat2", "lon2"))
INSIDE = "BETWEEN south AND north AND {} BETWEEN west AND east"
PIECES = (
    _values(BOXES),
    f"walk AS (SELECT mmsi AS chain, seq, {WIGGLE} AS lat, lon FROM fix)",
    "steps AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM walk WINDOW w AS (PARTITION BY chain ORDER BY seq))",
    f"""met AS (SELECT *, lat0 IS NULL OR NOT (lat0 {INSIDE.format('lon0')}) AS comes, lat2 IS NULL OR NOT (lat2 {INSIDE.format('lon2')}) AS goes FROM steps JOIN boxes ON lat {INSIDE.format('lon')})""",
    f"cut AS (SELECT *, sum(CASE WHEN comes THEN 1 ELSE 0 END) OVER (PARTITION BY chain, box ORDER BY seq) AS piece, {COME}, {GO} FROM met)",
    f"""points AS (SELECT chain, box, piece, seq * 3 + 1 AS k, lat, lon FROM cut
        UNION ALL SELECT * FROM (SELECT chain, box, piece, seq * 3 AS k, {CAME} FROM cut WHERE comes AND lat0 IS NOT NULL) WHERE lat IS NOT NULL
        UNION ALL SELECT * FROM (SELECT chain, box, piece, seq * 3 + 2 AS k, {WENT} FROM cut WHERE goes AND lat2 IS NOT NULL) WHERE lat IS NOT NULL)""",
    "pieces AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY chain, box, piece) AS n FROM points) WHERE n > 1)",
)


def _pieces(fix: DataFrame, spark: SparkSession) -> DataFrame:
    chains = fix.select(F.lit("all").alias("region"), F.col("mmsi").alias("chain"), "seq", F.expr(WIGGLE).alias("lat"), "lon")
    return coast.clipped_chains(chains, _boxes(spark))


def _five(c: str | Column, places: int = 6) -> Column:
    return geo.rounded(F.col(c) if isinstance(c, str) else c, places)


@query("chain_pieces", sql.over(f"SELECT chain, box, CAST(piece AS BIGINT) AS piece, k, {sql.rounded('lat')} AS lat, {sql.rounded('lon')} AS lon FROM pieces", *PIECES))
def _chain_pieces(fix, spark):
    return _pieces(fix, spark).select("chain", "box", F.col("piece").cast("bigint").alias("piece"), "k", _five("lat").alias("lat"), _five("lon").alias("lon"))


PERIMETER = "CASE WHEN abs({0} - south) < 1E-6 THEN {1} - west WHEN abs({1} - east) < 1E-6 THEN (east - west) + ({0} - south) WHEN abs({0} - north) < 1E-6 THEN (east - west) + (north - south) + (east - {1}) ELSE 2 * (east - west) + (north - south) + (north - {0}) END"
RINGS = (
    "ends AS (SELECT chain, box, piece, arg_min(lat, k) AS lat0, arg_min(lon, k) AS lon0, arg_max(lat, k) AS lat1, arg_max(lon, k) AS lon1 FROM pieces GROUP BY ALL)",
    f"placed AS (SELECT *, 2 * (east - west) + 2 * (north - south) AS around, {PERIMETER.format('lat0', 'lon0')} AS enters, {PERIMETER.format('lat1', 'lon1')} AS leaves FROM ends JOIN boxes USING (box))",
    """corners AS (SELECT chain, box, piece, CASE WHEN p < leaves THEN p + around ELSE p END AS pos, y, x, leaves, CASE WHEN enters <= leaves THEN enters + around ELSE enters END AS until FROM
        (SELECT *, 0E0 AS p, south AS y, west AS x FROM placed UNION ALL SELECT *, east - west, south, east FROM placed UNION ALL SELECT *, (east - west) + (north - south), north, east FROM placed UNION ALL SELECT *, 2 * (east - west) + (north - south), north, west FROM placed) c)""",
    """ring AS (SELECT chain, box, piece, 0 AS part, CAST(k AS DOUBLE) AS k, lat, lon FROM pieces UNION ALL SELECT chain, box, piece, 1, pos - leaves, y, x FROM corners WHERE pos > leaves AND pos < until
        UNION ALL SELECT chain, box, piece, 2, 0E0, lat0, lon0 FROM ends)""",
    "legs AS (SELECT *, lag(lat) OVER w AS y0, lag(lon) OVER w AS x0 FROM ring WINDOW w AS (PARTITION BY chain, box, piece ORDER BY part, k))",
)


@query("coast_closed", sql.over(f"SELECT chain, box, CAST(piece AS BIGINT) AS piece, count(*) AS points, {sql.rounded('abs(sum(coalesce(x0 * lat - lon * y0, 0E0))) / 2', 9)} AS area FROM legs GROUP BY ALL HAVING count(*) >= 4", *PIECES, *RINGS))
def _closed(fix, spark):
    rings = coast.closed_pieces(_pieces(fix, spark))
    return rings.select("chain", "box", F.col("piece").cast("bigint").alias("piece"), F.size("ring").cast("bigint").alias("points"), _five(coast.area(F.col("ring")), 9).alias("area"))


#: Every twelve fixes of a vessel are a ring of as many arcs, of which every other one is turned around and some are missing.
ARCS = (
    "spots AS (SELECT event_id, mmsi, CAST(seq // 12 AS BIGINT) AS part, seq, lat, lon + 1E-5 * seq AS lon FROM fix)",
    "arcs AS (SELECT *, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x, count(*) OVER (PARTITION BY mmsi, part) AS n FROM spots WINDOW w AS (PARTITION BY mmsi, part ORDER BY seq))",
)


@query("water_rings", sql.over(f"SELECT mmsi, part, min(event_id) AS ring_id, count(*) + 1 AS points, {sql.rounded('abs(sum(lon * y - x * lat)) / 2', 9)} AS area FROM arcs WHERE n >= 3 GROUP BY mmsi, part HAVING max(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) = 0", *ARCS))
def _rings(fix, spark):
    """Rings from arcs of either direction; those with an arc missing are left out."""
    w = Window.partitionBy("mmsi", "part").orderBy("seq")
    spots = fix.select("event_id", "mmsi", F.expr("seq div 12").alias("part"), "seq", F.struct("lat", (F.col("lon") + F.lit(1e-5) * F.col("seq")).alias("lon")).alias("p"))
    arcs = spots.withColumn("q", F.coalesce(F.lead("p").over(w), F.first("p").over(w))).filter("event_id % 97 <> 0")
    arcs = arcs.select("mmsi", "part", F.col("event_id").alias("arc"), F.when(F.col("event_id") % 2 == 0, F.array("q", "p")).otherwise(F.array("p", "q")).alias("line"))
    rings = coast.rings_of_arcs(arcs, ("mmsi", "part"))
    return rings.select("mmsi", "part", "ring_id", F.size("ring").cast("bigint").alias("points"), _five(coast.area(F.col("ring")), 9).alias("area"))


#: Land around the first place of each vessel: a rectangle of some degrees, with a point more on two sides.
LAND = "land AS (SELECT mmsi, arg_min(lat, seq) - 1E0 * (5 + mmsi % 20) AS s, arg_min(lon, seq) - 2E0 * (3 + mmsi % 9) AS w, arg_min(lat, seq) + 1E0 * (1 + mmsi % 7) AS n, arg_min(lon, seq) + 1E0 * (1 + mmsi % 11) AS e FROM fix GROUP BY mmsi)"


def _rectangle(s: Column, w: Column, n: Column, e: Column) -> Column:
    p = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    return F.array(p(s, w), p(s, (w + e) / 2), p(s, e), p(n, e), p(n, (w + e) / 2), p(n, w))


def _first(fix: DataFrame) -> DataFrame:
    return fix.groupBy("mmsi").agg(F.min_by("lat", "seq").alias("lat"), F.min_by("lon", "seq").alias("lon"))


TILES = "tiles(box, south, west, north, east) AS (VALUES " + ", ".join(f"({k}, " + ", ".join(f"{x!r}E0" for x in b) + ")" for k, b in enumerate(coast.around(coast.NEAR, coast.HOME, True) + coast.around(coast.WORLD, coast.NEAR, False))) + ")"
CUT = "least(n, north) - greatest(s, south)", "least(e, east) - greatest(w, west)"


@query("coast_tiles", sql.over(f"SELECT mmsi, box, {sql.rounded(f'({CUT[0]}) * ({CUT[1]})')} AS area FROM land JOIN tiles ON {CUT[0]} > 0 AND {CUT[1]} > 0", LAND, TILES))
def _tiles(fix, spark):
    """Area of each vessel's land in each tile of the world around home."""
    k = F.col("mmsi") % 20, F.col("mmsi") % 9, F.col("mmsi") % 7, F.col("mmsi") % 11
    lat, lon = F.col("lat"), F.col("lon")
    ring = _rectangle(lat - 1.0 * (5 + k[0]), lon - 2.0 * (3 + k[1]), lat + 1.0 * (1 + k[2]), lon + 1.0 * (1 + k[3]))
    rings = _first(fix).select(F.lit("world").alias("region"), F.col("mmsi").alias("ring_id"), ring.alias("ring"))
    parts = coast.rings_by_box(rings, coast.tiles(spark), 10.0, least=3).withColumn("area", coast.area(F.col("ring"))).filter("area > 1E-9")
    return parts.select(F.col("ring_id").alias("mmsi"), "box", _five("area").alias("area"))


#: An island of up to 50 m to 5 km at every fix, in regions that hold some of them.
ISLANDS = "isles AS (SELECT event_id, CASE WHEN mmsi % 2 = 0 THEN 'a' ELSE 'b' END AS region, lat - 1E-4 * (1 + event_id % 50) AS s, lon - 1E-4 * (1 + event_id % 50) AS w, lat + 1E-4 * (1 + event_id % 50) AS n, lon + 1E-4 * (1 + event_id % 50) AS e FROM fix)"
PARTS = f"parts AS (SELECT region, {sql.haversine('greatest(s, south)', 'greatest(w, west)', 'least(n, north)', 'least(e, east)', 6371.0)} AS span FROM isles JOIN boxes ON region = box AND {CUT[0]} >= 0 AND {CUT[1]} >= 0)"


def _stages(kind: str, least: float) -> str:
    return f"SELECT region, '{kind}' AS kind, 'given' AS stage, count(*) AS rings FROM isles GROUP BY region UNION ALL SELECT region, '{kind}', 'cut', count(*) FROM parts GROUP BY region UNION ALL SELECT region, '{kind}', 'kept', count(*) FROM parts WHERE span >= {least} GROUP BY region"


@query("region_build", sql.over(f"{_stages('land', 0.08)} UNION ALL {_stages('water', 1.0)}", _values(BOXES), ISLANDS, PARTS))
def _build(fix, spark):
    """How many islands and water bodies are left after each stage of a region's build."""
    half = F.lit(1e-4) * (1 + F.col("event_id") % 50)
    ring = _rectangle(F.col("lat") - half, F.col("lon") - half, F.col("lat") + half, F.col("lon") + half)
    rings = fix.select(F.when(F.col("mmsi") % 2 == 0, "a").otherwise("b").alias("region"), F.col("event_id").alias("ring_id"), ring.alias("ring"))
    return coast.build_counts(rings, rings, _boxes(spark))


#: The zones that a fix lies in, as boxes of those fixes.
MET_ZONES = "met_zones AS (SELECT zone_id, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM zone_fix GROUP BY zone_id)"
MERGES = {"port-angeles": "strait", "victoria-harbour": "strait", "esquimalt": "strait"}
GIVEN = {"nanaimo": (49.05, -124.1, 49.3, -123.7)}


@query("region_boxes", sql.over(f"""SELECT region, coalesce(g[1], {sql.rounded('min(south) - 2E-1', 4)}) AS south, coalesce(g[2], {sql.rounded('min(west) - 2E-1', 4)}) AS west, coalesce(g[3], {sql.rounded('max(north) + 2E-1', 4)}) AS north, coalesce(g[4], {sql.rounded('max(east) + 2E-1', 4)}) AS east
    FROM (SELECT *, CASE WHEN zone_id IN ({', '.join(map(repr, MERGES))}) THEN 'strait' ELSE zone_id END AS region, CASE WHEN zone_id = 'nanaimo' THEN [{', '.join(f'{x!r}E0' for x in GIVEN['nanaimo'])}] END AS g FROM met_zones) GROUP BY region, g
    UNION ALL SELECT * FROM (VALUES {', '.join(f"('{k}', " + ', '.join(f'{float(x)!r}E0' for x in b) + ')' for k, b in coast.CORRIDORS.items())}) c""", sql.ZONES, sql.ZONE_FIX, MET_ZONES))
def _regions(fix, spark):
    """Boxes of regions: some zones are one region, one has a given box, and corridors have no zone."""
    z = views.zone_of(fix.select("event_id", "lat", "lon"), dims.zones(spark))
    zones = z.groupBy("zone_id").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))
    return coast.derived_regions(zones, MERGES, GIVEN)


DAYS = "days AS (SELECT CASE WHEN mmsi % 3 = 0 THEN 'a' WHEN mmsi % 3 = 1 THEN 'b' ELSE 'd' END AS region, mmsi * 100000 + ts // 86400000 AS ring_id, lat, lon FROM fix)"


@query("region_problems", sql.over("""SELECT * FROM (SELECT region, ring_id, CASE WHEN count(*) < 4 THEN 'too few points' WHEN bool_or(lat NOT BETWEEN south - 5E-1 AND north + 5E-1 OR lon NOT BETWEEN west - 5E-1 AND east + 5E-1) THEN 'outside the region' END AS problem
    FROM days JOIN boxes ON region = box GROUP BY region, ring_id) WHERE problem IS NOT NULL UNION ALL SELECT box, NULL, 'no rings' FROM boxes WHERE box NOT IN (SELECT region FROM days)""", _values(BOXES), DAYS))
def _problems(fix, spark):
    """Days of vessels as rings of regions: those that are too short, or leave the region's padded box."""
    region = F.when(F.col("mmsi") % 3 == 0, "a").when(F.col("mmsi") % 3 == 1, "b").otherwise("d")
    rings = fix.groupBy(region.alias("region"), F.expr("mmsi * 100000 + ts div 86400000").alias("ring_id")).agg(F.collect_list(F.struct("lat", "lon")).alias("ring"))
    return polygons.problems(rings, _boxes(spark).withColumnRenamed("box", "region"))
