"""Queries of the scalar and geometric functions over all fixes, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions import dims, geo, vessels
from tidewake.plans import sql
from tidewake.plans.view_queries import HOME
from tidewake.sources import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HERE = f"{HOME[0]!r}E0", f"{HOME[1]!r}E0"
#: Fixes with the fix before.
PAIRS = "pairs AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(ts) OVER w AS ts0, lag(heading) OVER w AS heading0 FROM fix WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id))"


def query(name: str, oracle: str):
    def put(f):
        QUERIES[name], ORACLE_SQL[name] = (lambda spark, sf_dir: f(adapter.fixes(spark, sf_dir), spark)), oracle
        return f

    return put


def ends() -> list[Column]:
    """Places of the fix before and of the fix."""
    return [F.col(c) for c in S]


def pairs(fix: DataFrame) -> DataFrame:
    w = Window.partitionBy("mmsi").orderBy("ts", "event_id")
    return fix.withColumns({f"{c}0": F.lag(c).over(w) for c in ("lat", "lon", "ts", "heading")})


S = ("lat0", "lon0", "lat", "lon")


@query("tier_of", sql.over(f"SELECT event_id, {sql.tier('lat', 'lon')} AS tier FROM fix"))
def _tier(fix, spark):
    return fix.select("event_id", vessels.tier_of(F.col("lat"), F.col("lon")).alias("tier"))


@query("haversine", sql.over(f"SELECT event_id, {sql.rounded(sql.haversine(*S))} AS nm, {sql.rounded(sql.haversine(*S, radius=6371.0))} AS km FROM pairs", PAIRS))
def _haversine(fix, spark):
    return pairs(fix).select("event_id", geo.rounded(geo.haversine_nm(*ends())).alias("nm"), geo.rounded(geo.haversine_km(*ends())).alias("km"))


@query("bearing", sql.over(f"SELECT event_id, {sql.rounded(sql.degrees(sql.bearing(*S)))} AS deg FROM pairs", PAIRS))
def _bearing(fix, spark):
    return pairs(fix).select("event_id", geo.rounded(geo.bearing_deg(*ends())).alias("deg"))


TURN = "abs(heading0 - heading) % 360"


@query("heading_delta", sql.over(f"SELECT event_id, CASE WHEN {TURN} > 180 THEN 360 - {TURN} ELSE {TURN} END AS delta FROM pairs", PAIRS))
def _delta(fix, spark):
    return pairs(fix).select("event_id", geo.heading_delta(F.col("heading0"), F.col("heading")).alias("delta"))


COURSE = sql.bearing(*HERE, "lat0", "lon0")
CROSS = f"abs(asin(sin({sql.haversine(*HERE, 'lat', 'lon')} / 3440.065E0) * sin({sql.bearing(*HERE, 'lat', 'lon')} - {COURSE})) * 3440.065E0)"


@query("cross_track", sql.over(f"SELECT event_id, {sql.rounded(CROSS)} AS nm FROM pairs", PAIRS))
def _cross(fix, spark):
    a, b = F.lit(HOME[0]), F.lit(HOME[1])
    return pairs(fix).select("event_id", geo.rounded(geo.cross_track_nm(a, b, geo.bearing_rad(a, b, F.col("lat0"), F.col("lon0")), F.col("lat"), F.col("lon"))).alias("nm"))


SEGMENT = f"""SELECT event_id, {sql.rounded('sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))')} AS km FROM (SELECT *, greatest(0E0, least(1E0, coalesce(-(ax * dx + ay * dy) / nullif(dx * dx + dy * dy, 0), 0E0))) AS t
    FROM (SELECT *, bx - ax AS dx, by_ - ay AS dy FROM (SELECT event_id, (lon0 - {HERE[1]}) * k * 111.32E0 AS ax, (lat0 - {HERE[0]}) * 111.32E0 AS ay, (lon - {HERE[1]}) * k * 111.32E0 AS bx, (lat - {HERE[0]}) * 111.32E0 AS by_
    FROM (SELECT *, cos(radians({HERE[0]})) AS k FROM pairs WHERE lat0 IS NOT NULL) a) b) c) d"""


@query("point_segment", sql.over(SEGMENT, PAIRS))
def _segment(fix, spark):
    d = geo.point_segment_km(F.lit(HOME[0]), F.lit(HOME[1]), *ends())
    return pairs(fix).filter("lat0 is not null").select("event_id", geo.rounded(d).alias("km"))


@query("box_overlap", sql.over("SELECT mmsi, zone_id FROM (SELECT mmsi, min(lat) - 1E-1 AS s, min(lon) - 1E-1 AS w, max(lat) + 1E-1 AS n, max(lon) + 1E-1 AS e FROM fix GROUP BY mmsi) x JOIN zones ON s <= north AND south <= n AND w <= east AND west <= e", sql.ZONES))
def _overlap(fix, spark):
    extent = fix.groupBy("mmsi").agg((F.min("lat") - 0.1).alias("s"), (F.min("lon") - 0.1).alias("w"), (F.max("lat") + 0.1).alias("n"), (F.max("lon") + 0.1).alias("e"))
    cond = geo.boxes_overlap(*(tuple(F.col(c) for c in cs) for cs in (("s", "w", "n", "e"), ("south", "west", "north", "east"))))
    return extent.join(F.broadcast(dims.zones(spark)), cond).select("mmsi", "zone_id")


@query("extent_bbox", sql.over(f"SELECT mmsi, {sql.rounded('min(lat) - 1E-1')} AS south, {sql.rounded('min(lon) - 1E-1')} AS west, {sql.rounded('max(lat) + 1E-1')} AS north, {sql.rounded('max(lon) + 1E-1')} AS east FROM fix GROUP BY mmsi"))
def _extent(fix, spark):
    return fix.groupBy("mmsi").agg(geo.rounded(F.min("lat") - 0.1).alias("south"), geo.rounded(F.min("lon") - 0.1).alias("west"), geo.rounded(F.max("lat") + 0.1).alias("north"), geo.rounded(F.max("lon") + 0.1).alias("east"))


#: Rings of land and water (lat, lon) near the tracks; users bring their own.
RING = [(48.05, -123.65), (48.30, -123.62), (48.26, -123.30), (48.12, -123.20), (48.16, -123.45)]
HOLE = [(48.14, -123.55), (48.22, -123.55), (48.22, -123.48), (48.14, -123.48)]


def _edges(ring: list[tuple[float, float]]) -> str:
    """Number of the ring's edges that a ray to the east crosses."""
    out = []
    for (ya, xa), (yb, xb) in zip(ring, [ring[-1], *ring[:-1]]):
        out.append(f"CASE WHEN ({ya!r}E0 > lat) <> ({yb!r}E0 > lat) AND lon < ({xb!r}E0 - ({xa!r}E0)) * ((lat - {ya!r}E0) / ({yb!r}E0 - {ya!r}E0)) + ({xa!r}E0) THEN 1 ELSE 0 END")
    return "(" + " + ".join(out) + ") % 2 = 1"


def ring(points: list[tuple[float, float]]):
    return F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in points])


@query("pip_sql", sql.over(f"SELECT event_id, {_edges(RING)} AS inside FROM fix"))
def _pip(fix, spark):
    return fix.select("event_id", geo.in_ring(F.col("lat"), F.col("lon"), ring(RING)).alias("inside"))


@query("water_with_holes", sql.over(f"SELECT event_id, ({_edges(RING)}) AND NOT ({_edges(HOLE)}) AS water FROM fix"))
def _water(fix, spark):
    return fix.select("event_id", geo.in_water(F.col("lat"), F.col("lon"), ring(RING), F.array(ring(HOLE))).alias("water"))


#: Samples along the straight line from one fix to the next, at most 1 km apart.
SAMPLED = f"""WITH RECURSIVE {sql.fixes()}, {PAIRS}, legs AS (SELECT event_id, mmsi, lat0, lon0, lat, lon, km, CAST(greatest(2, ceil(km)) AS INT) AS n FROM (SELECT *, {sql.haversine(*S, radius=6371.0)} AS km FROM pairs WHERE lat0 IS NOT NULL) a WHERE km < 400),
    points AS (SELECT event_id, mmsi, km, lat0 + (lat - lat0) * (CAST(i AS DOUBLE) / n) AS lat, lon0 + (lon - lon0) * (CAST(i AS DOUBLE) / n) AS lon FROM legs, LATERAL (SELECT unnest(range(0, n + 1)) AS i)),
    crossed AS (SELECT event_id, mmsi, any_value(km) AS km, bool_or({_edges(RING)}) AS crosses FROM points GROUP BY event_id, mmsi)\n"""


def crossings(fix: DataFrame) -> DataFrame:
    """Each leg of a track, and whether one of its samples lies on land."""
    legs = pairs(fix).filter("lat0 is not null").withColumn("km", geo.haversine_km(*ends())).filter("km < 400").withColumn("n", F.greatest(F.lit(2), F.ceil("km")).cast("int"))
    at = F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i")
    points = legs.select("event_id", "mmsi", "km", *S, "n", at).withColumn("f", F.col("i").cast("double") / F.col("n"))
    land = geo.in_ring(F.col("lat0") + (F.col("lat") - F.col("lat0")) * F.col("f"), F.col("lon0") + (F.col("lon") - F.col("lon0")) * F.col("f"), ring(RING))
    return points.groupBy("event_id", "mmsi", "km").agg(F.max(land).alias("crosses"))


@query("crosses_land_sampled", SAMPLED + "SELECT event_id, crosses FROM crossed")
def _crosses(fix, spark):
    return crossings(fix).select("event_id", "crosses")


@query("gap_score", SAMPLED + f"SELECT mmsi, {sql.rounded('sum(km)', 3)} AS km FROM crossed WHERE crosses GROUP BY mmsi")
def _score(fix, spark):
    return crossings(fix).filter("crosses").groupBy("mmsi").agg(geo.rounded(F.sum("km"), 3).alias("km"))


@query("heartbeat_interval", sql.over(f"SELECT event_id, CAST(CASE WHEN {sql.NOW} - ts > 21600000 THEN 3600000 WHEN {sql.NOW} - ts > 3600000 THEN 1800000 ELSE 600000 END AS BIGINT) AS ms FROM fix"))
def _heartbeat(fix, spark):
    return fix.select("event_id", vessels.heartbeat_ms(F.col("ts"), F.lit(adapter.NOW_MS)).alias("ms"))


@query("narrow_weight", sql.over(f"SELECT event_id, {sql.rounded('CASE WHEN length IS NULL THEN 3E0 WHEN length <= 20 THEN 5E-1 WHEN length >= 120 THEN 7E0 ELSE (length - 2E1) / 1E2 * 65E-1 + 5E-1 END')} AS weight FROM fix"))
def _narrow(fix, spark):
    return fix.select("event_id", geo.rounded(vessels.channel_weight(F.col("length"))).alias("weight"))


AGE = f"({sql.NOW} - ts)"


@query("fade", sql.over(f"SELECT event_id, {sql.rounded(f'''greatest(3E-1, greatest(0E0, 1E0 - {AGE} / CASE WHEN tier = 'global' THEN 864E5 ELSE 72E5 END))''')} AS fade, CASE WHEN s < 60 THEN concat(s, 's ago') WHEN s < 3600 THEN concat(s // 60, 'm ago') ELSE concat(s // 3600, 'h ago') END AS age FROM (SELECT *, CAST(floor({AGE} / 1E3) AS BIGINT) AS s FROM fix) x"))
def _fade(fix, spark):
    age = F.lit(adapter.NOW_MS) - F.col("ts")
    return fix.select("event_id", geo.rounded(vessels.marker_fade(age, F.col("tier"))).alias("fade"), vessels.age_label(age).alias("age"))


@query("vessel_status_window", sql.over("SELECT event_id, CASE WHEN speed >= 15E-1 THEN 'moving' ELSE 'stopped' END AS status, coalesce(speed > 5E-1, false) AS moving FROM fix"))
def _status(fix, spark):
    return fix.select("event_id", vessels.status(F.col("speed")).alias("status"), vessels.is_moving(F.col("speed")).alias("moving"))


@query("cron_partition", sql.over("SELECT event_id, m AS minute, CASE WHEN m = 50 THEN 'global' WHEN m <= 48 AND m % 2 = 0 THEN 'direct' WHEN m <= 49 AND m % 4 = 1 THEN 'local' WHEN m <= 49 AND m % 4 = 3 THEN 'foreign' END AS kind FROM (SELECT event_id, ts // 60000 % 60 AS m FROM fix) x"))
def _cron(fix, spark):
    m = F.expr("ts div 60000 % 60")
    return fix.select("event_id", m.alias("minute"), vessels.scan_kind(m).alias("kind"))


@query("tier_for_gap", sql.over("SELECT event_id, CASE greatest(CASE coalesce(t0, 'local') WHEN 'direct' THEN 0 WHEN 'local' THEN 1 ELSE 2 END, CASE tier WHEN 'direct' THEN 0 WHEN 'local' THEN 1 ELSE 2 END) WHEN 0 THEN 'direct' WHEN 1 THEN 'local' ELSE 'global' END AS tier, concat_ws('-', ts0, ts, coalesce(CAST(length AS VARCHAR), 'n'), 'v1') AS segment FROM (SELECT *, lag(tier) OVER (PARTITION BY mmsi ORDER BY ts, event_id) AS t0 FROM pairs) x", PAIRS))
def _gap_tier(fix, spark):
    p = pairs(fix).withColumn("t0", F.coalesce(F.lag("tier").over(Window.partitionBy("mmsi").orderBy("ts", "event_id")), F.lit("local")))
    return p.select("event_id", vessels.wider(F.col("t0"), F.col("tier")).alias("tier"), vessels.segment_key(F.col("ts0"), F.col("ts"), F.col("length")).alias("segment"))


@query("visible_sector", sql.over(f"SELECT event_id, {sql.rounded('b')} AS bearing, km <= 30 AND NOT (b BETWEEN 0 AND 141.07E0 OR b BETWEEN 153.66E0 AND 162.38E0 OR b BETWEEN 183.26E0 AND 204.86E0) AS visible FROM (SELECT event_id, {sql.degrees(sql.bearing(*HERE, 'lat', 'lon'))} AS b, {sql.haversine(*HERE, 'lat', 'lon', radius=6371.0)} AS km FROM fix) x"))
def _visible(fix, spark):
    """Within 30 km of home and in none of the sectors that hills hide."""
    b = F.col("b")
    hidden = b.between(0, 141.07) | b.between(153.66, 162.38) | b.between(183.26, 204.86)
    p = fix.select("event_id", geo.bearing_deg(F.lit(HOME[0]), F.lit(HOME[1]), F.col("lat"), F.col("lon")).alias("b"), geo.haversine_km(F.lit(HOME[0]), F.lit(HOME[1]), F.col("lat"), F.col("lon")).alias("km"))
    return p.select("event_id", geo.rounded(b).alias("bearing"), ((F.col("km") <= 30) & ~hidden).alias("visible"))


@query("region_derive", sql.over(f"SELECT zone_id, count(*) AS fixes, {sql.rounded('min(lat) - 2E-1', 4)} AS south, {sql.rounded('min(lon) - 2E-1', 4)} AS west, {sql.rounded('max(lat) + 2E-1', 4)} AS north, {sql.rounded('max(lon) + 2E-1', 4)} AS east FROM zone_fix GROUP BY zone_id", sql.ZONES, sql.ZONE_FIX))
def _regions(fix, spark):
    from tidewake.operators.views import zone_of

    z = zone_of(fix.select("event_id", "lat", "lon"), dims.zones(spark))
    return z.groupBy("zone_id").agg(F.count("*").alias("fixes"), geo.rounded(F.min("lat") - 0.2, 4).alias("south"), geo.rounded(F.min("lon") - 0.2, 4).alias("west"), geo.rounded(F.max("lat") + 0.2, 4).alias("north"), geo.rounded(F.max("lon") + 0.2, 4).alias("east"))
