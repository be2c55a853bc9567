"""Queries of tracks, with their SQL. Folds have recursive SQL: one step a fix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import dims, geo, vessels
from tidewake.operators import polygons, routing, tracks, trails
from tidewake.plans import function_queries, sql
from tidewake.sources import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None, fast: bool = False):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(points(adapter.fixes(spark, sf_dir, fast)), spark)
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def points(fix: DataFrame) -> DataFrame:
    """Fixes as points of a track; every thirteenth counts as inferred."""
    return fix.select("mmsi", F.col("event_id").alias("id"), F.col("ts").alias("t"), "lat", "lon", "speed", "heading", "vessel_type", "length", "tier", (F.col("event_id") % 13 == 0).alias("fake"))


SEQ = "seq AS (SELECT *, event_id % 13 = 0 AS fake, row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) AS n FROM fix)"


def walk(keep: str) -> str:
    """The fold that keeps a fix `x` where a condition holds against the last kept one `o`, as a recursive table."""
    columns = "event_id, ts, lat, lon, speed, heading"
    picked = ", ".join(f"CASE WHEN take THEN x.{c} ELSE o.{c} END AS {c}" for c in columns.split(", "))
    return f"""walk AS (SELECT mmsi, n, {columns}, true AS kept FROM seq WHERE n = 1
        UNION ALL SELECT o.mmsi, x.n, {picked}, take FROM walk o JOIN seq x ON x.mmsi = o.mmsi AND x.n = o.n + 1, LATERAL (SELECT {keep} AS take) k)"""


@query("compress_replay", sql.over_fast("SELECT mmsi, count(*) AS kept, CAST(sum(event_id) AS BIGINT) AS id_sum FROM walk WHERE kept GROUP BY mmsi", SEQ, walk(sql.significant("o", "x", "x.tier"))), fast=True)
def _compress(p, spark):
    ids = tracks.compress(p)
    return ids.select("mmsi", F.size("kept").cast("bigint").alias("kept"), F.aggregate("kept", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


DEDUP = walk(f"{sql.haversine('o.lat', 'o.lon', 'x.lat', 'x.lon', 6371.0)} > 2E-2")


@query("dedup_track", sql.over("SELECT mmsi, event_id AS id FROM walk WHERE kept", SEQ, DEDUP))
def _dedup(p, spark):
    return tracks.dedup(p).select("mmsi", "id")


SIM_WALK = f"""sq AS (SELECT *, coalesce(speed, 0E0) AS sp, row_number() OVER (PARTITION BY mmsi, tier ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY mmsi, tier) AS total FROM fix),
    sw AS (SELECT mmsi, tier, k, total, 1 AS kept, ts, lat, lon, sp, CAST(NULL AS DOUBLE) AS course FROM sq WHERE k = 1
    UNION ALL SELECT s.mmsi, s.tier, x.k, s.total, s.kept + CASE WHEN take THEN 1 ELSE 0 END, CASE WHEN take THEN x.ts ELSE s.ts END, CASE WHEN take THEN x.lat ELSE s.lat END, CASE WHEN take THEN x.lon ELSE s.lon END, CASE WHEN take THEN x.sp ELSE s.sp END, CASE WHEN take THEN NULL ELSE c.ref END
    FROM sw s JOIN sq x ON x.mmsi = s.mmsi AND x.tier = s.tier AND x.k = s.k + 1 AND x.k < x.total, LATERAL (SELECT coalesce(s.course, {sql.bearing('s.lat', 's.lon', 'x.lat', 'x.lon')}) AS ref) c,
    LATERAL (SELECT x.ts - s.ts > {sql.by_tier('s.tier', {t: dims.CORRIDOR[t]['gap_ms'] for t in dims.TIERS})} OR {sql.haversine('s.lat', 's.lon', 'x.lat', 'x.lon')} > {sql.by_tier('s.tier', {t: dims.CORRIDOR[t]['gap_nm'] for t in dims.TIERS})}
        OR abs(x.sp - s.sp) > {sql.by_tier('s.tier', {t: dims.CORRIDOR[t]['speed'] for t in dims.TIERS})} OR (s.sp > 5E-1) <> (x.sp > 5E-1)
        OR abs(asin(sin({sql.haversine('s.lat', 's.lon', 'x.lat', 'x.lon')} / 3440.065E0) * sin({sql.bearing('s.lat', 's.lon', 'x.lat', 'x.lon')} - c.ref)) * 3440.065E0) > {sql.by_tier('s.tier', {t: dims.CORRIDOR[t]['corridor'] for t in dims.TIERS})} AS take) k),
    sim AS (SELECT w.mmsi, w.tier, v.vessel_type, CAST(w.total AS INT) AS n_in, CAST(CASE WHEN w.total <= 2 THEN w.total ELSE max(w.kept) + 1 END AS INT) AS n_kept FROM sw w JOIN (SELECT mmsi, any_value(vessel_type) AS vessel_type FROM fix GROUP BY mmsi) v ON v.mmsi = w.mmsi GROUP BY w.mmsi, w.tier, v.vessel_type, w.total)"""


@query("sim_compress", sql.over_fast("SELECT * FROM sim", SIM_WALK), fast=True)
def _sim(p, spark):
    return tracks.simulate(p)


TOTALS = f"count(*) AS tracks, CAST(sum(n_in) AS BIGINT) AS n_in, CAST(sum(n_kept) AS BIGINT) AS n_kept, {sql.rounded('1E2 * (1E0 - CAST(sum(n_kept) AS DOUBLE) / sum(n_in))', 4)} AS pct_dropped"


@query("sim_by_category", sql.over_fast(f"SELECT {sql.worker_class('vessel_type', 'other')} AS category, {TOTALS} FROM sim GROUP BY 1", SIM_WALK), fast=True)
def _sim_category(p, spark):
    return tracks.simulated_totals(tracks.simulate(p), vessels.simulator_class(F.col("vessel_type")), "category")


@query("sim_by_tier", sql.over_fast(f"SELECT tier, {TOTALS} FROM sim GROUP BY tier", SIM_WALK), fast=True)
def _sim_tier(p, spark):
    return tracks.simulated_totals(tracks.simulate(p), F.col("tier"), "tier")


@query("sim_total", sql.over_fast(f"SELECT coalesce(tier, 'total') AS tier, {TOTALS} FROM sim GROUP BY ROLLUP (tier)", SIM_WALK), fast=True)
def _sim_total(p, spark):
    return tracks.simulated_rollup(tracks.simulate(p))


JOURNEYS = f"""cut AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > {sql.by_tier('lag(tier) OVER w', dims.SEVER_MS)} AND coalesce(lag(speed) OVER w, 0E0) <= 5E-1 AND NOT fake AND NOT lag(fake) OVER w THEN 1 ELSE 0 END AS c FROM seq WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id)),
    journeys AS (SELECT *, CAST(sum(c) OVER (PARTITION BY mmsi ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS journey FROM cut)"""


@query("split_journeys", sql.over("SELECT mmsi, journey, count(*) AS n, min(ts) AS t_first, max(ts) AS t_last FROM journeys GROUP BY mmsi, journey", SEQ, JOURNEYS))
def _journeys(p, spark):
    return tracks.journeys(p).groupBy("mmsi", "journey").agg(F.count("*").alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))


def _blend(c: str) -> str:
    a1, a2, a3 = f"({c}0 + ({c}1 - {c}0) * u / k1)", f"({c}1 + ({c}2 - {c}1) * (u - k1) / (k2 - k1))", f"({c}2 + ({c}3 - {c}2) * (u - k2) / (k3 - k2))"
    b1, b2 = f"({a1} + ({a2} - {a1}) * u / k2)", f"({a2} + ({a3} - {a2}) * (u - k1) / (k3 - k1))"
    return f"({b1} + ({b2} - {b1}) * (u - k1) / (k2 - k1))"


KNOT = "sqrt(greatest(sqrt(pow(lat{b} - lat{a}, 2) + pow(lon{b} - lon{a}, 2)), 1E-10))"
SPLINE = f"""ctl AS (SELECT mmsi, journey, event_id, ts, fake, lat AS lat1, lon AS lon1, lag(lat) OVER w AS pa, lag(lon) OVER w AS po, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(lat, 2) OVER w AS qa, lead(lon, 2) OVER w AS qo, lead(ts) OVER w AS ts2, lead(fake) OVER w AS fake2 FROM journeys WINDOW w AS (PARTITION BY mmsi, journey ORDER BY ts, event_id)),
    piece AS (SELECT *, coalesce(pa, 2 * lat1 - lat2) AS lat0, coalesce(po, 2 * lon1 - lon2) AS lon0, coalesce(qa, 2 * lat2 - lat1) AS lat3, coalesce(qo, 2 * lon2 - lon1) AS lon3 FROM ctl WHERE lat2 IS NOT NULL),
    knots AS (SELECT *, k1 + {KNOT.format(a=1, b=2)} AS k2, k1 + {KNOT.format(a=1, b=2)} + {KNOT.format(a=2, b=3)} AS k3 FROM (SELECT *, {KNOT.format(a=0, b=1)} AS k1 FROM piece) k),
    curve AS (SELECT mmsi, journey, event_id, i, ts + (ts2 - ts) * (i / 12E0) AS t, {_blend('lat')} AS lat, {_blend('lon')} AS lon, fake OR coalesce(fake2, false) AS synthetic FROM (SELECT *, k1 + (k2 - k1) * (i / 12E0) AS u FROM knots, LATERAL (SELECT unnest(range(0, 12)) AS i)) c
        UNION ALL SELECT mmsi, journey, event_id, 0, CAST(ts AS DOUBLE), lat1, lon1, fake FROM ctl WHERE lat2 IS NULL)"""


@query("spline_samples", sql.over(f"SELECT mmsi, journey, event_id AS id, CAST(i AS INT) AS i, {sql.rounded('lat', 5)} AS lat, {sql.rounded('lon', 5)} AS lon, synthetic FROM curve", SEQ, JOURNEYS, SPLINE))
def _spline(p, spark):
    s = tracks.spline(tracks.journeys(p))
    return s.select("mmsi", "journey", "id", "i", geo.rounded(F.col("lat"), 5).alias("lat"), geo.rounded(F.col("lon"), 5).alias("lon"), "synthetic")


RUNS = """marked AS (SELECT *, CASE WHEN synthetic <> lag(synthetic) OVER w THEN 1 ELSE 0 END AS c, lead(t) OVER w AS t_next FROM curve WINDOW w AS (PARTITION BY mmsi, journey ORDER BY t, event_id, i)),
    runs AS (SELECT *, CAST(sum(c) OVER (PARTITION BY mmsi, journey ORDER BY t, event_id, i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM marked)"""


@query("spline_runs", sql.over("SELECT mmsi, journey, run, synthetic, count(*) + CASE WHEN max(t_next) IS NULL OR bool_or(t_next IS NULL) THEN 0 ELSE 1 END AS n, CAST(floor(min(t)) AS BIGINT) AS t_first, CAST(floor(coalesce(CASE WHEN bool_or(t_next IS NULL) THEN NULL ELSE max(t_next) END, max(t))) AS BIGINT) AS t_last FROM runs GROUP BY mmsi, journey, run, synthetic", SEQ, JOURNEYS, SPLINE, RUNS))
def _runs(p, spark):
    r = tracks.stretches(tracks.journeys(p))
    return r.select("mmsi", "journey", "run", "synthetic", "n", F.floor("t_first").alias("t_first"), F.floor("t_last").alias("t_last"))


@query("gap_pairs", sql.over(f"SELECT mmsi, event_id AS id, ts - lag(ts) OVER w AS gap_ms, {sql.rounded(sql.haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon', 6371.0))} AS gap_km FROM fix WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id)"))
def _gaps(p, spark):
    return tracks.gaps(p).select("mmsi", "id", "gap_ms", geo.rounded(F.col("gap_km")).alias("gap_km"))


@query("track_length", sql.over(f"SELECT mmsi, {sql.rounded('sum(km)', 3)} AS km, count(*) AS n FROM (SELECT mmsi, {sql.haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon', 6371.0)} AS km FROM fix WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id)) x GROUP BY mmsi"))
def _length(p, spark):
    return tracks.length(p).select("mmsi", geo.rounded(F.col("km"), 3).alias("km"), "n")


@query("trail_heading", sql.over(f"SELECT mmsi, {sql.rounded(sql.degrees(sql.bearing('a.lat', 'a.lon', 'b.lat', 'b.lon')))} AS heading FROM (SELECT mmsi, arg_max(lat, n) AS lat, arg_max(lon, n) AS lon, max(n) AS n FROM seq GROUP BY mmsi) b JOIN LATERAL (SELECT lat, lon FROM seq s WHERE s.mmsi = b.mmsi AND s.n < b.n AND (s.lat <> b.lat OR s.lon <> b.lon) ORDER BY s.n DESC LIMIT 1) a ON true", SEQ))
def _heading(p, spark):
    return tracks.heading_from_track(p).select("mmsi", geo.rounded(F.col("heading")).alias("heading"))


@query("live_extend", sql.over("SELECT mmsi, lat, lon, ts AS t, false AS live FROM fix WHERE event_id % 10 <> 0 UNION ALL SELECT l.mmsi, l.lat, l.lon, l.ts, true FROM latest l JOIN (SELECT mmsi, max(ts) AS m FROM fix WHERE event_id % 10 <> 0 GROUP BY mmsi) x ON x.mmsi = l.mmsi WHERE l.ts > m", sql.LATEST))
def _live(p, spark):
    last = p.groupBy("mmsi").agg(F.max_by(F.struct("lat", "lon", "t"), F.struct("t", "id")).alias("p")).select("mmsi", "p.*")
    return tracks.live_extended(p.filter("id % 10 <> 0"), last)


@query("segment_diff", sql.over("SELECT mmsi, seg, CASE WHEN h AND w THEN 'keep' WHEN h THEN 'delete' ELSE 'insert' END AS action FROM (SELECT coalesce(a.mmsi, b.mmsi) AS mmsi, coalesce(a.seg, b.seg) AS seg, a.mmsi IS NOT NULL AS h, b.mmsi IS NOT NULL AS w FROM (SELECT * FROM g WHERE id % 3 <> 0) a FULL OUTER JOIN (SELECT * FROM g WHERE id % 4 <> 0) b ON a.mmsi = b.mmsi AND a.seg = b.seg) x", "g AS (SELECT mmsi, event_id AS id, concat_ws('-', lag(ts) OVER (PARTITION BY mmsi ORDER BY ts, event_id), ts, coalesce(CAST(length AS VARCHAR), 'n'), 'v1') AS seg FROM fix)"))
def _diff(p, spark):
    """Segments to keep, insert and delete when the stored ones (have) become the computed ones (want)."""
    g = tracks.gaps(p).select("mmsi", "id", vessels.segment_key(F.col("before_t"), F.col("t"), F.col("length")).alias("seg"))
    return tracks.segment_changes(g, F.col("id") % 3 != 0, F.col("id") % 4 != 0)


def _eligible_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fix = adapter.fixes(spark, sf_dir)
    return trails.due(adapter.vessel_table(fix), fix.filter("event_id % 4 <> 0").groupBy("mmsi").agg(F.max("ts").alias("done")))


QUERIES["precompute_eligible"] = _eligible_query
ORACLE_SQL["precompute_eligible"] = sql.over("SELECT mmsi, last_pos_ts FROM vessels v LEFT JOIN (SELECT mmsi AS m, max(ts) AS done FROM fix WHERE event_id % 4 <> 0 GROUP BY mmsi) s ON s.m = v.mmsi WHERE of_interest = 1 AND first_direct_at IS NOT NULL AND last_pos_ts IS NOT NULL AND (done IS NULL OR last_pos_ts > done)")


def land() -> routing.Land:
    """The land of the function queries, as polygons of the router."""
    return routing.Land([function_queries.RING], [(function_queries.HOLE, [])])


@query("route_water", None)
def _route(p, spark):
    """All points of the ways over water across the gaps of every track."""
    return routing.water_routes(routing.land_gaps(p, land()), land(), full=True)


@query("harvest_segments", None)
def _harvest(p, spark):
    """The points that a trail needs, with what a stored segment says of itself."""
    return routing.water_routes(routing.land_gaps(p, land()), land())


@query("region_validate", sql.over("SELECT CAST(mmsi AS VARCHAR) AS region, CAST(ts // 86400000 AS INT) AS ring_id, CASE WHEN count(*) < 4 THEN 'too few points' ELSE 'off the globe' END AS problem FROM (SELECT *, lat + CASE WHEN mmsi % 29 = 0 THEN 50 ELSE 0 END AS y FROM fix) x GROUP BY 1, 2 HAVING count(*) < 4 OR bool_or(y NOT BETWEEN -90 AND 90)"))
def _validate(p, spark):
    """Each day of a track as a ring; some are moved off the globe."""
    y = F.col("lat") + F.when(F.col("mmsi") % 29 == 0, 50).otherwise(0)
    rings = p.groupBy(F.col("mmsi").cast("string").alias("region"), F.floor(F.col("t") / 86_400_000.0).cast("int").alias("ring_id")).agg(F.collect_list(F.struct(y.alias("lat"), F.col("lon").alias("lon"))).alias("ring"))
    return polygons.problems(rings)
