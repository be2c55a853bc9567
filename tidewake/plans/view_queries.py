"""Queries of the views and reports, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import dims, geo, vessels
from tidewake.operators import views
from tidewake.plans import sql
from tidewake.sources import adapter

HOME = (48.4284, -123.3656)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str):
    """Registers a function of (fixes, positions, vessels, session) under a name."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            fix = adapter.fixes(spark, sf_dir)
            return f(fix, adapter.positions(fix), adapter.vessel_table(fix), spark)

        QUERIES[name], ORACLE_SQL[name] = run, oracle
        return f

    return put


def inferred(fix: DataFrame) -> DataFrame:
    """Points half way between fixes of every eleventh event, as inferred positions."""
    return fix.filter("event_id % 11 = 0").select("mmsi", (F.col("lat") + 5e-4).alias("lat"), (F.col("lon") + 5e-4).alias("lon"), (F.col("ts") + 1000).alias("t"), "tier")


INFERRED = "inferred AS (SELECT mmsi, lat + 5E-4 AS lat, lon + 5E-4 AS lon, ts + 1000 AS t, tier FROM fix WHERE event_id % 11 = 0)"

CURRENT = f"""SELECT v.mmsi, name, vessel_type, length, destination, coalesce(p.lat, last_lat) AS lat, coalesce(p.lon, last_lon) AS lon, coalesce(p.speed, last_speed) AS speed,
    coalesce(p.heading, last_heading) AS heading, coalesce(p.ts, last_pos_ts) AS last_pos_ts, last_seen, max_extent, first_direct_at, direct_entry_count
    FROM vessels v LEFT JOIN latest p ON p.mmsi = v.mmsi WHERE of_interest = 1 AND first_direct_at IS NOT NULL
    AND ((max_extent = 'direct' AND last_seen >= {sql.NOW} - 21600000) OR (max_extent <> 'direct' AND last_seen >= {sql.NOW} - 259200000))"""
TRACK = """SELECT mmsi, lat, lon, speed, heading, ts AS t, tier, false AS fake FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, id DESC) AS n FROM positions {where}) p WHERE n <= {n}
    UNION ALL SELECT mmsi, lat, lon, CAST(NULL AS DOUBLE), CAST(NULL AS INT), t, tier, true FROM inferred {where}"""


@query("current", sql.over(CURRENT, sql.LATEST))
def _current(fix, positions, vessel, spark):
    return views.current(vessel, positions, adapter.NOW_MS)


@query("latest_position", sql.over("SELECT mmsi, id, lat, lon, speed, heading, ts, tier FROM latest", sql.LATEST))
def _latest(fix, positions, vessel, spark):
    return views.latest_position(positions)


@query("track_union", sql.over(TRACK.format(where="WHERE tier IN ('direct', 'local')", n=500), INFERRED))
def _track(fix, positions, vessel, spark):
    return views.track(positions, inferred(fix), ("direct", "local", "unknown"))


@query("track_top20", sql.over(TRACK.format(where="", n=20), INFERRED))
def _track_top(fix, positions, vessel, spark):
    return views.track(positions, inferred(fix), newest=20)


@query("zone_of", sql.over("SELECT event_id, mmsi, ts, lat, lon, zone_id FROM zone_fix", sql.ZONES, sql.ZONE_FIX))
def _zone_of(fix, positions, vessel, spark):
    return views.zone_of(fix.select("event_id", "mmsi", "ts", "lat", "lon"), dims.zones(spark))


@query("zone_visit_history", sql.over("SELECT * FROM visits", sql.ZONES, sql.ZONE_FIX, sql.VISITS))
def _visits(fix, positions, vessel, spark):
    return views.zone_visits(positions, dims.zones(spark))


@query("zones_rollup", sql.over("SELECT zone_id, count(*) AS vessels, max(last_ts) AS most_recent, min(first_ts) AS earliest FROM visits GROUP BY zone_id", sql.ZONES, sql.ZONE_FIX, sql.VISITS))
def _rollup(fix, positions, vessel, spark):
    return views.zones_rollup(views.zone_visits(positions, dims.zones(spark)))


@query("zone_visits_for", sql.over("SELECT mmsi, v.zone_id, coalesce(zone_name, v.zone_id) AS zone_name, coalesce(kind, 'port') AS kind, first_ts, last_ts FROM visits v LEFT JOIN zones z ON z.zone_id = v.zone_id", sql.ZONES, sql.ZONE_FIX, sql.VISITS))
def _decorated(fix, positions, vessel, spark):
    return views.decorated(views.zone_visits(positions, dims.zones(spark)), dims.zones(spark))


@query("by_extent", sql.over(f"SELECT max_extent, count(*) AS cnt, {sql.rounded('count(*) * 1E2 / (SELECT count(*) FROM vessels)', 1)} AS pct FROM vessels WHERE max_extent IS NOT NULL GROUP BY max_extent"))
def _by_extent(fix, positions, vessel, spark):
    return views.by_extent(vessel)


@query("by_type", sql.over("SELECT vessel_type, count(*) AS cnt, CAST(sum(of_interest) AS BIGINT) AS of_interest_cnt FROM vessels WHERE vessel_type IS NOT NULL GROUP BY vessel_type HAVING count(*) >= 3"))
def _by_type(fix, positions, vessel, spark):
    return views.by_type(vessel, 3)


@query("tiers", sql.over(f"SELECT tier, count(*) AS pos_count, count(DISTINCT mmsi) AS distinct_vessels, {sql.rounded('avg(speed)', 1)} AS avg_speed_kn, min(ts) AS first_ts, max(ts) AS last_ts FROM positions GROUP BY tier"))
def _tiers(fix, positions, vessel, spark):
    return views.tier_statistics(positions)


BREAKDOWN = f"count(*) AS position_rows, count(DISTINCT mmsi) AS vessels, {sql.rounded('(max(ts) - min(ts)) / 864E5', 2)} AS span_days, CAST(floor(count(*) / nullif((max(ts) - min(ts)) / 864E5, 0) + 5E-1) AS BIGINT) AS pos_writes_per_day FROM positions"


@query("write_breakdown_gs", sql.over(f"SELECT tier, {BREAKDOWN} GROUP BY tier UNION ALL SELECT 'ALL', {BREAKDOWN}"))
def _breakdown(fix, positions, vessel, spark):
    return views.write_breakdown(positions)


STATS = [("total_vessels", "count(*)", "vessels"), ("of_interest", "sum(of_interest)", "vessels"), ("not_of_interest", "count(*) - sum(of_interest)", "vessels"), ("total_positions", "count(*)", "positions"), ("vessels_with_positions", "count(DISTINCT mmsi)", "positions")]
STATS += [(f"{t}_positions", f"count(*) FILTER (tier = '{t}')", "positions") for t in dims.TIERS] + [(f"max_extent_{t}", f"count(*) FILTER (max_extent = '{t}')", "vessels") for t in dims.TIERS]


@query("stats_metrics", sql.over(" UNION ALL ".join(f"SELECT '{n}' AS metric, CAST({e} AS BIGINT) AS value FROM {t}" for n, e, t in STATS)))
def _stats(fix, positions, vessel, spark):
    return views.statistics(vessel, positions)


@query("ship_tiers", sql.over("SELECT mmsi, tier, count(*) AS pos_count, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(count(*)) OVER (PARTITION BY mmsi) AS BIGINT) AS total_positions FROM positions GROUP BY mmsi, tier"))
def _ship(fix, positions, vessel, spark):
    by = positions.groupBy("mmsi", "tier").agg(F.count("*").alias("pos_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return by.join(positions.groupBy("mmsi").agg(F.count("*").alias("total_positions")), "mmsi")


def _listing(name: str, where: str, columns: str):
    QUERIES[name] = lambda spark, sf_dir: adapter.vessel_table(adapter.fixes(spark, sf_dir)).filter(where).selectExpr(*columns.split(", "))
    ORACLE_SQL[name] = sql.over(f"SELECT {columns} FROM vessels WHERE {where}")


_listing("list_ships", "true", "mmsi, name, vessel_type, length, of_interest, max_extent, last_seen AS last_seen_utc, times_seen, direct_entry_count")
_listing("of_interest", "of_interest = 1", "mmsi, name, vessel_type, length, max_extent, first_direct_at AS first_direct_utc, last_seen AS last_seen_utc, direct_entry_count, times_seen")
_listing("recent_status", "true", "mmsi, name, vessel_type, last_speed, last_seen, CASE WHEN last_speed >= 15E-1 THEN 'moving' ELSE 'stopped' END AS status")


@query("search_numeric", sql.over("SELECT mmsi, name, vessel_type, length, of_interest, max_extent, last_seen FROM vessels WHERE CAST(mmsi AS VARCHAR) LIKE '3160000%' OR upper(name) LIKE '%3160000%' ORDER BY CASE WHEN CAST(mmsi AS VARCHAR) = '3160000' THEN 0 WHEN CAST(mmsi AS VARCHAR) LIKE '3160000%' THEN 1 ELSE 2 END, last_seen DESC, mmsi LIMIT 30"))
def _search_number(fix, positions, vessel, spark):
    return views.search(vessel, "3160000")


@query("search_text", sql.over("SELECT mmsi, name, vessel_type, length, of_interest, max_extent, last_seen FROM vessels WHERE upper(name) LIKE '%QUEEN%' ORDER BY last_seen DESC, mmsi LIMIT 30"))
def _search_text(fix, positions, vessel, spark):
    return views.search(vessel, "queen")


@query("stale", sql.over(f"SELECT mmsi, name, vessel_type, length, of_interest, last_seen, CAST(floor(({sql.NOW} - last_seen) / 36E5) AS BIGINT) AS hours_ago FROM vessels WHERE last_seen < {sql.NOW} - 3 * 3600000"))
def _stale(fix, positions, vessel, spark):
    return views.stale(vessel, adapter.NOW_MS, 3)


@query("timeline", sql.over("SELECT p.id, p.mmsi, v.name, p.tier, p.ts FROM positions p LEFT JOIN vessels v ON v.mmsi = p.mmsi"))
def _timeline(fix, positions, vessel, spark):
    return positions.join(vessel.select("mmsi", "name"), "mmsi", "left").select("id", "mmsi", "name", "tier", "ts")


PRIORITY = f"CASE WHEN max_extent = 'global' THEN 0 WHEN max_extent = 'local' AND last_seen < {sql.NOW} - 1800000 THEN 1 WHEN max_extent = 'direct' AND last_seen < {sql.NOW} - 1800000 THEN 2 WHEN max_extent = 'local' THEN 3 WHEN max_extent = 'direct' THEN 4 ELSE 5 END"


@query("global_priority", sql.over(f"SELECT mmsi, max_extent, last_seen, {PRIORITY} AS priority FROM vessels WHERE of_interest = 1"))
def _priority(fix, positions, vessel, spark):
    return views.global_priority(vessel, adapter.NOW_MS)


def _display(kind: str = "vessel_type") -> str:
    up = "upper(coalesce(name, ''))"
    starts = lambda xs: " OR ".join(f"starts_with({up}, '{x}')" for x in xs)
    holds = lambda xs: " OR ".join(f"contains({up}, '{x}')" for x in xs)
    return f"""CASE WHEN mmsi IN (366929710, 311001249) OR {starts(dims.FERRY_STARTS)} OR {holds(dims.FERRY_PARTS)} THEN 'ferry'
        WHEN ({kind} IS NULL OR {kind} BETWEEN 60 AND 69) AND ({starts(dims.CRUISE_STARTS)} OR {holds(dims.CRUISE_PARTS)}) THEN 'cruise'
        WHEN {kind} IS NULL THEN CASE WHEN length > 150 THEN 'cargo' WHEN {starts(dims.STATE_STARTS)} THEN 'government' ELSE 'unknown' END
        WHEN {kind} BETWEEN 70 AND 79 THEN 'cargo' WHEN {kind} BETWEEN 80 AND 89 THEN 'tanker' WHEN {kind} BETWEEN 60 AND 69 THEN CASE WHEN length > 200 THEN 'cruise' ELSE 'ferry' END
        WHEN {kind} BETWEEN 40 AND 49 THEN 'ferry' WHEN {kind} = 35 THEN 'military' WHEN {kind} IN (36, 37) THEN 'pleasure' WHEN {kind} = 30 THEN 'fishing'
        WHEN {kind} IN (31, 32, 52, 53) THEN 'tug' WHEN {kind} BETWEEN 33 AND 34 OR {kind} IN (50, 51) OR {kind} BETWEEN 54 AND 59 OR {kind} BETWEEN 90 AND 99 THEN 'government' ELSE 'unknown' END"""


#: Types from 0 to 99 by vessel, so that every branch of a classification is met.
ANY_TYPE = "nullif((mmsi - 316000000) % 101, 100)"


@query("classify_display", sql.over(f"SELECT mmsi, name, length, t AS vessel_type, {_display('t')} AS category FROM (SELECT *, {ANY_TYPE} AS t FROM vessels) x"))
def _classify_display(fix, positions, vessel, spark):
    v = vessel.withColumn("vessel_type", F.expr(ANY_TYPE))
    return v.select("mmsi", "name", "length", "vessel_type", vessels.display_class(*(F.col(c) for c in ("mmsi", "name", "vessel_type", "length"))).alias("category"))


@query("classify_worker", sql.over(f"SELECT mmsi, {sql.worker_class(f'({ANY_TYPE})')} AS category FROM vessels"))
def _classify_worker(fix, positions, vessel, spark):
    return vessel.select("mmsi", vessels.worker_class(F.expr(ANY_TYPE)).alias("category"))


@query("classify_sim", sql.over(f"SELECT mmsi, {sql.worker_class(f'({ANY_TYPE})', 'other')} AS category FROM vessels"))
def _classify_sim(fix, positions, vessel, spark):
    return vessel.select("mmsi", vessels.simulator_class(F.expr(ANY_TYPE)).alias("category"))


@query("country", sql.over("SELECT mmsi, iso2, CASE WHEN iso2 IS NOT NULL THEN concat(chr(127397 + ascii(iso2)), chr(127397 + ascii(substr(iso2, 2)))) END AS flag FROM (SELECT mmsi + (mmsi % 3) * 50000000 AS mmsi FROM vessels) v LEFT JOIN countries ON mid = mmsi // 1000000", sql.COUNTRIES))
def _country(fix, positions, vessel, spark):
    v = vessel.select((F.col("mmsi") + (F.col("mmsi") % 3) * 50_000_000).alias("mmsi"))
    return v.join(F.broadcast(dims.countries(spark)), F.floor(F.col("mmsi") / 1_000_000.0) == F.col("mid"), "left").select("mmsi", "iso2", vessels.flag(F.col("iso2")).alias("flag"))


@query("journey_class", sql.over("SELECT mmsi, CASE WHEN max_extent = 'global' THEN 'distant_visitor' WHEN max_extent = 'direct' OR direct_entry_count >= 3 THEN 'local_boat' ELSE 'passing_through' END AS journey_class FROM vessels"))
def _journey_class(fix, positions, vessel, spark):
    return vessel.select("mmsi", vessels.journey_class(F.col("max_extent"), F.col("direct_entry_count")).alias("journey_class"))


@query("large_small", sql.over(f"SELECT mmsi, ({sql.large('vessel_type', 'length')}) AS large, (vessel_type IS NOT NULL OR length IS NOT NULL) AND NOT ({sql.large('vessel_type', 'length')}) AS small, coalesce(vessel_type IN (30, 31, 32, 36, 37, 52), false) AS low_value FROM vessels"))
def _large_small(fix, positions, vessel, spark):
    k, n = F.col("vessel_type"), F.col("length")
    return vessel.select("mmsi", vessels.is_large(k, n).alias("large"), vessels.is_confirmed_small(k, n).alias("small"), vessels.is_low_value(k).alias("low_value"))


@query("foreign_inbound", sql.over(f"SELECT mmsi, {sql.inbound('vessel_type', 'length', 'destination')} AS inbound FROM vessels"))
def _inbound(fix, positions, vessel, spark):
    return vessel.select("mmsi", vessels.is_inbound(F.col("vessel_type"), F.col("length"), F.col("destination")).alias("inbound"))


@query("list_sort", sql.over(f"SELECT mmsi, coalesce(name, '') AS name, coalesce(iso2, '') AS country, {sql.rounded(sql.haversine(f'{HOME[0]!r}E0', f'{HOME[1]!r}E0', 'last_lat', 'last_lon'))} AS distance_nm, coalesce(last_speed, -1E0) AS speed, {_display()} AS category FROM vessels LEFT JOIN countries ON mid = mmsi // 1000000", sql.COUNTRIES))
def _list_sort(fix, positions, vessel, spark):
    v = vessel.join(F.broadcast(dims.countries(spark)), F.floor(F.col("mmsi") / 1_000_000.0) == F.col("mid"), "left")
    return views.listed(v, F.col("iso2"), geo.haversine_nm(F.lit(HOME[0]), F.lit(HOME[1]), F.col("last_lat"), F.col("last_lon")))


@query("heard_by_port", sql.over("SELECT ts // 3600000 AS scan_id, zone_id, count(DISTINCT mmsi) AS heard FROM zone_fix GROUP BY ALL", sql.ZONES, sql.ZONE_FIX))
def _heard(fix, positions, vessel, spark):
    z = views.zone_of(fix.select("event_id", "mmsi", "ts", "lat", "lon"), dims.zones(spark))
    return z.groupBy(F.floor(F.col("ts") / 3_600_000.0).alias("scan_id"), "zone_id").agg(F.countDistinct("mmsi").alias("heard"))


@query("exists_extent_backfill", sql.over("SELECT mmsi, CASE WHEN EXISTS (SELECT 1 FROM positions p WHERE p.mmsi = v.mmsi AND p.tier = 'global') THEN 'global' WHEN EXISTS (SELECT 1 FROM positions p WHERE p.mmsi = v.mmsi AND p.tier = 'local') THEN 'local' ELSE 'direct' END AS max_extent FROM vessels v"))
def _backfill(fix, positions, vessel, spark):
    has = positions.groupBy("mmsi").agg(F.max(vessels.extent_rank(F.col("tier"))).alias("r"))
    return vessel.select("mmsi").join(has, "mmsi", "left").select("mmsi", F.element_at(F.array(*map(F.lit, dims.TIERS)), F.coalesce("r", F.lit(0)) + 1).alias("max_extent"))
