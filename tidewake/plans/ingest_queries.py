"""Queries of message parsing and scans, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions import dims, vessels
from tidewake.operators import ingest, views
from tidewake.plans import sql
from tidewake.sources import adapter, ais

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The scan of these queries takes the fixes of the last day as heard, and the days before as the state.
CUT = 1706486400000


def query(name: str, oracle: str | None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(adapter.fixes(spark, sf_dir), spark)
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


MESSAGES = """msg AS (SELECT ts // 3600000 AS scan_id, event_id * 2 AS seq, 'PositionReport' AS kind, mmsi, nullif(trim(coalesce(name, ' ')), '') AS name, lat, lon, speed, nullif(coalesce(heading, 511), 511) AS heading,
        CAST(NULL AS INT) AS vessel_type, CAST(NULL AS BIGINT) AS length, CAST(NULL AS VARCHAR) AS destination FROM fix
    UNION ALL SELECT ts // 3600000, event_id * 2 + 1, 'ShipStaticData', mmsi, name, NULL, NULL, NULL, NULL, nullif(vessel_type, 0), CASE WHEN length > 0 THEN length END, nullif(trim(coalesce(destination, '')), '') FROM fix WHERE event_id % 5 = 0)"""
MERGED = """merged AS (SELECT scan_id, mmsi, arg_max_null(name, seq) AS name, arg_max_null(lat, seq) FILTER (kind = 'PositionReport') AS lat, arg_max_null(lon, seq) FILTER (kind = 'PositionReport') AS lon,
        arg_max_null(speed, seq) FILTER (kind = 'PositionReport') AS speed, arg_max_null(heading, seq) FILTER (kind = 'PositionReport') AS heading, arg_max_null(vessel_type, seq) FILTER (kind = 'ShipStaticData') AS vessel_type,
        arg_max_null(length, seq) FILTER (kind = 'ShipStaticData') AS length, arg_max_null(destination, seq) FILTER (kind = 'ShipStaticData') AS destination, bool_or(kind = 'PositionReport') AS has_position, bool_or(kind = 'ShipStaticData') AS has_static FROM msg {where} GROUP BY scan_id, mmsi)"""


def parsed(fix: DataFrame) -> DataFrame:
    return ais.parse(adapter.messages(fix))


@query("parse_json_messages", sql.over("SELECT * FROM msg", MESSAGES))
def _parse(fix, spark):
    return parsed(fix)


@query("merge_partials", sql.over("SELECT * FROM merged", MESSAGES, MERGED.format(where="")))
def _merge(fix, spark):
    return ais.merge(parsed(fix))


@query("complete_vessels", sql.over("SELECT scan_id, mmsi, name, lat, lon, speed, heading, vessel_type, length, destination FROM merged WHERE has_position", MESSAGES, MERGED.format(where="")))
def _complete(fix, spark):
    return ais.complete(ais.merge(parsed(fix)))


@query("static_only", sql.over("SELECT scan_id, mmsi, name, vessel_type, length, destination FROM merged WHERE NOT has_position AND has_static", MESSAGES, MERGED.format(where="WHERE kind = 'ShipStaticData' OR seq % 3 = 0")))
def _static_only(fix, spark):
    return ais.static_only(ais.merge(parsed(fix).filter("kind = 'ShipStaticData' or seq % 3 = 0")))


def parts(fix: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heard vessels of the last day (their last fix), and the snapshot and log of the time before."""
    before = fix.filter(F.col("ts") < CUT)
    last = F.max_by(F.struct("event_id", "name", "lat", "lon", "speed", "heading", "vessel_type", "length", "destination"), F.struct("ts", "event_id"))
    heard = fix.filter(F.col("ts") >= CUT).groupBy("mmsi").agg(last.alias("h")).select("mmsi", "h.*")
    keep = F.col("mmsi") % 7 != 0  # so that some heard vessels are new
    return heard, adapter.vessel_table(before.filter(keep)), adapter.positions(before.filter(keep))


PARTS = (
    f"now_heard AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, event_id DESC) AS rn FROM fix_all WHERE ts >= {CUT}) x WHERE rn = 1)",
    f"fix AS (SELECT * FROM fix_all WHERE ts < {CUT} AND mmsi % 7 <> 0)",
    sql.POSITIONS, sql.VESSELS, sql.LATEST,
    "states AS (SELECT v.mmsi, true AS known, v.last_speed AS o_flag, v.last_seen AS o_seen, of_interest AS o_interest, max_extent AS o_extent, direct_entry_count AS o_entries, vessel_type AS o_type, length AS o_length, p.lat AS o_lat, p.lon AS o_lon, p.speed AS o_speed, p.heading AS o_heading, p.ts AS o_ts FROM vessels v LEFT JOIN latest p ON p.mmsi = v.mmsi)",
)


def scan_sql(kind: str, select: str) -> str:
    """The scan's decisions as SQL: one row a heard vessel, in table `judged`."""
    tier = {"direct": "'direct'", "local": f"CASE WHEN {sql.box('h.lat', 'h.lon', dims.DIRECT_BOX)} THEN 'direct' ELSE 'local' END", "global": sql.tier("h.lat", "h.lon")}[kind]
    rank = lambda e: f"CASE {e} WHEN 'direct' THEN 0 WHEN 'local' THEN 1 ELSE 2 END"
    wide = lambda to: f"CASE WHEN {rank('before')} >= {rank(f'''{to!r}''')} THEN before ELSE {to!r} END"
    extent = {"direct": "before", "local": f"CASE WHEN tier = 'direct' THEN before ELSE {wide('local')} END", "global": f"CASE WHEN tier = 'global' THEN {wide('global')} ELSE before END"}[kind]
    drop = f"WHERE known OR NOT ((vessel_type IS NOT NULL OR length IS NOT NULL) AND NOT ({sql.large('vessel_type', 'length')}))" if kind == "local" else ""
    now = sql.NOW
    move = sql.significant("o", "n", "n.tier")
    text = [
        f"j0 AS (SELECT h.mmsi, h.name, h.vessel_type, h.length, h.destination, h.lat, h.lon, h.speed, h.heading, {now} AS ts, {tier} AS tier, coalesce(known, false) AS known, o_flag, o_seen, o_interest, o_extent, o_entries, o_lat, o_lon, o_speed, o_heading, o_ts FROM now_heard h LEFT JOIN states s ON s.mmsi = h.mmsi)",
        f"j1 AS (SELECT *, coalesce(o_extent, CASE WHEN {sql.large('vessel_type', 'length')} THEN 'local' ELSE 'direct' END) AS before, coalesce({sql.tier('o_lat', 'o_lon')} = 'direct' AND o_lat IS NOT NULL, false) AS was_direct FROM j0 {drop})",
        f"j2 AS (SELECT n.*, n.o_lat IS NULL OR {move} AS moved FROM j1 n, LATERAL (SELECT n.o_lat AS lat, n.o_lon AS lon, n.o_speed AS speed, n.o_heading AS heading, n.o_ts AS ts) o)",
        f"j3 AS (SELECT *, NOT moved AND tier = 'direct' AND coalesce(speed >= 15E-1, false) AND coalesce(ts - o_ts > 1200000, false) AS stalled, {'1' if kind == 'direct' else '''CASE WHEN tier = 'direct' OR coalesce(o_interest = 1, false) THEN 1 ELSE 0 END'''} AS of_interest, CASE WHEN tier = 'direct' AND (NOT known OR coalesce(o_interest = 0, false)) THEN ts END AS first_direct_at, {extent} AS max_extent, CASE WHEN tier = 'direct' AND NOT was_direct THEN coalesce(o_entries, 0) + 1 ELSE coalesce(o_entries, 0) END AS direct_entry_count FROM j2)",
        "j4 AS (SELECT *, CASE WHEN stalled THEN 0E0 ELSE speed END AS effective_speed, stalled AND NOT coalesce(o_flag = 0, false) AS force, coalesce(ts - o_seen >= CASE WHEN ts - o_ts > 21600000 THEN 3600000 WHEN ts - o_ts > 3600000 THEN 1800000 ELSE 600000 END, false) AS due FROM j3)",
        "j5 AS (SELECT *, force OR NOT known OR of_interest <> o_interest OR max_extent <> o_extent OR first_direct_at IS NOT NULL OR direct_entry_count <> coalesce(o_entries, 0) OR due AS write FROM j4)",
        "judged AS (SELECT *, CASE WHEN moved THEN 'moved' WHEN force THEN 'phantom' WHEN write THEN 'heartbeat' ELSE 'skipped' END AS outcome FROM j5)",
    ]
    return "WITH RECURSIVE " + ", ".join((sql.fixes(name="fix_all"), *PARTS, *text)) + "\n" + select


JUDGED = "mmsi, tier, moved, force, effective_speed, of_interest, max_extent, first_direct_at, direct_entry_count, outcome"


def _scan(kind: str, fix: DataFrame, spark: SparkSession) -> ingest.Scan:
    heard, vessel, positions = parts(fix)
    return ingest.scan(kind, heard.drop("event_id"), ingest.states(vessel, positions), dims.zones(spark), adapter.NOW_MS)


for _kind in dims.TIERS:
    query(f"first_scan_{_kind}", scan_sql(_kind, f"SELECT {JUDGED} FROM judged"))(lambda fix, spark, kind=_kind: _scan(kind, fix, spark).judged.select(*JUDGED.split(", ")))


@query("scan_summary", scan_sql("global", "SELECT tier, count(*) AS heard, count(*) FILTER (outcome = 'moved') AS moved, count(*) FILTER (outcome = 'heartbeat') AS heartbeat, count(*) FILTER (outcome = 'phantom') AS phantom, count(*) FILTER (outcome = 'skipped') AS skipped FROM judged GROUP BY tier"))
def _summary(fix, spark):
    return ingest.summary(_scan("global", fix, spark).judged)


UPSERTED = """SELECT coalesce(o.mmsi, n.mmsi) AS mmsi, CASE WHEN keep THEN o.name ELSE coalesce(n.name, o.name) END AS name, CASE WHEN keep THEN o.vessel_type ELSE coalesce(n.vessel_type, o.vessel_type) END AS vessel_type,
    CASE WHEN keep THEN o.length ELSE coalesce(n.length, o.length) END AS length, CASE WHEN keep THEN o.destination ELSE coalesce(n.destination, o.destination) END AS destination,
    CASE WHEN keep THEN last_lat ELSE lat END AS last_lat, CASE WHEN keep THEN last_lon ELSE lon END AS last_lon, CASE WHEN n.mmsi IS NULL THEN last_speed ELSE effective_speed END AS last_speed, CASE WHEN keep THEN last_heading ELSE heading END AS last_heading,
    CASE WHEN outcome = 'moved' THEN ts ELSE last_pos_ts END AS last_pos_ts, CASE WHEN n.mmsi IS NULL THEN last_seen ELSE ts END AS last_seen, coalesce(first_seen, ts) AS first_seen,
    CASE WHEN keep THEN o.of_interest ELSE greatest(n.of_interest, o.of_interest) END AS of_interest, CASE WHEN keep THEN o.max_extent ELSE n.max_extent END AS max_extent, CASE WHEN keep THEN o.first_direct_at ELSE coalesce(o.first_direct_at, n.first_direct_at) END AS first_direct_at,
    CASE WHEN keep THEN o.direct_entry_count ELSE greatest(n.direct_entry_count, o.direct_entry_count) END AS direct_entry_count, CASE WHEN n.mmsi IS NULL THEN times_seen ELSE coalesce(times_seen, 0) + 1 END AS times_seen
    FROM vessels o FULL OUTER JOIN (SELECT * FROM judged WHERE write) n ON o.mmsi = n.mmsi, LATERAL (SELECT n.mmsi IS NULL OR coalesce(outcome = 'phantom', false) AS keep) k WHERE o.mmsi IS NOT NULL OR outcome <> 'phantom'"""


@query("upsert_vessels", scan_sql("global", UPSERTED))
def _upsert(fix, spark):
    heard, vessel, positions = parts(fix)
    done = ingest.scan("global", heard.drop("event_id"), ingest.states(vessel, positions), dims.zones(spark), adapter.NOW_MS)
    return ingest.upsert_vessels(vessel, done.upserts)


ENRICHED = f"""WITH RECURSIVE {sql.fixes()}, {sql.POSITIONS}, {sql.VESSELS}, sparse AS (SELECT * REPLACE (CASE WHEN mmsi % 3 = 0 THEN NULL ELSE vessel_type END AS vessel_type, CASE WHEN mmsi % 5 = 0 THEN NULL ELSE length END AS length) FROM vessels),
    up AS (SELECT mmsi, name AS n_name, vessel_type AS n_vessel_type, length AS n_length, destination AS n_destination FROM vessels WHERE mmsi % 2 = 0)
    SELECT s.* REPLACE (CASE WHEN open THEN coalesce(n_name, name) ELSE name END AS name, CASE WHEN open THEN coalesce(n_vessel_type, vessel_type) ELSE vessel_type END AS vessel_type, CASE WHEN open THEN coalesce(n_length, length) ELSE length END AS length, CASE WHEN open THEN coalesce(n_destination, destination) ELSE destination END AS destination,
        CASE WHEN open AND big THEN 1 ELSE of_interest END AS of_interest, CASE WHEN open AND big AND max_extent = 'direct' THEN 'local' ELSE max_extent END AS max_extent)
    FROM sparse s LEFT JOIN up u ON u.mmsi = s.mmsi, LATERAL (SELECT u.mmsi IS NOT NULL AND (vessel_type IS NULL OR length IS NULL OR destination IS NULL) AS open, {sql.large('n_vessel_type', 'coalesce(n_length, length)')} AS big) k"""


@query("enrich_static", ENRICHED)
def _enrich(fix, spark):
    all_ = adapter.vessel_table(fix)
    sparse = all_.withColumns({"vessel_type": F.when(F.col("mmsi") % 3 != 0, F.col("vessel_type")), "length": F.when(F.col("mmsi") % 5 != 0, F.col("length"))})
    return ingest.enrich_static(sparse, all_.filter("mmsi % 2 = 0").select("mmsi", *ingest.STATIC))


SEEN = f"seen AS (SELECT mmsi, zone_id, arg_max(lat, event_id) AS lat, arg_max(lon, event_id) AS lon, max(ts) AS ts FROM zone_fix_all WHERE ts >= {CUT} GROUP BY mmsi, zone_id)"
ZONE_ALL = "zone_fix_all AS (SELECT event_id, mmsi, ts, lat, lon, arg_min(zone_id, ordinal) AS zone_id FROM fix JOIN zones ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY ALL)"
OLD_VISITS = f"old_visits AS (SELECT mmsi, zone_id, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(lat, event_id) AS lat, arg_max(lon, event_id) AS lon FROM zone_fix_all WHERE ts < {CUT} GROUP BY mmsi, zone_id)"


def _visits(fix: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    z = views.zone_of(fix.select("event_id", "mmsi", "ts", "lat", "lon"), dims.zones(spark))
    at = [F.max_by("lat", "event_id").alias("lat"), F.max_by("lon", "event_id").alias("lon")]
    old = z.filter(F.col("ts") < CUT).groupBy("mmsi", "zone_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *at)
    return old, z.filter(F.col("ts") >= CUT).groupBy("mmsi", "zone_id").agg(F.max("ts").alias("ts"), *at)


@query("zone_visit_upsert", sql.over("SELECT coalesce(o.mmsi, n.mmsi) AS mmsi, coalesce(o.zone_id, n.zone_id) AS zone_id, coalesce(first_ts, n.ts) AS first_ts, CASE WHEN m THEN n.ts ELSE last_ts END AS last_ts, CASE WHEN m THEN n.lat ELSE o.lat END AS lat, CASE WHEN m THEN n.lon ELSE o.lon END AS lon FROM old_visits o FULL OUTER JOIN seen n ON o.mmsi = n.mmsi AND o.zone_id = n.zone_id, LATERAL (SELECT n.ts IS NOT NULL AND (last_ts IS NULL OR n.ts - last_ts >= 1800000) AS m) k", sql.ZONES, ZONE_ALL, SEEN, OLD_VISITS))
def _zone_upsert(fix, spark):
    return ingest.upsert_zone_visits(*_visits(fix, spark))


@query("unseen_zone_anti", sql.over("SELECT mmsi, zone_id FROM seen s WHERE NOT EXISTS (SELECT 1 FROM old_visits o WHERE o.mmsi = s.mmsi AND o.zone_id = s.zone_id)", sql.ZONES, ZONE_ALL, SEEN, OLD_VISITS))
def _unseen(fix, spark):
    old, seen = _visits(fix, spark)
    return seen.join(old, ["mmsi", "zone_id"], "left_anti").select("mmsi", "zone_id")


@query("heard_semi", "WITH RECURSIVE " + ", ".join((sql.fixes(name="fix_all"), *PARTS)) + " SELECT mmsi, id, ts FROM positions WHERE mmsi IN (SELECT mmsi FROM now_heard)")
def _semi(fix, spark):
    heard, _, positions = parts(fix)
    return positions.join(heard, "mmsi", "left_semi").select("mmsi", "id", "ts")


@query("chunk_numbering", sql.over("SELECT mmsi, CAST((row_number() OVER (ORDER BY last_seen, mmsi) - 1) // 75 AS INT) AS chunk FROM vessels WHERE of_interest = 1"))
def _chunks(fix, spark):
    return ingest.chunked(adapter.vessel_table(fix).filter("of_interest = 1").select("mmsi", "last_seen"), ("last_seen", "mmsi")).select("mmsi", "chunk")


@query("global_rounds", sql.over("SELECT v.mmsi, coalesce(r, 0) AS round FROM vessels v LEFT JOIN (SELECT mmsi, min(round) AS r FROM (SELECT DISTINCT mmsi, CAST(event_id % 9 AS INT) AS round FROM fix) x WHERE round BETWEEN 1 AND 3 GROUP BY mmsi) h ON h.mmsi = v.mmsi"))
def _rounds(fix, spark):
    heard = fix.select("mmsi", (F.col("event_id") % 9).cast("int").alias("round")).distinct()
    return ingest.rounds(adapter.vessel_table(fix), heard)


@query("significant_move_lag", sql.over(f"SELECT n.event_id, {sql.significant('o', 'n', 'n.tier')} AS moves FROM (SELECT *, lag(event_id) OVER (PARTITION BY mmsi ORDER BY ts, event_id) AS prev FROM fix) n JOIN fix o ON o.event_id = n.prev"))
def _significant(fix, spark):
    w = Window.partitionBy("mmsi").orderBy("ts", "event_id")
    new = {c: F.col(c) for c in ("lat", "lon", "speed", "heading", "ts")} | {"kind": F.col("vessel_type")}
    rows = fix.withColumns({f"o_{c}": F.lag(c).over(w) for c in ("lat", "lon", "speed", "heading", "ts")})
    return rows.filter("o_ts is not null").select("event_id", vessels.significant_move(new, {c: F.col(f"o_{c}") for c in ("lat", "lon", "speed", "heading", "ts")}, F.col("tier")).alias("moves"))


@query("direct_entries", sql.over("SELECT mmsi, direct_entry_count FROM vessels"))
def _entries(fix, spark):
    return adapter.vessel_table(fix).select("mmsi", "direct_entry_count")


FOREIGN = f"""SELECT mmsi, zone_id, lat, lon, relevant, small, wants_position AND n_position <= 25 AS position, wants_row AND n_row <= 200 AS initial, (wants_row AND n_row <= 200) OR (relevant AND (refresh OR (wants_position AND n_position <= 25))) AS upsert
    FROM (SELECT *, sum(CAST(wants_position AS INT)) OVER w AS n_position, sum(CAST(wants_row AS INT)) OVER w AS n_row FROM f2 WINDOW w AS (ORDER BY arrival, mmsi ROWS UNBOUNDED PRECEDING)) x"""
FOREIGN_PARTS = [
    "zoned AS (SELECT mmsi, any_value(arrival) AS arrival, any_value(lat) AS lat, any_value(lon) AS lon, any_value(vessel_type) AS vessel_type, any_value(length) AS length, any_value(destination) AS destination, arg_min(zone_id, ordinal) AS zone_id FROM (SELECT *, event_id AS arrival FROM now_heard) h JOIN zones ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY mmsi)",
    f"pairs_seen AS (SELECT DISTINCT mmsi, zone_id FROM (SELECT mmsi, event_id, arg_min(zone_id, ordinal) AS zone_id FROM fix JOIN zones ON lat BETWEEN south AND north AND lon BETWEEN west AND east WHERE mmsi % 2 = 0 GROUP BY mmsi, event_id) z)",
    f"f1 AS (SELECT z.mmsi, z.zone_id, z.arrival, z.lat, z.lon, s.known IS NULL AS fresh, coalesce(o_interest = 1, false) AS interest, v.mmsi IS NOT NULL AS visited, o_ts, o_seen, {sql.inbound('coalesce(z.vessel_type, o_type)', 'coalesce(z.length, o_length)', 'z.destination')} AS bound, (coalesce(z.vessel_type, o_type) IS NOT NULL OR coalesce(z.length, o_length) IS NOT NULL) AND NOT ({sql.large('coalesce(z.vessel_type, o_type)', 'coalesce(z.length, o_length)')}) AS little FROM zoned z LEFT JOIN states s ON s.mmsi = z.mmsi LEFT JOIN pairs_seen v ON v.mmsi = z.mmsi AND v.zone_id = z.zone_id)",
    f"f2 AS (SELECT *, NOT interest AND fresh AND little AS small, (interest OR bound) AND NOT (NOT interest AND fresh AND little) AS relevant, (interest OR bound) AND NOT (NOT interest AND fresh AND little) AND (NOT visited OR (NOT fresh AND coalesce({sql.NOW} - o_ts >= 1800000, false))) AS wants_position, fresh AND NOT (interest OR bound) AND NOT (NOT interest AND fresh AND little) AS wants_row, fresh OR coalesce({sql.NOW} - o_seen >= 21600000, false) AS refresh FROM f1)",
]


@query("foreign_caps", "WITH RECURSIVE " + ", ".join((sql.fixes(name="fix_all"), *PARTS, sql.ZONES, *FOREIGN_PARTS)) + "\n" + FOREIGN)
def _foreign(fix, spark):
    heard, vessel, positions = parts(fix)
    z = views.zone_of(positions.filter("mmsi % 2 = 0").select("id", "mmsi", "lat", "lon"), dims.zones(spark)).select("mmsi", "zone_id").distinct()
    heard = heard.withColumnRenamed("event_id", "arrival").select("mmsi", "arrival", "lat", "lon", "vessel_type", "length", "destination")
    return ingest.foreign(heard, ingest.states(vessel, positions), z, dims.zones(spark), adapter.NOW_MS)
