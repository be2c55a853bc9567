"""SQL fragments that the oracle texts share: the adapter's tables and the formulas of the column functions."""

from __future__ import annotations

from tidewake.functions import dims
from tidewake.sources.adapter import EPOCH_MS, FAST, NOW_MS, TEMPLATE

MS = "epoch_us(ts)//1000"
FAST_MS = f"{EPOCH_MS} + CAST(floor(({MS} - {EPOCH_MS}) / {FAST}E0) AS BIGINT)"


def box(lat: str, lon: str, b: tuple[float, float, float, float]) -> str:
    return f"({lat} BETWEEN {b[0]:E} AND {b[2]:E} AND {lon} BETWEEN {b[1]:E} AND {b[3]:E})"


def tier(lat: str, lon: str) -> str:
    return f"CASE WHEN {box(lat, lon, dims.DIRECT_BOX)} THEN 'direct' WHEN {box(lat, lon, dims.LOCAL_BOX)} THEN 'local' ELSE 'global' END"


def by_tier(t: str, values: dict[str, float]) -> str:
    return f"CASE {t} WHEN 'direct' THEN {values['direct']:E} WHEN 'global' THEN {values['global']:E} ELSE {values['local']:E} END"


def haversine(a: str, b: str, c: str, d: str, radius: float = 3440.065) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(asin(least(1E0, sqrt({h}))) * {2 * radius!r}E0)"


def bearing(a: str, b: str, c: str, d: str) -> str:
    x = f"radians({d} - {b})"
    return f"atan2(sin({x}) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos({x}))"


def degrees(rad: str) -> str:
    return f"(((degrees({rad}) % 360E0) + 360E0) % 360E0)"


def rounded(x: str, places: int = 6) -> str:
    return f"floor(({x}) * 1E{places} + 5E-1) / 1E{places}"


def large(kind: str, length: str) -> str:
    return f"coalesce({kind} BETWEEN 70 AND 89, false) OR coalesce({length} >= 50, false)"


def inbound(kind: str, length: str, dest: str) -> str:
    named = " OR ".join(f"contains(upper({dest}), '{t}')" for t in dims.INBOUND)
    return f"(coalesce({length} >= 100, false) OR (coalesce({named}, false) AND (coalesce({length} >= 70, false) OR coalesce({kind} BETWEEN 60 AND 89, false))))"


def worker_class(kind: str, other: str = "unknown") -> str:
    return f"CASE WHEN {kind} IS NULL THEN 'unknown' WHEN {kind} BETWEEN 70 AND 79 THEN 'cargo' WHEN {kind} BETWEEN 80 AND 89 THEN 'tanker' WHEN {kind} BETWEEN 60 AND 69 THEN 'passenger' WHEN {kind} IN (36, 37) THEN 'pleasure' WHEN {kind} IN (31, 32) THEN 'tug' WHEN {kind} = 30 THEN 'fishing' WHEN {kind} BETWEEN 40 AND 49 THEN 'ferry' ELSE '{other}' END"


def significant(o: str, n: str, t: str) -> str:
    """Whether fix n (an alias with ts) is a significant move from o in tier t."""
    of = lambda k: by_tier(t, {x: dims.MOVE[x][k] for x in dims.TIERS})
    d = haversine(f"{o}.lat", f"{o}.lon", f"{n}.lat", f"{n}.lon")
    f = f"(CASE WHEN coalesce({n}.vessel_type IN (30, 31, 32, 36, 37, 52), false) THEN 2 ELSE 1 END)"
    turn = f"abs({o}.heading - {n}.heading) % 360"
    speeds = f"coalesce({n}.speed, 0E0)", f"coalesce({o}.speed, 0E0)"
    return f"""({d} >= {of('floor')} AND ({d} >= ({of('gap_nm')}) * {f} OR coalesce({n}.ts - {o}.ts >= ({of('gap_ms')}) * {f}, false)
        OR coalesce((CASE WHEN {turn} > 180 THEN 360 - {turn} ELSE {turn} END) >= {of('turn')}, false)
        OR abs({speeds[0]} - {speeds[1]}) >= {of('speed')} OR ({speeds[1]} > 5E-1) <> ({speeds[0]} > 5E-1)))"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v:E}" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


ZONES = f"zones(ordinal, zone_id, zone_name, kind, reach, south, west, north, east) AS (VALUES {_values([(k, *z[:4], *map(float, z[4:])) for k, z in enumerate(dims.ZONES)])})"
COUNTRIES = f"countries(mid, iso2) AS (VALUES {_values(sorted(dims.COUNTRIES.items()))})"


def fixes(fast: bool = False, name: str = "fix") -> str:
    """The adapter's fixes as a common table expression."""
    text = TEMPLATE.format(ms=FAST_MS if fast else MS, k="CAST(json_extract_string(props,'$.k') AS INT)", text="VARCHAR", events="events")
    return f"{name} AS (SELECT *, {tier('lat', 'lon')} AS tier FROM ({text}) y)"


POSITIONS = "positions AS (SELECT event_id AS id, mmsi, lat, lon, speed, heading, ts, tier FROM fix)"
VESSELS = """vessels AS (
    SELECT mmsi, max(name) AS name, max(vessel_type) AS vessel_type, max(length) AS length, max(destination) AS destination,
           arg_max_null(lat, (ts - 1704067200000) * 10000000 + event_id) AS last_lat, arg_max_null(lon, (ts - 1704067200000) * 10000000 + event_id) AS last_lon,
           arg_max_null(speed, (ts - 1704067200000) * 10000000 + event_id) AS last_speed, arg_max_null(heading, (ts - 1704067200000) * 10000000 + event_id) AS last_heading,
           max(ts) AS last_pos_ts, max(ts) AS last_seen, min(ts) AS first_seen, max(CASE WHEN tier = 'direct' THEN 1 ELSE 0 END) AS of_interest,
           CASE max(CASE tier WHEN 'direct' THEN 0 WHEN 'local' THEN 1 ELSE 2 END) WHEN 0 THEN 'direct' WHEN 1 THEN 'local' ELSE 'global' END AS max_extent,
           min(CASE WHEN tier = 'direct' THEN ts END) AS first_direct_at, CAST(sum(entered) AS BIGINT) AS direct_entry_count, count(*) AS times_seen
    FROM (SELECT *, CASE WHEN tier = 'direct' AND coalesce(lag(tier) OVER (PARTITION BY mmsi ORDER BY ts, event_id), '') <> 'direct' THEN 1 ELSE 0 END AS entered FROM fix) e
    GROUP BY mmsi)"""
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, id DESC) AS rn FROM positions) l WHERE rn = 1)"
ZONE_FIX = "zone_fix AS (SELECT event_id, mmsi, ts, lat, lon, arg_min(zone_id, ordinal) AS zone_id FROM fix JOIN zones ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY ALL)"
#: The throttled fold over each vessel's fixes in a zone.
VISITS = """zone_seq AS (SELECT *, row_number() OVER (PARTITION BY mmsi, zone_id ORDER BY ts, event_id) AS n FROM zone_fix),
    visit_walk AS (SELECT mmsi, zone_id, n, ts AS first_ts, ts AS last_ts, lat, lon FROM zone_seq WHERE n = 1
        UNION ALL SELECT w.mmsi, w.zone_id, z.n, w.first_ts, CASE WHEN z.ts - w.last_ts >= 1800000 THEN z.ts ELSE w.last_ts END,
            CASE WHEN z.ts - w.last_ts >= 1800000 THEN z.lat ELSE w.lat END, CASE WHEN z.ts - w.last_ts >= 1800000 THEN z.lon ELSE w.lon END
        FROM visit_walk w JOIN zone_seq z ON z.mmsi = w.mmsi AND z.zone_id = w.zone_id AND z.n = w.n + 1),
    visits AS (SELECT mmsi, zone_id, first_ts, last_ts, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, zone_id ORDER BY n DESC) AS r FROM visit_walk) v WHERE r = 1)"""


def over(select: str, *parts: str) -> str:
    """A query over the adapter's tables: positions and vessels come first, then the given parts."""
    return "WITH RECURSIVE " + ", ".join((fixes(), POSITIONS, VESSELS, *parts)) + "\n" + select


def over_fast(select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join((fixes(True), *parts)) + "\n" + select


NOW = NOW_MS
