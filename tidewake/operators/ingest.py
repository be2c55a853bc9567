"""Scans: what a drain of heard vessels changes in the vessel snapshot, the movement log and the zone visits.

A scan joins the heard vessels with the state once and decides everything in one projection. `scan_ts` is the time of
the scan, not of a message. Upserts are joins that rewrite the snapshot; the log only grows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions import dims, vessels
from tidewake.functions.geo import in_box
from tidewake.operators.views import latest_position, zone_of

STATIC = ("name", "vessel_type", "length", "destination")
#: Ranges that running totals are made in.
RANGES = 200
NULLS = {"name": "string", "vessel_type": "int", "length": "bigint", "destination": "string"}


@dataclass
class Scan:
    """What a scan decides: vessel rows to write, fixes to append, zone observations, and all heard vessels judged."""

    upserts: DataFrame
    positions: DataFrame
    zone_observations: DataFrame
    judged: DataFrame


def states(vessel: DataFrame, positions: DataFrame) -> DataFrame:
    """State by vessel: the newest fix of the log is the last place, the snapshot's own speed is the phantom flag."""
    p = latest_position(positions).select("mmsi", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("speed").alias("o_speed"), F.col("heading").alias("o_heading"), F.col("ts").alias("o_ts"))
    v = vessel.select("mmsi", F.lit(True).alias("known"), F.col("last_speed").alias("o_flag"), F.col("last_seen").alias("o_seen"), F.col("of_interest").alias("o_interest"), F.col("max_extent").alias("o_extent"), F.col("direct_entry_count").alias("o_entries"), F.col("vessel_type").alias("o_type"), F.col("length").alias("o_length"))
    return v.join(p, "mmsi", "left")


def assessed(heard: DataFrame, tier: Column, scan_ts: Column) -> DataFrame:
    """Adds moved, effective speed and force: a fast report from a place that has not changed for long is a phantom."""
    new = {"lat": F.col("lat"), "lon": F.col("lon"), "speed": F.col("speed"), "heading": F.col("heading"), "kind": F.col("vessel_type"), "ts": scan_ts}
    old = {"lat": F.col("o_lat"), "lon": F.col("o_lon"), "speed": F.col("o_speed"), "heading": F.col("o_heading"), "ts": F.col("o_ts")}
    unknown = F.col("o_lat").isNull() | F.col("o_lon").isNull()
    moved = unknown | vessels.significant_move(new, old, tier)
    stalled = ~moved & (tier == "direct") & F.coalesce(F.col("speed") >= dims.PHANTOM_KN, F.lit(False)) & F.coalesce(scan_ts - F.col("o_ts") > dims.PHANTOM_STALL_MS, F.lit(False))
    return heard.withColumns({"moved": F.coalesce(moved, F.lit(False)), "effective_speed": F.when(stalled, 0.0).otherwise(F.col("speed")), "force": stalled & ~F.coalesce(F.col("o_flag") == 0, F.lit(False))})


def scan(kind: str, heard: DataFrame, state: DataFrame, zones: DataFrame, scan_ts: int) -> Scan:
    """A direct, local or global scan of vessels (mmsi, name, lat, lon, speed, heading, vessel_type, length, destination)."""
    now, direct = F.lit(scan_ts).cast("bigint"), in_box(F.col("lat"), F.col("lon"), dims.DIRECT_BOX)
    rows = heard.join(state, "mmsi", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    tier = {"direct": F.lit("direct"), "local": F.when(direct, "direct").otherwise("local"), "global": vessels.tier_of(F.col("lat"), F.col("lon"))}[kind]
    if kind == "local":
        rows = rows.filter(F.col("known") | ~vessels.is_confirmed_small(F.col("vessel_type"), F.col("length")))
    in_direct = tier == "direct"
    interest = F.lit(1) if kind == "direct" else F.when(in_direct | F.coalesce(F.col("o_interest") == 1, F.lit(False)), 1).otherwise(0)
    first = in_direct & (~F.col("known") | F.coalesce(F.col("o_interest") == 0, F.lit(False)))
    before = F.coalesce("o_extent", vessels.initial_extent(F.col("vessel_type"), F.col("length")))
    extent = {"direct": before, "local": F.when(in_direct, before).otherwise(vessels.wider(before, F.lit("local"))), "global": F.when(tier == "global", vessels.wider(before, F.lit("global"))).otherwise(before)}[kind]
    entries = F.coalesce("o_entries", F.lit(0))
    was_direct = F.coalesce(vessels.tier_of(F.col("o_lat"), F.col("o_lon")) == "direct", F.lit(False)) & F.col("o_lat").isNotNull()
    rows = assessed(rows, tier, now).withColumns({"tier": tier, "ts": now, "of_interest": interest, "first_direct_at": F.when(first, now), "max_extent": extent, "direct_entry_count": F.when(in_direct & ~was_direct, entries + 1).otherwise(entries)})
    due = now - F.col("o_seen") >= vessels.heartbeat_ms(F.col("o_ts"), now)
    changed = ~F.col("known") | (F.col("of_interest") != F.col("o_interest")) | (F.col("max_extent") != F.col("o_extent")) | F.col("first_direct_at").isNotNull() | (F.col("direct_entry_count") != entries) | due
    rows = rows.withColumn("write", F.col("force") | F.coalesce(changed, F.lit(False))).withColumn("outcome", F.when(F.col("moved"), "moved").when(F.col("force"), "phantom").when(F.col("write"), "heartbeat").otherwise("skipped"))
    kept = rows.filter(F.col("moved") | F.col("write"))
    upserts = kept.filter("write").select("mmsi", *STATIC, "lat", "lon", F.col("effective_speed").alias("speed"), "heading", "ts", "of_interest", "max_extent", "first_direct_at", "direct_entry_count", F.when(F.col("moved"), "moved").when(F.col("force"), "force").otherwise("heartbeat").alias("mode"))
    moved = kept.filter("moved").select("mmsi", "lat", "lon", F.col("effective_speed").alias("speed"), "heading", "ts", "tier")
    seen = zone_of(heard.select("mmsi", "lat", "lon"), zones).withColumn("ts", now)
    return Scan(upserts, moved, seen, rows)


def summary(judged: DataFrame) -> DataFrame:
    """Counts of what became of the heard vessels, by tier."""
    return judged.groupBy("tier").agg(F.count("*").alias("heard"), *[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("moved", "heartbeat", "phantom", "skipped")])


def upsert_vessels(vessel: DataFrame, upserts: DataFrame) -> DataFrame:
    """The snapshot after a scan's rows; at most one row a vessel.

    Static fields keep what is known, flags only rise, the first direct time stays; a forced row changes only speed,
    time and count; a heartbeat leaves the time of the last place.
    """
    o, n = vessel.alias("o"), upserts.alias("n")
    old, new = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    mode = new("mode")
    force, none = F.coalesce(mode == "force", F.lit(False)), mode.isNull()
    joined = o.join(n, F.col("o.mmsi") == F.col("n.mmsi"), "full_outer").filter(old("mmsi").isNotNull() | ~force)
    keep = none | force
    pick = lambda c, value: F.when(keep, old(c)).otherwise(value).alias(c)
    return joined.select(
        F.coalesce(old("mmsi"), new("mmsi")).alias("mmsi"), *[pick(c, F.coalesce(new(c), old(c))) for c in STATIC],
        pick("last_lat", new("lat")), pick("last_lon", new("lon")), F.when(none, old("last_speed")).otherwise(new("speed")).alias("last_speed"), pick("last_heading", new("heading")),
        F.when(mode == "moved", new("ts")).otherwise(old("last_pos_ts")).alias("last_pos_ts"), F.when(none, old("last_seen")).otherwise(new("ts")).alias("last_seen"), F.coalesce(old("first_seen"), new("ts")).alias("first_seen"),
        pick("of_interest", F.greatest(new("of_interest"), old("of_interest"))), pick("max_extent", new("max_extent")), pick("first_direct_at", F.coalesce(old("first_direct_at"), new("first_direct_at"))),
        pick("direct_entry_count", F.greatest(new("direct_entry_count"), old("direct_entry_count"))), F.when(none, old("times_seen")).otherwise(F.coalesce(old("times_seen"), F.lit(0)) + 1).alias("times_seen"),
    )


def enrich_static(vessel: DataFrame, updates: DataFrame) -> DataFrame:
    """Fill in static fields where one is missing; vessels that turn out large become of interest, and local."""
    u = updates.select("mmsi", F.lit(True).alias("hit"), *[F.col(c).alias(f"n_{c}") for c in STATIC])
    rows = vessel.join(u, "mmsi", "left")
    open_ = F.coalesce("hit", F.lit(False)) & (F.col("vessel_type").isNull() | F.col("length").isNull() | F.col("destination").isNull())
    large = vessels.is_large(F.col("n_vessel_type"), F.coalesce("n_length", "length"))
    out = {c: F.when(open_, F.coalesce(f"n_{c}", c)).otherwise(F.col(c)) for c in STATIC}
    out["of_interest"] = F.when(open_ & large, 1).otherwise(F.col("of_interest"))
    out["max_extent"] = F.when(open_ & large & (F.col("max_extent") == "direct"), "local").otherwise(F.col("max_extent"))
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in vessel.columns])


def upsert_zone_visits(visits: DataFrame, seen: DataFrame, throttle_ms: int = dims.ZONE_THROTTLE_MS) -> DataFrame:
    """Zone visits after one scan's observations: new pairs enter, known ones move on after the throttle."""
    o, n = visits.alias("o"), seen.alias("n")
    moved = F.col("n.ts").isNotNull() & (F.col("o.last_ts").isNull() | (F.col("n.ts") - F.col("o.last_ts") >= throttle_ms))
    pick = lambda new, old: F.when(moved, F.col(f"n.{new}")).otherwise(F.col(f"o.{old}")).alias(old)
    both = o.join(n, (F.col("o.mmsi") == F.col("n.mmsi")) & (F.col("o.zone_id") == F.col("n.zone_id")), "full_outer")
    return both.select(F.coalesce("o.mmsi", "n.mmsi").alias("mmsi"), F.coalesce("o.zone_id", "n.zone_id").alias("zone_id"), F.coalesce("o.first_ts", "n.ts").alias("first_ts"), pick("ts", "last_ts"), pick("lat", "lat"), pick("lon", "lon"))


def running(rows: DataFrame, order: tuple[str, ...], counted: dict[str, Column]) -> DataFrame:
    """Adds running totals of numbers in an order that ends in a unique column, each row's own number included.

    The rows are cut into ranges of the first column; totals of the ranges, at most RANGES + 1 rows, give each range what
    comes before it. The cuts are constants of the plan, so every use of it has the same ranges. Rows with one value of
    the first column are one range; nulls come first; a null number counts as none.
    """
    shares = [k / RANGES for k in range(1, RANGES)]
    cuts = sorted(set(rows.agg(F.percentile_approx(F.col(order[0]), shares)).first()[0] or []))
    place = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order[0]))), F.lit(0)) if cuts else F.lit(0)
    dealt = rows.withColumns({**{name: F.coalesce(number, F.lit(0)) for name, number in counted.items()}, "_range": place})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*[F.sum(name).alias(name) for name in counted])
    totals = totals.select("_range", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_before_{name}") for name in counted])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(totals), "_range")
    out = out.withColumns({name: F.sum(name).over(within) + F.col(f"_before_{name}") for name in counted})
    return out.drop("_range", *[f"_before_{name}" for name in counted])


def foreign(heard: DataFrame, state: DataFrame, visits: DataFrame, zones: DataFrame, scan_ts: int) -> DataFrame:
    """The verdict of a distant scan on each vessel heard in a zone: relevant, position, initial, small or skipped.

    Caps on positions and first rows a scan are part of the scan; they hold in order of arrival (column `arrival`).
    """
    z = zone_of(heard, zones).join(state.select("mmsi", F.lit(True).alias("old"), "o_interest", "o_type", "o_length", "o_ts", "o_seen"), "mmsi", "left").join(visits.select("mmsi", "zone_id", F.lit(True).alias("visited")), ["mmsi", "zone_id"], "left")
    fresh, interest = F.col("old").isNull(), F.coalesce(F.col("o_interest") == 1, F.lit(False))
    kind, length = F.coalesce("vessel_type", "o_type"), F.coalesce("length", "o_length")
    relevant = interest | vessels.is_inbound(kind, length, F.col("destination"))
    small = ~interest & fresh & vessels.is_confirmed_small(kind, length)
    stale = ~fresh & F.coalesce(scan_ts - F.col("o_ts") >= dims.FOREIGN_POSITION_MS, F.lit(False))
    z = z.withColumns({"small": small, "relevant": relevant & ~small, "wants_position": relevant & ~small & (F.col("visited").isNull() | stale), "wants_row": fresh & ~relevant & ~small, "refresh": fresh | F.coalesce(scan_ts - F.col("o_seen") >= dims.FOREIGN_REFRESH_MS, F.lit(False))})
    z = running(z, ("arrival", "mmsi"), {"n_position": F.col("wants_position").cast("int"), "n_row": F.col("wants_row").cast("int")})
    position = F.col("wants_position") & (F.col("n_position") <= dims.FOREIGN_MAX_POSITIONS)
    initial = F.col("wants_row") & (F.col("n_row") <= dims.FOREIGN_MAX_NEW)
    return z.select("mmsi", "zone_id", "lat", "lon", "relevant", "small", position.alias("position"), initial.alias("initial"), (initial | (F.col("relevant") & (F.col("refresh") | position))).alias("upsert"))


def rotation(n_zones: int, cursor: int, batch: int = dims.FOREIGN_BATCH) -> tuple[list[int], int]:
    """The zones of a distant scan, and where the next one starts."""
    start = cursor % n_zones
    picked = [(start + i) % n_zones for i in range(min(batch, n_zones))]
    return picked, (start + len(picked)) % n_zones


def lock_transition(holder: str | None, expires: int, asks: str, now: int, until: int) -> tuple[str, int] | None:
    """The lock's next (holder, expiry), or None while another holds it."""
    return (asks, until) if holder is None or holder == asks or expires <= now else None


def chunked(targets: DataFrame, order: tuple[str, ...], size: int = dims.GLOBAL_CHUNK) -> DataFrame:
    """Targets with the number of their chunk of `size`, in order."""
    return running(targets, order, {"chunk": F.lit(1)}).withColumn("chunk", F.floor((F.col("chunk") - 1) / size).cast("int"))


def rounds(targets: DataFrame, heard: DataFrame, most: int = dims.GLOBAL_ROUNDS) -> DataFrame:
    """Which round hears each target: each asks only for those not heard before (heard has mmsi and round)."""
    out, left = None, targets.select("mmsi")
    for k in range(1, most + 1):
        now = left.join(heard.filter(F.col("round") == k).select("mmsi"), "mmsi", "left_semi").withColumn("round", F.lit(k))
        out = now if out is None else out.unionAll(now)
        left = left.join(now.select("mmsi"), "mmsi", "left_anti")
    return out.unionAll(left.withColumn("round", F.lit(0)))
