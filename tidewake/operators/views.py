"""The views that users ask for: live vessels, tracks, zones, reports and searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions import dims, vessels
from tidewake.functions.geo import rounded


def latest_position(positions: DataFrame) -> DataFrame:
    """The newest fix of every vessel; of equal times the one with the greatest id."""
    return positions.groupBy("mmsi").agg(F.max_by(F.struct("id", "lat", "lon", "speed", "heading", "ts", "tier"), F.struct("ts", "id")).alias("p")).select("mmsi", "p.*")


def current(vessel: DataFrame, positions: DataFrame, now_ms: int) -> DataFrame:
    """Vessels of interest that were seen lately, with their newest fix or what the snapshot has."""
    p = latest_position(positions).select("mmsi", *[F.col(c).alias(f"p_{c}") for c in ("lat", "lon", "speed", "heading", "ts")])
    live = reduce(lambda a, b: a | b, [(F.col("max_extent") == t) & (F.col("last_seen") >= now_ms - ms) for t, ms in dims.LIVE_MS.items()])
    chosen = vessel.filter((F.col("of_interest") == 1) & F.col("first_direct_at").isNotNull() & live)
    own = [F.coalesce(f"p_{c}", f"last_{c}").alias(c) for c in ("lat", "lon", "speed", "heading")]
    return chosen.join(p, "mmsi", "left").select("mmsi", "name", "vessel_type", "length", "destination", *own, F.coalesce("p_ts", "last_pos_ts").alias("last_pos_ts"), "last_seen", "max_extent", "first_direct_at", "direct_entry_count").orderBy(F.desc("last_seen"), "mmsi")


def track(positions: DataFrame, inferred: DataFrame, tiers: tuple[str, ...] = (), newest: int = 500) -> DataFrame:
    """Newest real fixes of every vessel and all inferred ones, newest first; no tiers means all."""
    order = Window.partitionBy("mmsi").orderBy(F.desc("ts"), F.desc("id"))
    wanted = [t for t in tiers if t in dims.TIERS]
    keep = (lambda d: d.filter(F.col("tier").isin(*wanted))) if wanted else (lambda d: d)
    real = keep(positions).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= newest).select("mmsi", "lat", "lon", "speed", "heading", F.col("ts").alias("t"), "tier", F.lit(False).alias("fake"))
    fake = keep(inferred).select("mmsi", "lat", "lon", F.lit(None).cast("double").alias("speed"), F.lit(None).cast("int").alias("heading"), "t", "tier", F.lit(True).alias("fake"))
    return real.unionByName(fake).orderBy("mmsi", F.desc("t"), "fake")


def zone_of(points: DataFrame, zones: DataFrame) -> DataFrame:
    """The points that lie in a zone, with the first such zone; the zone table is a fixed list of 54 rows."""
    z = F.broadcast(zones.select("ordinal", "zone_id", "south", "west", "north", "east"))
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    met = points.join(z, inside).drop("south", "west", "north", "east")
    keys = points.columns
    return met.groupBy(*keys).agg(F.min_by("zone_id", "ordinal").alias("zone_id"))


def zone_visits(points: DataFrame, zones: DataFrame, throttle_ms: int = dims.ZONE_THROTTLE_MS) -> DataFrame:
    """First and last time of each vessel in each zone, over a history of fixes.

    The last time moves only when the throttle has passed since it last moved, so it is a fold over the ordered fixes.
    """
    met = zone_of(points.select("id", "mmsi", "lat", "lon", "ts"), zones)
    seen = met.groupBy("mmsi", "zone_id").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "lat", "lon"))).alias("seen"))
    step = lambda s, x: F.when(x["ts"] - s["ts"] >= throttle_ms, x).otherwise(s)
    last = F.aggregate("seen", F.element_at("seen", 1), step)
    return seen.select("mmsi", "zone_id", F.element_at("seen", 1)["ts"].alias("first_ts"), last.alias("last")).select("mmsi", "zone_id", "first_ts", F.col("last.ts").alias("last_ts"), F.col("last.lat").alias("lat"), F.col("last.lon").alias("lon"))


def zones_rollup(visits: DataFrame) -> DataFrame:
    return visits.groupBy("zone_id").agg(F.count("*").alias("vessels"), F.max("last_ts").alias("most_recent"), F.min("first_ts").alias("earliest")).orderBy(F.desc("vessels"), "zone_id")


def decorated(visits: DataFrame, zones: DataFrame) -> DataFrame:
    """Zone visits with name and kind; an id that is no longer listed is its own name, of kind port."""
    z = F.broadcast(zones.select("zone_id", "zone_name", "kind"))
    return visits.join(z, "zone_id", "left").select("mmsi", "zone_id", F.coalesce("zone_name", "zone_id").alias("zone_name"), F.coalesce("kind", F.lit("port")).alias("kind"), "first_ts", "last_ts").orderBy("mmsi", F.desc("last_ts"), "zone_id")


def by_extent(vessel: DataFrame) -> DataFrame:
    """Vessels by extent, with their share of all vessels."""
    all_ = vessel.agg(F.count("*").alias("n"))
    return vessel.filter("max_extent is not null").groupBy("max_extent").agg(F.count("*").alias("cnt")).crossJoin(F.broadcast(all_)).select("max_extent", "cnt", rounded(F.try_divide(F.col("cnt") * 100.0, F.col("n")), 1).alias("pct"))


def by_type(vessel: DataFrame, least: int = 1) -> DataFrame:
    return vessel.filter("vessel_type is not null").groupBy("vessel_type").agg(F.count("*").alias("cnt"), F.sum("of_interest").alias("of_interest_cnt")).filter(F.col("cnt") >= least)


def tier_statistics(positions: DataFrame) -> DataFrame:
    return positions.groupBy("tier").agg(F.count("*").alias("pos_count"), F.countDistinct("mmsi").alias("distinct_vessels"), rounded(F.avg("speed"), 1).alias("avg_speed_kn"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def write_breakdown(positions: DataFrame) -> DataFrame:
    """Rows, vessels, days and rows a day, by tier and over all: one pass with grouping sets."""
    grouped = positions.rollup("tier").agg(F.grouping("tier").alias("g"), F.count("*").alias("position_rows"), F.countDistinct("mmsi").alias("vessels"), ((F.max("ts") - F.min("ts")) / 86_400_000.0).alias("days"))
    return grouped.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("tier")).alias("tier"), "position_rows", "vessels", rounded(F.col("days"), 2).alias("span_days"), F.floor(F.try_divide(F.col("position_rows"), F.col("days")) + 0.5).cast("bigint").alias("pos_writes_per_day"))


def statistics(vessel: DataFrame, positions: DataFrame) -> DataFrame:
    """Eleven numbers as rows, from one pass over each table."""
    count = lambda c: F.count(F.when(c, 1))
    v = vessel.agg(F.count("*").alias("total_vessels"), F.coalesce(F.sum("of_interest"), F.lit(0)).alias("of_interest"), (F.count("*") - F.coalesce(F.sum("of_interest"), F.lit(0))).alias("not_of_interest"), *[count(F.col("max_extent") == t).alias(f"max_extent_{t}") for t in dims.TIERS])
    p = positions.agg(F.count("*").alias("total_positions"), *[count(F.col("tier") == t).alias(f"{t}_positions") for t in dims.TIERS], F.countDistinct("mmsi").alias("vessels_with_positions"))
    both = v.crossJoin(p)
    return both.unpivot([], both.columns, "metric", "value").withColumn("value", F.col("value").cast("bigint"))


def search(vessel: DataFrame, term: str, limit: int = 30) -> DataFrame:
    """Vessels whose number starts with the term or whose name holds it; a term of digits ranks numbers first.

    Percent signs and underscores of the term are wildcards; a backslash is itself.
    """
    number, name = F.col("mmsi").cast("string"), F.upper(F.coalesce("name", F.lit("")))
    term = term.replace("\\", "\\\\")
    match, rank = name.like(f"%{term.upper()}%"), []
    if term.isdigit():
        match, rank = match | number.like(f"{term}%"), [F.when(number == term, 0).when(number.like(f"{term}%"), 1).otherwise(2)]
    return vessel.filter(match).orderBy(*rank, F.desc("last_seen"), "mmsi").limit(limit).select("mmsi", "name", "vessel_type", "length", "of_interest", "max_extent", "last_seen")


def stale(vessel: DataFrame, now_ms: int, hours: int) -> DataFrame:
    """Vessels not seen for some hours, by true epoch arithmetic."""
    return vessel.filter(F.col("last_seen") < now_ms - hours * 3_600_000).select("mmsi", "name", "vessel_type", "length", "of_interest", "last_seen", F.floor((now_ms - F.col("last_seen")) / 3_600_000.0).alias("hours_ago"))


def global_priority(vessel: DataFrame, now_ms: int, stale_ms: int = 1_800_000) -> DataFrame:
    """Vessels of interest in the order in which a distant scan asks for them."""
    old = F.col("last_seen") < now_ms - stale_ms
    e = F.col("max_extent")
    rank = F.when(e == "global", 0).when((e == "local") & old, 1).when((e == "direct") & old, 2).when(e == "local", 3).when(e == "direct", 4).otherwise(5)
    return vessel.filter("of_interest = 1").select("mmsi", "max_extent", "last_seen", rank.alias("priority")).orderBy("priority", "last_seen", "mmsi")


def listed(vessel: DataFrame, iso2: Column, distance: Column) -> DataFrame:
    """The rows of the list page with their sort keys: missing speeds as -1, missing countries as empty."""
    return vessel.select("mmsi", F.coalesce("name", F.lit("")).alias("name"), F.coalesce(iso2, F.lit("")).alias("country"), rounded(distance).alias("distance_nm"), F.coalesce("last_speed", F.lit(-1.0)).alias("speed"), vessels.display_class(F.col("mmsi"), F.col("name"), F.col("vessel_type"), F.col("length")).alias("category"))
