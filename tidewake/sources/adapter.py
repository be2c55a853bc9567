"""Vessel fixes from the `events` table: a deterministic track for every user, as positions, vessels and messages.

The table has no vessels, so a template maps a user's events to a track through the direct, local and distant waters.
`fast` runs the clock 240 times as fast, so that gaps between fixes are minutes and not hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions import dims, vessels

#: {ms}: epoch milliseconds, {k}: the number in props, {events}: the table.
TEMPLATE = """
SELECT event_id, 316000000 + user_id AS mmsi, {ms} AS ts, seq,
       CASE WHEN user_id % 4 = 0 THEN 48.10E0 + (user_id % 10) * 3E-2 + 1.1E-3 * seq
            WHEN user_id % 4 = 1 THEN 49.00E0 + (user_id % 9) * 2E-2 + 9.0E-3 * seq
            WHEN user_id % 8 = 2 THEN 48.05E0 + 1.1E-3 * seq
            WHEN user_id % 8 = 6 THEN 48.05E0 + 6.6E-3 * floor(seq / 6E0)
            ELSE 33.61E0 + (user_id % 5) * 2E-2 + 2.1E-3 * seq END AS lat,
       CASE WHEN user_id % 4 = 0 THEN -123.60E0 + (user_id % 7) * 5E-2 + 7E-4 * seq
            WHEN user_id % 4 = 1 THEN -123.95E0 + (user_id % 6) * 2E-2 + 1.1E-2 * seq
            WHEN user_id % 8 = 2 THEN -123.48E0 + 5E-4 * seq
            WHEN user_id % 8 = 6 THEN -123.48E0 + 3E-3 * floor(seq / 6E0)
            ELSE -118.32E0 + (user_id % 6) * 2E-2 + 1.3E-3 * seq END AS lon,
       CASE WHEN k < 8 THEN 2E-1 WHEN k < 16 THEN 14E0 ELSE 10E0 + (k % 4) * 2E-1 END AS speed,
       CASE WHEN k % 10 = 0 THEN NULL WHEN k % 7 = 0 THEN (k * 37) % 360 ELSE 25 END AS heading,
       CASE user_id % 8 WHEN 0 THEN 30 WHEN 1 THEN 31 WHEN 2 THEN 36 WHEN 3 THEN 52 WHEN 4 THEN 60 WHEN 5 THEN 70 WHEN 6 THEN 80 ELSE NULL END AS vessel_type,
       NULLIF(user_id % 13, 0) * 20 AS length,
       CASE user_id % 11 WHEN 0 THEN 'WSF TACOMA' WHEN 1 THEN 'QUEEN OF SURREY' WHEN 2 THEN 'MSC AURORA' WHEN 3 THEN 'CCGS TULLY' WHEN 4 THEN NULL WHEN 5 THEN 'RV OCEAN' WHEN 6 THEN 'CELEBRITY EDGE' WHEN 7 THEN 'Pacific Joy' ELSE concat('VESSEL ', CAST(user_id AS {text})) END AS name,
       CASE user_id % 6 WHEN 0 THEN 'VANCOUVER BC' WHEN 1 THEN 'USSEA' WHEN 2 THEN 'TOKYO' WHEN 3 THEN NULL WHEN 4 THEN 'port of tacoma' ELSE 'SINGAPORE' END AS destination
FROM (SELECT *, {k} AS k, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq FROM {events}) x
"""
EPOCH_MS, FAST = 1704067200000, 240
#: The instant that stands for now in queries on this table.
NOW_MS = 1706572800000


def fixes(spark: SparkSession, sf_dir: str, fast: bool = False) -> DataFrame:
    """event_id, mmsi, ts (epoch ms), seq, lat, lon, speed, heading, vessel_type, length, name, destination, tier."""
    ms = "unix_micros(CAST(ts AS TIMESTAMP)) div 1000"
    if fast:
        ms = f"{EPOCH_MS} + CAST(floor(({ms} - {EPOCH_MS}) / {FAST}E0) AS BIGINT)"
    sql = TEMPLATE.format(ms=ms, k="CAST(get_json_object(props, '$.k') AS INT)", text="STRING", events="{events}")
    out = spark.sql(sql, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return out.withColumn("tier", vessels.tier_of(F.col("lat"), F.col("lon")))


def positions(fix: DataFrame) -> DataFrame:
    """The movement log: one row per fix."""
    return fix.select(F.col("event_id").alias("id"), "mmsi", "lat", "lon", "speed", "heading", "ts", "tier")


def vessel_table(fix: DataFrame) -> DataFrame:
    """The vessel snapshot after all fixes have been seen."""
    last = F.max_by(F.struct("lat", "lon", "speed", "heading"), F.struct("ts", "event_id"))
    direct = F.col("tier") == "direct"
    before = F.lag("tier").over(Window.partitionBy("mmsi").orderBy("ts", "event_id"))
    entered = F.when(direct & ~F.coalesce(before == "direct", F.lit(False)), 1).otherwise(0)
    seen = fix.withColumn("entered", entered).groupBy("mmsi").agg(
        F.max("name").alias("name"), F.max("vessel_type").alias("vessel_type"), F.max("length").alias("length"), F.max("destination").alias("destination"),
        last.alias("at"), F.max("ts").alias("last_seen"), F.min("ts").alias("first_seen"), F.max(F.when(direct, 1).otherwise(0)).alias("of_interest"),
        F.max(vessels.extent_rank(F.col("tier"))).alias("rank"), F.min(F.when(direct, F.col("ts"))).alias("first_direct_at"),
        F.sum("entered").alias("direct_entry_count"), F.count("*").alias("times_seen"),
    )
    extent = F.element_at(F.array(*map(F.lit, dims.TIERS)), F.col("rank") + 1)
    return seen.select("mmsi", "name", "vessel_type", "length", "destination", F.col("at.lat").alias("last_lat"), F.col("at.lon").alias("last_lon"), F.col("at.speed").alias("last_speed"), F.col("at.heading").alias("last_heading"), F.col("last_seen").alias("last_pos_ts"), "last_seen", "first_seen", "of_interest", extent.alias("max_extent"), "first_direct_at", "direct_entry_count", "times_seen")


def messages(fix: DataFrame, hours: int = 1) -> DataFrame:
    """Raw text messages of drains: a position report for every fix, and static data for every fifth."""
    scan, order = F.floor(F.col("ts") / (hours * 3_600_000.0)).alias("scan_id"), F.col("event_id")
    report = F.to_json(F.struct(F.lit("PositionReport").alias("MessageType"), F.struct(F.col("mmsi").alias("MMSI"), F.coalesce("name", F.lit(" ")).alias("ShipName"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("MetaData"), F.struct(F.struct(F.col("speed").alias("Sog"), F.coalesce("heading", F.lit(511)).alias("TrueHeading")).alias("PositionReport")).alias("Message")))
    static = F.to_json(F.struct(F.lit("ShipStaticData").alias("MessageType"), F.struct(F.col("mmsi").alias("MMSI")).alias("MetaData"), F.struct(F.struct(F.coalesce("vessel_type", F.lit(0)).alias("Type"), F.struct(F.coalesce("length", F.lit(0)).alias("A"), F.lit(0).alias("B")).alias("Dimension"), F.coalesce("destination", F.lit("")).alias("Destination"), F.coalesce("name", F.lit("")).alias("Name")).alias("ShipStaticData")).alias("Message")))
    first = fix.select(scan, (order * 2).alias("seq"), report.alias("value"))
    return first.unionAll(fix.filter("event_id % 5 = 0").select(scan, (order * 2 + 1).alias("seq"), static.alias("value")))
