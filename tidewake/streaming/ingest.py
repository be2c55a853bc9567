"""Streaming ingest: micro-batches of messages are scans, and vessels' state is a snapshot or keyed state.

`run` feeds raw messages through the same scan as in batch. A batch writes a new snapshot and its movement rows under its
number and then names that number in `current`; a batch that is run again overwrites its own files only.
`compressed` is the online compressor with the last kept fix of every vessel as keyed state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewake.functions import dims
from tidewake.operators import ingest
from tidewake.operators.stored import Folder
from tidewake.sources import ais

VESSELS = "mmsi bigint, name string, vessel_type int, length bigint, destination string, last_lat double, last_lon double, last_speed double, last_heading int, last_pos_ts bigint, last_seen bigint, first_seen bigint, of_interest int, max_extent string, first_direct_at bigint, direct_entry_count bigint, times_seen bigint"
POSITIONS = "id bigint, mmsi bigint, lat double, lon double, speed double, heading int, ts bigint, tier string"
VISITS = "mmsi bigint, zone_id string, first_ts bigint, last_ts bigint, lat double, lon double"
META = "key string, value bigint"
#: Steps from one version of a stored vessel table to the next: what each does, given the vessels and the positions. Tables
#: start as version 2, the first that has vessels and positions.
STEPS = {3: "direct_entry_count", 4: "max_extent"}
NEWEST = max(STEPS)


def _step(version: int, vessels: DataFrame, positions: DataFrame) -> DataFrame:
    """Vessels of one version from those of the version before."""
    if STEPS[version] == "direct_entry_count":  # new column: one entry for each vessel of interest
        return vessels.withColumn("direct_entry_count", F.when(F.col("of_interest") == 1, 1).otherwise(0).cast("bigint"))
    tiers = positions.groupBy("mmsi").agg(F.max(F.col("tier") == "global").alias("far"), F.max(F.col("tier") == "local").alias("near"))
    extent = F.when(F.col("far"), "global").when(F.col("near"), "local").otherwise("direct")
    return vessels.join(tiers, "mmsi", "left").withColumn("max_extent", F.when(F.col("of_interest") == 1, extent).otherwise(F.col("max_extent"))).drop("far", "near")


class Store:
    """Snapshots of vessels and zone visits by batch, and the movement log, below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.version = self._named()

    def _named(self) -> int | None:
        try:
            return self.spark.read.schema("batch bigint").json(f"{self.root}/current").agg(F.max("batch")).first()[0]
        except Exception as e:  # no batch has ended yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _read(self, name: str, schema: str) -> DataFrame:
        if self.version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/batch={self.version}")

    def vessels(self) -> DataFrame:
        if self.version is None or self.schema() == NEWEST:
            return self._read("vessels", VESSELS)
        return self.migrated()

    def schema(self) -> int:
        """Version of the stored tables' columns, as the last batch names it."""
        found = self.spark.read.schema("batch bigint, schema int").json(f"{self.root}/current").filter(F.col("batch") == self.version)
        return found.agg(F.max(F.coalesce("schema", F.lit(NEWEST)))).first()[0]

    def migrated(self) -> DataFrame:
        """Vessels of an older version after each later step in order; the next batch stores them, with the newest version."""
        had, rows = self.schema(), self.spark.read.parquet(f"{self.root}/vessels/batch={self.version}")
        for version in range(had + 1, NEWEST + 1):
            rows = _step(version, rows, self.positions())
        return _cast(rows, VESSELS)

    def meta(self) -> DataFrame:
        """(key, value): the time of the last scan of each kind and the cursors of rotating scans."""
        if self.version is None or not Folder(self.spark, self.root).exists(f"meta/batch={self.version}"):
            return self.spark.createDataFrame([], META)
        return self._read("meta", META)

    def visits(self) -> DataFrame:
        return self._read("visits", VISITS)

    def positions(self) -> DataFrame:
        if self.version is None:
            return self.spark.createDataFrame([], POSITIONS)
        return self.spark.read.schema(POSITIONS + ", batch bigint").parquet(f"{self.root}/positions").filter(F.col("batch") <= self.version).drop("batch")

    def commit(self, batch: int, vessels: DataFrame, positions: DataFrame, visits: DataFrame, meta: dict[str, int] | None = None) -> None:
        """Write a batch's tables and then its number; meta are the keys of scan state that change."""
        new = self.spark.createDataFrame(list((meta or {}).items()), META)
        state = new.unionByName(self.meta().join(new, "key", "left_anti"))
        for name, rows in (("vessels", vessels), ("positions", positions), ("visits", visits), ("meta", state)):
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
        self.spark.createDataFrame([(batch, NEWEST)], "batch bigint, schema int").write.mode("append").json(f"{self.root}/current")
        self.version = batch


def _cast(rows: DataFrame, schema: str) -> DataFrame:
    return rows.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(", ")])


def apply_scan(store: Store, batch: int, raw: DataFrame, kind: str, scan_ts: int, places: int = 0, step: int = 0) -> None:
    """One scan of raw messages (seq, value) against the store; a batch that is already in it changes nothing.

    The store notes the scan's time, and for scans that take `step` of `places` boxes in turn where the next begins.
    """
    if store.version is not None and batch <= store.version:
        return
    spark = raw.sparkSession
    merged = ais.merge(ais.parse(raw), ("mmsi",)).persist()
    zones, vessels, positions = dims.zones(spark), store.vessels(), store.positions()
    done = ingest.scan(kind, ais.complete(merged), ingest.states(vessels, positions), zones, scan_ts)
    after = ingest.upsert_vessels(vessels, done.upserts)
    static = merged.filter(~F.col("has_position") & F.col("has_static")).select("mmsi", *ingest.STATIC)
    log = done.positions.withColumn("id", F.lit(batch << 32).cast("bigint") + F.col("mmsi"))  # a vessel has one fix a scan
    meta = {f"last_scan_{kind}": scan_ts}
    if places:
        cursor = store.meta().filter(F.col("key") == f"cursor_{kind}").first()
        meta[f"cursor_{kind}"] = ((cursor["value"] if cursor else 0) + step) % places
    visits = ingest.upsert_zone_visits(store.visits(), done.zone_observations)
    store.commit(batch, _cast(ingest.enrich_static(after, static), VESSELS), _cast(log, POSITIONS), _cast(visits, VISITS), meta)
    merged.unpersist()


def run(messages: DataFrame, store: Store, kind: str, checkpoint: str, scan_ts=None, after=None):
    """Start a query that takes each micro-batch of messages (seq, value, scan_ts) as a scan.

    `after` is called with the store and a token once a batch is in the store, as the trail job is after a global scan. A
    batch that is run again after a restart calls it with the same token, so what it does under that token is done once.
    """

    def batch(raw: DataFrame, number: int) -> None:
        if not raw.isEmpty():
            now = scan_ts(number) if scan_ts else raw.agg(F.max("scan_ts")).first()[0]
            apply_scan(store, number, raw.select("seq", "value"), kind, now)
            if after:
                after(store, f"{kind}-{number}")

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _moves(s: tuple, r) -> bool:
    """The row form of significant_move for keyed state: s is the last kept (t, lat, lon, speed, heading)."""
    p, q = math.radians(s[1]), math.radians(r.lat)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(r.lon - s[2]) / 2) ** 2
    d, m = 2 * 3440.065 * math.asin(min(1.0, math.sqrt(h))), dims.MOVE[r.tier]
    if d < m["floor"]:
        return False
    factor = dims.LOW_VALUE_FACTOR if r.vessel_type in dims.LOW_VALUE_TYPES else 1
    was, now = s[3] or 0.0, 0.0 if pd.isna(r.speed) else r.speed
    turn = None if s[4] is None or pd.isna(r.heading) else abs(s[4] - r.heading) % 360
    turn = 360 - turn if turn is not None and turn > 180 else turn
    return d >= m["gap_nm"] * factor or r.t - s[0] >= m["gap_ms"] * factor or (turn is not None and turn >= m["turn"]) or abs(now - was) >= m["speed"] or (was > dims.MOVING_KN) != (now > dims.MOVING_KN)


def compressed(fixes: DataFrame) -> DataFrame:
    """(mmsi, id) of the fixes that the online compressor keeps, from a stream of fixes in time order by vessel."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, kept = (state.get if state.exists else None), []
        for r in pd.concat(batches).sort_values(["t", "id"]).itertuples():
            if last is None or _moves(last, r):
                last = (r.t, r.lat, r.lon, None if pd.isna(r.speed) else r.speed, None if pd.isna(r.heading) else int(r.heading))
                kept.append(r.id)
        state.update(last)
        yield pd.DataFrame({"mmsi": [key[0]] * len(kept), "id": kept}).astype("int64")

    return fixes.groupBy("mmsi").applyInPandasWithState(step, "mmsi bigint, id bigint", "t bigint, lat double, lon double, speed double, heading int", "append", GroupStateTimeout.NoTimeout)
