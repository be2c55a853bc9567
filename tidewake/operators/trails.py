"""The trail job: control points over water, their repair, and the stored points that a trail needs.

A trail is a vessel's fixes and the inferred points between them, cut into journeys, with a curve through each journey.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions import dims, geo, vessels
from tidewake.operators import coast, listings, routing, tracks
from tidewake.operators.stored import Parts, saved

#: Rings around a place, km from one to the next and the furthest, and places on a ring; fixed values.
WATER_RINGS, DEPTH_RINGS, MARGIN_KM = (0.1, 3.0, 24), (0.05, 2.0, 16), 0.2
REPAIRS = 6
PLACE = "struct<lat:double,lon:double>"


def first_water(lat: np.ndarray, lon: np.ndarray, land: routing.Land, rings: tuple[float, float, int]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the first ring around each place that touches water, from 1, and the place on it; 0 if none does."""
    step, most, places = rings
    ring, place = np.zeros(lat.shape, int), np.zeros(lat.shape, int)
    angle = np.arange(places) / places * 2 * np.pi
    for k in range(1, round(most / step) + 1):
        todo = np.flatnonzero(ring == 0)
        if not len(todo):
            break
        y, x = offset(lat[todo, None], lon[todo, None], step * k, angle)
        wet = ~land.is_land(y.ravel(), x.ravel()).reshape(y.shape)
        met = wet.any(axis=1)
        ring[todo[met]], place[todo[met]] = k, wet[met].argmax(axis=1)
    return ring, place


def offset(lat, lon, km, angle):
    """Places some km away, counted from the east to the north."""
    return lat + km / routing.KM * np.sin(angle), lon + km / (routing.KM * np.cos(np.radians(lat))) * np.cos(angle)


def nearest_water(lat: Column, lon: Column, land: routing.Land) -> Column:
    """A place in the nearest water, a little further out than the shore; null if there is none within 3 km."""

    @F.pandas_udf(PLACE)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        y, x = a.to_numpy(float), b.to_numpy(float)
        ring, place = first_water(y, x, land, WATER_RINGS)
        found = offset(y, x, WATER_RINGS[0] * ring + MARGIN_KM, place / WATER_RINGS[2] * 2 * np.pi)
        return pd.DataFrame({c: np.where(ring > 0, v, np.nan) for c, v in zip(("lat", "lon"), found)})

    out = run(lat, lon)
    return F.when(out["lat"].isNotNull() & ~F.isnan(out["lat"]), out)


def depth_km(lat: Column, lon: Column, land: routing.Land) -> Column:
    """How far a place on land lies from water, by rings of 50 m; 2 km at most."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        ring, _ = first_water(a.to_numpy(float), b.to_numpy(float), land, DEPTH_RINGS)
        return pd.Series(np.where(ring > 0, DEPTH_RINGS[0] * ring, DEPTH_RINGS[1]))

    return run(lat, lon)


def in_polygons(points: DataFrame, rings: DataFrame, degrees: float = 0.25) -> DataFrame:
    """The points with the (region, ring_id) of each ring that holds them: places by cells and edges by bands of latitude."""
    held = coast.places_in_rings(points, rings.select("region", "ring_id", "ring"), ("region", "ring_id"), degrees=degrees)
    return points.join(held, ["lat", "lon"]).select(*points.columns, "region", "ring_id")


def numbered(points: DataFrame) -> DataFrame:
    """Points with numbers of their own, in the order of time."""
    return points.withColumn("id", F.row_number().over(Window.partitionBy("mmsi").orderBy("t", "id")).cast("bigint"))


POINT = ("mmsi", "journey", "id", "t", "lat", "lon", "fake")


def control_points(fixes: DataFrame, land: routing.Land, denoise: bool = True, routed: bool = True) -> DataFrame:
    """(mmsi, journey, id, t, lat, lon, fake): smoothed fixes, and the ways over water across gaps that cross land.

    Points that come within 20 m of the last one of their journey are left out. Without `routed` all lines are straight.
    """
    ashore = lambda lat, lon: routing.is_land(lat, lon, land)
    track = tracks.journeys(tracks.dedup(fixes))
    real = saved(tracks.denoised(track, ashore) if denoise else track)
    points = real.select("mmsi", "journey", "id", F.col("t").cast("double").alias("t"), "lat", "lon", F.coalesce("fake", F.lit(False)).alias("fake"))
    if routed:
        gaps = saved(routing.crossing_gaps(real, land).withColumn("segment", vessels.segment_key(F.col("a_t"), F.col("b_t"), F.col("length"))))
        way = routing.water_routes(gaps, land, full=True).join(gaps.select("mmsi", "segment", "journey"), ["mmsi", "segment"])
        points = points.unionByName(way.select("mmsi", "journey", F.col("seq").cast("bigint").alias("id"), "t", "lat", "lon", F.lit(True).alias("fake")))
    points = saved(numbered(points))
    apart = lambda s, x: (s["journey"] != x["journey"]) | (geo.haversine_km(s["lat"], s["lon"], x["lat"], x["lon"]) > dims.DEDUP_KM)
    kept = tracks.folded(points, apart, ("lat", "lon", "journey")).select("mmsi", F.explode("kept").alias("id"))
    return points.join(kept, ["mmsi", "id"], "left_semi").select(*POINT)


def _with_shore(points: DataFrame, land: routing.Land) -> DataFrame:
    """Points with the number of land samples of their journey's curve."""
    samples = tracks.spline(points)
    count = samples.filter(routing.is_land(F.col("lat"), F.col("lon"), land)).groupBy("mmsi", "journey").agg(F.count("*").alias("ashore"))
    return points.join(count, ["mmsi", "journey"], "left").withColumn("ashore", F.coalesce("ashore", F.lit(0)))


def _edited(points: DataFrame, land: routing.Land) -> DataFrame:
    """One pass of repair: see `repaired`."""
    ashore = lambda p: routing.is_land(F.col(f"{p}.lat"), F.col(f"{p}.lon"), land)
    samples = tracks.spline(points).filter(routing.is_land(F.col("lat"), F.col("lon"), land))
    bad = samples.groupBy("mmsi", "id").agg(F.sort_array(F.collect_list(F.struct("i", "lat", "lon"))).alias("on"))  # at most the samples of a piece
    w = tracks.ordered("journey")
    place = F.struct("t", "lat", "lon", "fake", "id")
    pieces = points.withColumns({"n": F.row_number().over(w), "a": place, "b": F.lead(place).over(w)}).filter("b is not null").join(bad, ["mmsi", "id"])
    pieces = pieces.withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy("mmsi", "journey").orderBy("n")))
    middle = F.element_at("on", F.floor((F.size("on") + 1) / 2).cast("int"))
    runs = pieces.groupBy("mmsi", "journey", "island").agg(F.min_by("a", "n").alias("a"), F.max_by("b", "n").alias("b"))
    runs = runs.filter(~ashore("a") & ~ashore("b")).withColumn("segment", vessels.segment_key(F.col("a.t"), F.col("b.t"), F.lit(None).cast("int")))
    crossing = routing.crosses_land(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"), land)
    runs = saved(runs.withColumn("blocked", crossing))
    none = F.lit(None).cast("double")
    ends = [F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in ("t", "lat", "lon")]
    way = routing.water_routes(runs.filter("blocked").select("mmsi", *ends, none.alias("entry"), none.alias("leave"), F.lit(None).cast("int").alias("length")), land, full=True)
    way = saved(way.join(runs, ["mmsi", "segment"]).select("mmsi", "journey", "segment", "a", "b", "seq", "t", "lat", "lon"))
    routed = way.select("mmsi", "segment").distinct()
    inner = way.filter("seq = 0").select(F.col("mmsi").alias("m"), F.col("journey").alias("j"), F.col("a.t").alias("from"), F.col("b.t").alias("to"))
    keep = points.join(inner, (F.col("mmsi") == F.col("m")) & (F.col("journey") == F.col("j")) & (F.col("t") > F.col("from")) & (F.col("t") < F.col("to")), "left_anti")
    pulled = pieces.join(runs.join(routed, ["mmsi", "segment"], "left_anti").select("mmsi", "journey", "island"), ["mmsi", "journey", "island"])
    pulled = pulled.select("mmsi", "journey", middle.alias("at"), "a", "b").withColumn("water", nearest_water(F.col("at.lat"), F.col("at.lon"), land)).filter("water is not null")
    time = F.col("a.t") + (F.col("b.t") - F.col("a.t")) * F.col("at.i") / float(dims.SPLINE_SAMPLES)
    new = way.select("mmsi", "journey", F.col("seq").cast("bigint").alias("id"), "t", "lat", "lon", F.lit(True).alias("fake"))
    new = new.unionByName(pulled.select("mmsi", "journey", F.lit(0).cast("bigint").alias("id"), time.alias("t"), "water.lat", "water.lon", F.lit(True).alias("fake")))
    return numbered(keep.select(*POINT).unionByName(new))


def repaired(points: DataFrame, land: routing.Land, passes: int = REPAIRS) -> DataFrame:
    """Control points whose curves keep off land as well as a few passes can make them, with `ashore`, the samples left on land.

    Neighbouring pieces of a curve that touch land form a run. A run with an end on land stays, as the coastline is wrong
    there. If the line between its ends crosses land, the points inside give way to a way over water; if not, each piece
    gets a point in the nearest water. A journey keeps a pass only if fewer of its samples are on land, and ends with the
    first pass that does not help.
    """
    done = saved(_with_shore(points, land).withColumn("open", F.col("ashore") > 0))
    for _ in range(passes):
        live = done.filter("open")
        if live.isEmpty():
            break
        after = saved(_with_shore(_edited(live.select(*POINT), land), land))
        key = ["mmsi", "journey"]
        better = after.select(*key, F.col("ashore").alias("now")).distinct().join(live.select(*key, "ashore").distinct(), key).filter("now < ashore").select(*key)
        kept = live.join(better, key, "left_anti").withColumn("open", F.lit(False))
        done = saved(done.filter("not open").unionByName(kept).unionByName(after.join(better, key, "left_semi").withColumn("open", F.col("ashore") > 0)))
    return done.select(*POINT, "ashore")


def runs_of(fixes: DataFrame, land: routing.Land, routed: bool = True) -> DataFrame:
    """Stretches of real and inferred curve of every trail, over water or straight."""
    points = control_points(fixes, land, routed=routed)
    return tracks.stretches(repaired(points, land) if routed else points)


@dataclass
class Changes:
    """What the job changes in the store: segments that go, points that come, and vessels that are up to date."""

    delete: DataFrame
    insert: DataFrame
    state: DataFrame


def due(vessel: DataFrame, state: DataFrame, regenerate: bool = False, only: int | None = None, limit: int | None = None) -> DataFrame:
    """Vessels of interest with a newer fix than their trail was made from (state: mmsi, done); regenerate takes all.

    A limit takes those that were seen last first; `only` is one vessel's number.
    """
    wanted = vessel.filter("of_interest = 1 and first_direct_at is not null and last_pos_ts is not null")
    wanted = wanted if only is None else wanted.filter(F.col("mmsi") == only)
    if not regenerate:
        wanted = wanted.join(state, "mmsi", "left").filter("done is null or last_pos_ts > done")
    seen = "last_seen" if "last_seen" in vessel.columns else "last_pos_ts"
    return (wanted if limit is None else wanted.orderBy(F.desc(seen), "mmsi").limit(limit)).select("mmsi", "last_pos_ts")


def converged(fixes: DataFrame, stored: DataFrame, land: routing.Land) -> DataFrame:
    """(mmsi): vessels whose curve through fixes and stored points (mmsi, segment, seq, t, lat, lon, tier) keeps off land."""
    number = -F.row_number().over(Window.partitionBy("mmsi").orderBy("t", "segment", "seq"))
    fake = stored.select("mmsi", number.cast("bigint").alias("id"), F.col("t").cast("double").alias("t"), "lat", "lon", F.lit(None).cast("double").alias("speed"), "tier", F.lit(True).alias("fake"))
    real = fixes.select("mmsi", "id", F.col("t").cast("double").alias("t"), "lat", "lon", "speed", "tier", F.lit(False).alias("fake"))
    track = tracks.journeys(tracks.dedup(real.unionByName(fake)))
    long = track.withColumn("points", F.count("*").over(Window.partitionBy("mmsi", "journey"))).filter("points > 1")
    curve = tracks.spline(long).select("mmsi", F.concat_ws("/", "id", "i").alias("id"), "lat", "lon")
    free = listings.curve_land_free(curve, real, lambda lat, lon: routing.is_land(lat, lon, land))
    return free.filter("land_free").select("mmsi")


def job(fixes: DataFrame, vessel: DataFrame, stored: DataFrame, state: DataFrame, land: routing.Land, regenerate: bool = False, only: int | None = None, limit: int | None = None) -> Changes:
    """Brings the stored points up to date for vessels with newer fixes whose curves cross land.

    Only segments that are new are inserted; a segment with the same ends and length stays as it is. A vessel with a
    single fix is only noted. The tier of a segment is the wider one of its ends. With `regenerate` all segments of the
    vessels are written anew.
    """
    todo = due(vessel, state, regenerate, only, limit)
    points = fixes.join(todo, "mmsi", "left_semi")
    some = points.groupBy("mmsi").count().filter("count > 1").select("mmsi")
    old = stored.join(todo, "mmsi", "left_semi")
    open_ = saved(some.join(converged(points, old, land), "mmsi", "left_anti"))
    gaps = saved(routing.land_gaps(points.join(open_, "mmsi", "left_semi"), land).withColumn("segment", vessels.segment_key(F.col("a_t"), F.col("b_t"), F.col("length"))))
    want = saved(routing.water_routes(gaps, land).join(gaps.select("mmsi", "segment", vessels.wider(F.col("a_tier"), F.col("b_tier")).alias("tier")), ["mmsi", "segment"]))
    have, key = old.join(open_, "mmsi", "left_semi").select("mmsi", "segment").distinct(), ["mmsi", "segment"]
    insert = (want if regenerate else want.join(have, key, "left_anti")).select("mmsi", "segment", "seq", "t", "lat", "lon", "tier")
    return Changes(have.join(want, key, "left_anti"), insert, todo.withColumnRenamed("last_pos_ts", "done"))


def applied(stored: DataFrame, delete: DataFrame, insert: DataFrame) -> DataFrame:
    """The store after a job: whole segments go and come, so applying the same changes twice changes nothing."""
    gone = delete.select("mmsi", "segment").unionByName(insert.select("mmsi", "segment")).distinct()
    return stored.join(gone, ["mmsi", "segment"], "left_anti").unionByName(insert)


class TrailStore:
    """Inferred points, their segments, and the state of the trail job, as tables of parts below one folder.

    State is written last: a job that dies in between finds its vessels still due, and writes the same segments again.
    """

    def __init__(self, spark: SparkSession, root: str, count: int = 64):
        self.points = Parts(spark, f"{root}/inferred_positions", "mmsi bigint, segment string, seq int, t double, lat double, lon double, tier string", ("mmsi", "segment"), F.pmod(F.xxhash64("mmsi"), F.lit(count)))
        self.segments = Parts(spark, f"{root}/inferred_segments", "mmsi bigint, segment string, points bigint, t_first double, t_last double, tier string", ("mmsi", "segment"), F.pmod(F.xxhash64("mmsi"), F.lit(count)))
        self.state = Parts(spark, f"{root}/precompute_state", "mmsi bigint, done bigint", ("mmsi",), count=count)

    def apply(self, changes: Changes, token: str) -> None:
        """Write what a job has decided; whatever of it is there already stays as it is."""
        insert, state = saved(changes.insert), saved(changes.state)
        gone = saved(changes.delete.select("mmsi", "segment"))
        of_segment = insert.groupBy("mmsi", "segment").agg(F.count("*").alias("points"), F.min("t").alias("t_first"), F.max("t").alias("t_last"), F.first("tier").alias("tier"))
        self.points.replace(insert, gone, token)
        self.segments.replace(of_segment, gone, token)
        self.state.replace(state, None, token)

    def run(self, fixes: DataFrame, vessel: DataFrame, land: routing.Land, token: str, **how) -> bool:
        """The whole job under a token, once: whether it had to run."""
        if token in self.state.manifest()["tokens"]:
            return False
        self.apply(job(fixes, vessel, self.points.read(), self.state.read(), land, **how), token)
        return True
