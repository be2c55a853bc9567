"""Listings in order with a limit, filters of what is shown, and rules on the points of a trail."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions import geo, vessels

#: Labels and colours of the shown classes; fixed values.
LABELS = {"ferry": "Ferry", "cruise": "Cruise Ship", "cargo": "Cargo", "tanker": "Tanker", "tug": "Tug / Service", "fishing": "Fishing", "pleasure": "Pleasure Craft", "government": "Government", "military": "Military", "unknown": "Unknown"}
COLOURS = {"cargo": "#ea580c", "tanker": "#dc2626", "cruise": "#facc15", "ferry": "#06b6d4", "military": "#3b82f6", "fishing": "#22c55e", "government": "#8b5cf6", "pleasure": "#ec4899", "tug": "#78716c", "unknown": "#525252"}
#: Points of a chunk of a faded trail; the next chunk starts with its last point.
FADED = 8
#: A curve on land is trusted this near to a fix that is on land itself, km.
TRUST_KM = 1.5


def valid_mmsi(text: Column) -> Column:
    """A number of six to nine digits without a leading zero."""
    return F.coalesce(text.rlike("^[1-9][0-9]{5,8}$"), F.lit(False))


def positive_int(text: Column) -> Column:
    return F.coalesce(text.rlike("^[1-9][0-9]*$"), F.lit(False))


def looked_up(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])[key]


def passes_extent(max_extent: Column, entries: Column, shown: Iterable[str]) -> Column:
    """Only journey classes that are switched on."""
    return vessels.journey_class(max_extent, entries).isin(*shown)


def passes_type(category: Column, hidden: Iterable[str]) -> Column:
    """All shown classes but those that are switched off."""
    return ~category.isin(*hidden)


def in_boxes(lat: Column, lon: Column, boxes: Iterable[tuple[float, float, float, float]]) -> Column:
    """In any of the boxes."""
    out = F.lit(False)
    for box in boxes:
        out = out | geo.in_box(lat, lon, box)
    return out


def newest(rows: DataFrame, by: str, limit: int, tie: str) -> DataFrame:
    """The rows with the largest `by`, newest first: Spark keeps `limit` rows of each task, no full sort."""
    return rows.orderBy(F.desc(by), tie).limit(limit)


def timeline(positions: DataFrame, vessel: DataFrame, limit: int, tier: str | None = None, mmsi: int | None = None) -> DataFrame:
    """The newest positions, of a tier or a vessel if given, with names; names are joined to the limited rows only."""
    some = positions if tier is None else positions.filter(F.col("tier") == tier)
    some = some if mmsi is None else some.filter(F.col("mmsi") == mmsi)
    top = newest(some, "ts", limit, "id")
    return top.join(vessel.select("mmsi", "name"), "mmsi", "left").select("id", "mmsi", "name", "lat", "lon", "speed", "heading", "tier", F.col("ts").alias("ts_utc")).orderBy(F.desc("ts_utc"), "id")


def page(listed: DataFrame, key: str, descending: bool, limit: int) -> DataFrame:
    """A page of the list, by any of its keys in either direction."""
    return listed.orderBy(F.desc(key) if descending else F.asc(key), "mmsi").limit(limit)


def turns(fixes: DataFrame) -> DataFrame:
    """The turn at each fix that has one before and one after, in [0, 180] degrees."""
    w = Window.partitionBy("mmsi").orderBy("ts", "event_id")
    a, c = (lambda x: F.lag(x).over(w)), (lambda x: F.lead(x).over(w))
    turn = geo.heading_delta(geo.bearing_deg(F.col("lat"), F.col("lon"), c("lat"), c("lon")), geo.bearing_deg(a("lat"), a("lon"), F.col("lat"), F.col("lon")))
    return fixes.select("event_id", "mmsi", turn.alias("turn")).filter("turn is not null")


def boxes_of(rings: DataFrame) -> DataFrame:
    """The box of each ring (region, ring_id, ring)."""
    of = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    return rings.select("region", "ring_id", F.size("ring").alias("vertices"), of(F.array_min, "lat").alias("south"), of(F.array_min, "lon").alias("west"), of(F.array_max, "lat").alias("north"), of(F.array_max, "lon").alias("east"))


def faded(samples: DataFrame, fade: float) -> DataFrame:
    """(mmsi, chunk, opacity) of the chunks of a trail (mmsi, t, id): from the time of a chunk's middle point."""
    w = Window.partitionBy("mmsi")
    i = F.row_number().over(w.orderBy("t", "id")) - 1
    rows = samples.select("mmsi", "t", i.alias("i"), F.count("*").over(w).alias("n"), F.min("t").over(w).alias("t0"), F.max("t").over(w).alias("t1"))
    start = F.floor(F.col("i") / FADED) * FADED
    middle = start + F.floor((F.least(start + FADED + 1, F.col("n")) - start - 1) / 2)
    along = F.try_divide((F.col("t") - F.col("t0")).cast("double"), (F.col("t1") - F.col("t0")).cast("double"))
    opacity = F.coalesce(fade * 0.1 + fade * 0.9 * along, F.lit(fade))
    return rows.filter((start < F.col("n") - 1) & (F.col("i") == middle)).select("mmsi", F.floor(F.col("i") / FADED).alias("chunk"), geo.rounded(opacity).alias("opacity"))


def signatures(samples: DataFrame) -> DataFrame:
    """One text a trail (mmsi, t, id, lat, lon): points, first and last time, and the last place in 1e-5 degrees."""
    e5 = lambda c: F.floor(F.col(f"last.{c}") * 1e5 + 0.5).cast("string")
    by = samples.groupBy("mmsi").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.max(F.struct("t", "id", "lat", "lon")).alias("last"))
    return by.select("mmsi", F.concat_ws("|", F.col("n").cast("string"), F.col("t0").cast("string"), F.col("t1").cast("string"), F.concat_ws(",", e5("lat"), e5("lon"))).alias("signature"))


def runs(samples: DataFrame, flag: Column) -> DataFrame:
    """Runs of samples (mmsi, t, id) for which the flag holds: first and last number and time."""
    w = Window.partitionBy("mmsi").orderBy("t", "id")
    rows = samples.select("mmsi", "t", "id", flag.alias("on"), (F.row_number().over(w) - 1).alias("i"))
    rows = rows.withColumn("run", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(w)).filter("on")
    return rows.groupBy("mmsi", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min("t").alias("t0"), F.max("t").alias("t1")).drop("run")


def trusted(samples: DataFrame, reals: DataFrame, km: float = TRUST_KM, how: str = "left_semi") -> DataFrame:
    """The samples (mmsi, lat, lon) with a fix of their vessel within some km, or with left_anti those without: joined by
    bands of latitude."""
    band = km / 111.0
    cell = lambda c: F.floor(F.col(c) / band).cast("bigint")
    near = reals.select(F.col("mmsi").alias("m"), F.col("lat").alias("y"), F.col("lon").alias("x")).distinct().select("m", "y", "x", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)).alias("band"))
    keyed = samples.withColumn("cell", cell("lat"))
    close = geo.haversine_km(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")) < km
    return keyed.join(near, (F.col("mmsi") == F.col("m")) & (F.col("cell") == F.col("band")) & close, how).drop("cell")


def curve_land_free(samples: DataFrame, reals: DataFrame, land) -> DataFrame:
    """(mmsi, samples, bad, land_free): bad samples of a curve are on land and far from each fix that is on land itself."""
    ashore = lambda d: d.filter(land(F.col("lat"), F.col("lon")))
    bad = trusted(ashore(samples), ashore(reals), how="left_anti")
    count = bad.groupBy("mmsi").agg(F.count("*").alias("bad"))
    return samples.groupBy("mmsi").agg(F.count("*").alias("samples")).join(count, "mmsi", "left").select("mmsi", "samples", F.coalesce("bad", F.lit(0)).alias("bad"), F.isnull("bad").alias("land_free"))


def marker_headings(fixes: DataFrame) -> DataFrame:
    """The heading that a marker shows: its own, else the course from the last place while it moves, else the one before."""
    w = Window.partitionBy("mmsi").orderBy("ts", "event_id")
    lat, lon = F.lag("lat").over(w), F.lag("lon").over(w)
    moved = vessels.is_moving(F.col("speed")) & ((lat != F.col("lat")) | (lon != F.col("lon")))
    own = F.coalesce(F.col("heading").cast("double"), F.when(moved, geo.bearing_deg(lat, lon, F.col("lat"), F.col("lon"))))
    return fixes.select("event_id", "mmsi", "ts", own.alias("own")).withColumn("shown", geo.rounded(F.last("own", ignorenulls=True).over(w))).select("event_id", "mmsi", "shown")


def brackets(points: DataFrame) -> DataFrame:
    """For each inferred point of a union (mmsi, t, id, tier, fake): time and tier of the real fixes before and after it."""
    w = Window.partitionBy("mmsi").orderBy("t", "fake", "id")
    real = F.when(~F.col("fake"), F.struct("t", "tier"))
    before, after = F.last(real, ignorenulls=True).over(w), F.first(real, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = points.withColumns({"before": before, "after": after}).filter("fake")
    return found.select("mmsi", "t", F.col("before.t").alias("before_t"), F.col("before.tier").alias("before_tier"), F.col("after.t").alias("after_t"), F.col("after.tier").alias("after_tier"))


def widened(fetched: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Tiers that a trail's cache fetches next: those it has (mmsi, tier) and the wanted ones, in order."""
    return fetched.groupBy("mmsi").agg(F.concat_ws(",", F.sort_array(F.array_union(F.collect_set("tier"), F.array(*map(F.lit, wanted))))).alias("tiers"))


def as_json(rows: DataFrame) -> DataFrame:
    """A JSON text per row with all its columns, missing values as null."""
    return rows.select("mmsi", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("body"))
