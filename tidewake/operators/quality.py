"""How good curves are: sharp turns far from real fixes, how far a curve strays from its control line, depth on land.

A curve is samples (mmsi, journey, id, i, t, lat, lon): id and t name the control point that a sample follows. Control lines
are points (mmsi, journey, id, t, lat, lon, fake).

The distance of a sample from the nearest control line is exact: the line between its own two control points bounds it, and
every line nearer than that has a part in one of the cells around the sample. Cells have the size of the bound, doubled from
one level to the next; a line is cut into parts of at most a cell of each level that its journey uses. The least level of a
journey gives it a few parts a line, so that some long lines among many short ones do not become thousands of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions import geo
from tidewake.operators import listings, routing, trails
from tidewake.operators.stored import saved

#: Sharp turns, degrees; how near a real fix excuses one, km; depth on land that counts as a defect, km; fixed values.
TURN_DEG, REAL_KM, DEFECT_KM = 60.0, 2.0, 0.15
KM_DEG = 111.32
#: Side of the smallest cells, km, and parts a line that a journey's least level may give it on average.
CELL_KM, PARTS = 0.05, 4
CURVE = ("mmsi", "journey")


def segment_km(p: tuple[Column, Column], a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Distance of p from the line a b, on a plane that is true at the line's middle latitude."""
    k = F.cos(F.radians((a[0] + b[0]) / 2)) * KM_DEG
    (ay, ax), (by, bx), (py, px) = ((c[0] * KM_DEG, c[1] * k) for c in (a, b, p))
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def lines(controls: DataFrame) -> DataFrame:
    """(mmsi, journey, id, a_lat, a_lon, b_lat, b_lon): the line from each control point to the next."""
    w = Window.partitionBy(*CURVE).orderBy("t", "id")
    out = controls.select(*CURVE, "id", "t", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    return out.withColumns({"b_lat": F.lead("a_lat").over(w), "b_lon": F.lead("a_lon").over(w)}).filter("b_lat IS NOT NULL").drop("t")


def _own_km() -> Column:
    """Distance of (lat, lon) from the line between (a_lat, a_lon) and (b_lat, b_lon)."""
    a, b, p = (tuple(F.col(f"{n}{c}") for c in ("lat", "lon")) for n in ("a_", "b_", ""))
    return segment_km(p, a, b)


def strayed(samples: DataFrame, controls: DataFrame) -> DataFrame:
    """(mmsi, journey, id, i, km): the distance of each sample from the nearest line of its journey's control points."""
    line = lines(controls)
    reach = F.greatest(F.abs(F.col("b_lat") - F.col("a_lat")), F.abs(F.col("b_lon") - F.col("a_lon")) * F.cos(F.radians("a_lat"))) * KM_DEG
    least = F.greatest(F.lit(0), F.ceil(F.log2(F.sum(reach) / F.count("*") / (PARTS * CELL_KM)))).cast("int")
    flat = controls.groupBy(*CURVE).agg(F.min(F.cos(F.radians("lat"))).alias("least_cos")).join(line.groupBy(*CURVE).agg(least.alias("least_level")), [*CURVE])
    own = samples.select(*CURVE, "id", "i", "lat", "lon").join(line, [*CURVE, "id"], "left").select(*CURVE, "id", "i", "lat", "lon", F.coalesce(_own_km(), F.lit(0.0)).alias("bound"))
    own = saved(own)  # three steps read it
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("bound") / CELL_KM))).cast("int")
    open_ = own.filter("bound > 0").select(*CURVE, "id", "i", "lat", "lon", "bound", level.alias("level")).join(flat, [*CURVE]).withColumn("level", F.greatest("level", "least_level"))
    side = F.pow(F.lit(2.0), F.col("level")) * CELL_KM / KM_DEG  # of a cell, degrees of latitude
    cell = lambda x, wide: F.floor(x / wide)
    tall, wide = side, side / F.col("least_cos")
    y, x = F.col("bound") / KM_DEG * 1.000001, F.col("bound") / KM_DEG / F.col("least_cos") * 1.000001
    around = open_.withColumn("cy", F.explode(F.sequence(cell(F.col("lat") - y, tall), cell(F.col("lat") + y, tall)))).withColumn("cx", F.explode(F.sequence(cell(F.col("lon") - x, wide), cell(F.col("lon") + x, wide))))
    used = open_.select(*CURVE, "level", "least_cos").distinct()
    parts = line.select(*CURVE, "a_lat", "a_lon", "b_lat", "b_lon").join(used, [*CURVE])
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("b_lat") - F.col("a_lat")) / tall, F.abs(F.col("b_lon") - F.col("a_lon")) / wide))).cast("int")
    parts = parts.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c, k: F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * (k / F.col("n"))
    ends = {f"{c}{e}": at(c, F.col("k") + e) for c in ("lat", "lon") for e in (0, 1)}
    parts = parts.withColumns(ends).withColumn("cy", F.explode(F.sequence(cell(F.least("lat0", "lat1") - 1e-9, tall), cell(F.greatest("lat0", "lat1") + 1e-9, tall))))
    parts = parts.withColumn("cx", F.explode(F.sequence(cell(F.least("lon0", "lon1") - 1e-9, wide), cell(F.greatest("lon0", "lon1") + 1e-9, wide))))
    parts = parts.select(*CURVE, "level", "cy", "cx", "a_lat", "a_lon", "b_lat", "b_lon").distinct()
    near = around.join(parts, [*CURVE, "level", "cy", "cx"]).groupBy(*CURVE, "id", "i").agg(F.min(_own_km()).alias("found"))
    return own.join(near, [*CURVE, "id", "i"], "left").select(*CURVE, "id", "i", F.least("bound", "found").alias("km"))


def far_turns(samples: DataFrame, controls: DataFrame, least: float = TURN_DEG, km: float = REAL_KM) -> DataFrame:
    """(mmsi, journey, id, i, turn): samples where a curve turns sharply and no real fix of the journey is near."""
    w = Window.partitionBy(*CURVE).orderBy("t", "id", "i")
    near = {f"{c}{n}": f(c).over(w) for c in ("lat", "lon") for n, f in ((0, F.lag), (2, F.lead))}
    rows = samples.withColumns(near).filter("lat0 IS NOT NULL AND lat2 IS NOT NULL")
    here, before, after = (F.col("lat"), F.col("lon")), (F.col("lat0"), F.col("lon0")), (F.col("lat2"), F.col("lon2"))
    turn = geo.heading_delta(geo.bearing_deg(*before, *here), geo.bearing_deg(*here, *after))
    sharp = rows.withColumn("turn", turn).filter(F.col("turn") >= least).select(*CURVE, "id", "i", "lat", "lon", "turn")
    band = km / 111.0
    cell = lambda c: F.floor(F.col(c) / band).cast("bigint")
    real = controls.filter(~F.coalesce("fake", F.lit(False))).select(*CURVE, F.col("lat").alias("y"), F.col("lon").alias("x"), F.explode(F.sequence(cell("lat") - 1, cell("lat") + 1)).alias("band"))
    met = sharp.withColumn("band", cell("lat")).join(real, [*CURVE, "band"]).filter(geo.haversine_km(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")) <= km)
    return sharp.join(met.select(*CURVE, "id", "i").distinct(), [*CURVE, "id", "i"], "left_anti").select(*CURVE, "id", "i", "turn")


def report(samples: DataFrame, controls: DataFrame, land: routing.Land | None = None) -> DataFrame:
    """(mmsi, samples, kinks, max_far_turn, max_overshoot_km) of every vessel, with land also land_defects and max_depth_km.

    Samples on land near a real fix that is on land itself are no defects.
    """
    count = samples.groupBy("mmsi").agg(F.count("*").alias("samples"))
    turns = far_turns(samples, controls).groupBy("mmsi").agg(F.count("*").alias("kinks"), F.max("turn").alias("max_far_turn"))
    stray = strayed(samples, controls).groupBy("mmsi").agg(F.max("km").alias("max_overshoot_km"))
    out = count.join(turns, "mmsi", "left").join(stray, "mmsi", "left").fillna(0, ["kinks"]).fillna(0.0, ["max_far_turn", "max_overshoot_km"])
    if land is None:
        return out
    ashore = lambda d: d.filter(routing.is_land(F.col("lat"), F.col("lon"), land))
    bad = ashore(samples.select("mmsi", F.concat_ws("/", "journey", "id", "i").alias("id"), "lat", "lon"))
    real = ashore(controls.filter(~F.coalesce("fake", F.lit(False))).select("mmsi", "lat", "lon"))
    deep = listings.trusted(bad, real, how="left_anti").withColumn("depth", trails.depth_km(F.col("lat"), F.col("lon"), land))
    deep = deep.groupBy("mmsi").agg(F.sum(F.when(F.col("depth") > DEFECT_KM, 1).otherwise(0)).alias("land_defects"), F.max("depth").alias("max_depth_km"))
    return out.join(deep, "mmsi", "left").fillna(0, ["land_defects"]).fillna(0.0, ["max_depth_km"])
