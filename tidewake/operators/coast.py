"""Coastlines and water as Spark tables: clip of chains with closure, rings from arcs, points in rings, tiles, regions.

Chains are rows of vertices (region, chain, seq, lat, lon), so no step needs a whole region, or a whole chain, in one row.
Boxes are rows (box, south, west, north, east), met by cells of their area. Pieces and arcs that follow one another are a
table of links; cycles of links are found and numbered by doubling the reach of each row, in rounds of one join. Rings are
arrays of (lat, lon), the largest value that a row holds, and are only built at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions import geo
from tidewake.operators import polygons
from tidewake.operators.stored import saved

POINTS = "array<struct<lat:double,lon:double>>"
Box = tuple[Column, Column, Column, Column]
SIDES = ("south", "west", "north", "east")
#: How far off an edge a crossing may be, and a place on the perimeter; fixed values.
CROSS_EPS, EDGE_EPS = 1e-9, 1e-6


def _box() -> Box:
    return tuple(F.col(c) for c in SIDES)


def _in(lat: Column, lon: Column, box: Box) -> Column:
    south, west, north, east = box
    return lat.between(south, north) & lon.between(west, east)


def _cell(x: Column, degrees: float) -> Column:
    return F.floor(x / degrees)


def box_cells(boxes: DataFrame, degrees: float) -> DataFrame:
    """The boxes, a row for each cell (cy, cx) of some degrees that they touch."""
    out = boxes.withColumn("cy", F.explode(F.sequence(_cell(F.col("south"), degrees), _cell(F.col("north"), degrees))))
    return out.withColumn("cx", F.explode(F.sequence(_cell(F.col("west"), degrees), _cell(F.col("east"), degrees))))


def crossing(a: tuple[Column, Column], b: tuple[Column, Column], box: Box) -> Column:
    """Where the line from a to b (lat, lon) first meets the box's edge after a; null if it does not."""
    (y0, x0), (y1, x1), (south, west, north, east) = a, b, box
    at = [F.try_divide(west - x0, x1 - x0), F.try_divide(east - x0, x1 - x0), F.try_divide(south - y0, y1 - y0), F.try_divide(north - y0, y1 - y0)]
    y, x = [y0 + (y1 - y0) * t for t in at[:2]], [x0 + (x1 - x0) * t for t in at[2:]]
    places = [(y[0], west), (y[1], east), (south, x[0]), (north, x[1])]
    near = [p[0].between(south - CROSS_EPS, north + CROSS_EPS) for p in places[:2]] + [p[1].between(west - CROSS_EPS, east + CROSS_EPS) for p in places[2:]]
    valid = [F.when((t > 0) & (t <= 1) & ok, t) for t, ok in zip(at, near)]
    first, out = F.least(*valid), F.lit(None).cast("struct<lat:double,lon:double>")
    for t, (lat, lon) in reversed(list(zip(valid, places))):
        out = F.when(t == first, F.struct(lat.alias("lat"), lon.alias("lon"))).otherwise(out)
    return out


def perimeter(lat: Column, lon: Column, box: Box) -> Column:
    """The place of a point of a box's edge on its perimeter, counter-clockwise from the south-west corner."""
    south, west, north, east = box
    w, h = east - west, north - south
    out = F.when(F.abs(lat - south) < EDGE_EPS, lon - west).when(F.abs(lon - east) < EDGE_EPS, w + (lat - south))
    return out.when(F.abs(lat - north) < EDGE_EPS, w + h + (east - lon)).otherwise(2 * w + h + (north - lat))


def clipped_chains(chains: DataFrame, boxes: DataFrame, degrees: float = 1.0) -> DataFrame:
    """Pieces of chains in boxes, (region, chain, box, piece, k, lat, lon, edge, south .. east): vertices in the order of k.

    A piece is a run of vertices in a box (edges included) with the places where the chain comes in and goes out; edge says
    that a vertex is such a place. A piece has two points at least.
    """
    w = Window.partitionBy("region", "chain").orderBy("seq")
    near = {f"{c}_{n}": f(c).over(w) for c in ("lat", "lon") for n, f in (("before", F.lag), ("after", F.lead))}
    steps = chains.select("region", "chain", "seq", "lat", "lon").withColumns(near).withColumns({"cy": _cell(F.col("lat"), degrees), "cx": _cell(F.col("lon"), degrees)})
    box, here = _box(), (F.col("lat"), F.col("lon"))
    met = steps.join(box_cells(boxes.select("box", *SIDES), degrees), ["cy", "cx"]).filter(_in(*here, box))
    before, after = ((F.col(f"lat_{n}"), F.col(f"lon_{n}")) for n in ("before", "after"))
    out = lambda p: p[0].isNull() | ~_in(*p, box)
    met = met.withColumn("piece", F.sum(F.when(out(before), 1).otherwise(0)).over(Window.partitionBy("region", "chain", "box").orderBy("seq")))
    place = lambda step, p, edge: F.struct(F.lit(step).alias("step"), p["lat"].alias("lat"), p["lon"].alias("lon"), F.lit(edge).alias("edge"))
    came, went = F.when(before[0].isNotNull() & out(before), crossing(before, here, box)), F.when(after[0].isNotNull() & out(after), crossing(here, after, box))
    own = F.struct(*[c.alias(n) for c, n in zip(here, ("lat", "lon"))])
    points = F.filter(F.array(place(0, came, True), place(1, own, False), place(2, went, True)), lambda p: p["lat"].isNotNull())
    rows = met.select("region", "chain", "box", "piece", "seq", *SIDES, F.explode(points).alias("p"))
    rows = rows.select("region", "chain", "box", "piece", (F.col("seq").cast("bigint") * 3 + F.col("p.step")).alias("k"), "p.lat", "p.lon", "p.edge", *SIDES)
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("region", "chain", "box", "piece"))).filter("n > 1").drop("n")


PIECE = ("region", "box", "chain", "piece")


def _ends(pieces: DataFrame) -> DataFrame:
    """Each piece with the perimeter's length, and the places on it where the piece comes in and goes out."""
    end = lambda f, c: f(c, "k")
    ends = pieces.groupBy(*PIECE, *SIDES).agg(*[end(f, c).alias(f"{n}_{c}") for f, n in ((F.min_by, "first"), (F.max_by, "last")) for c in ("lat", "lon", "edge")])
    box = _box()
    return ends.withColumns({
        "enters": perimeter(F.col("first_lat"), F.col("first_lon"), box), "leaves": perimeter(F.col("last_lat"), F.col("last_lon"), box),
        "around": 2 * (F.col("east") - F.col("west")) + 2 * (F.col("north") - F.col("south")),
    })


def _corners(ends: DataFrame, target: str, *kept: str) -> DataFrame:
    """The corners of the box between where a piece leaves and the target, counter-clockwise, in the order of k."""
    south, west, north, east = _box()
    w, h = east - west, north - south
    of = lambda p, lat, lon: F.struct(p.alias("p"), lat.alias("lat"), lon.alias("lon"))
    corners = F.array(of(F.lit(0.0), south, west), of(w, south, east), of(w + h, north, east), of(2 * w + h, north, west))
    begin, until = F.col("leaves"), F.when(F.col(target) <= F.col("leaves"), F.col(target) + F.col("around")).otherwise(F.col(target))
    rows = ends.select(*kept, begin.alias("begin"), until.alias("until"), "around", F.explode(corners).alias("c"))
    rows = rows.withColumn("at", F.when(F.col("c.p") < F.col("begin"), F.col("c.p") + F.col("around")).otherwise(F.col("c.p")))
    return rows.filter("at > begin AND at < until").select(*kept, (F.col("at") - F.col("begin")).alias("away"), "c.lat", "c.lon")


def closed_pieces(pieces: DataFrame) -> DataFrame:
    """(region, box, chain, piece, ring): each piece closed by itself, along the box from where it leaves to where it enters."""
    ends = _ends(pieces)
    vertex = pieces.select(*PIECE, F.struct(F.lit(0).alias("part"), F.col("k").cast("double").alias("k"), "lat", "lon").alias("v"))
    corner = _corners(ends, "enters", *PIECE).select(*PIECE, F.struct(F.lit(1).alias("part"), F.col("away").alias("k"), "lat", "lon").alias("v"))
    last = ends.select(*PIECE, F.struct(F.lit(2).alias("part"), F.lit(0.0).alias("k"), F.col("first_lat").alias("lat"), F.col("first_lon").alias("lon")).alias("v"))
    rings = vertex.unionAll(corner).unionAll(last).groupBy(*PIECE).agg(F.array_sort(F.collect_list("v")).alias("v"))
    return rings.select(*PIECE, F.transform("v", lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon"))).alias("ring")).filter(F.size("ring") >= 4)


def cycles(links: DataFrame) -> DataFrame:
    """(node, leader, rank) of the nodes on cycles of links (node, next): the least node of a cycle has rank 0.

    Each node has one next at most, and is the next of one at most. A row reaches twice as far in each round.
    """
    reach = saved(links.filter("next IS NOT NULL").select("node", F.col("next").alias("to"), F.col("node").alias("leader")))
    while True:
        after = reach.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("leader").alias("other"))
        wider = reach.join(after, "to").select("node", F.col("further").alias("to"), F.least("leader", "other").alias("leader"), (F.col("other") < F.col("leader")).alias("new"))
        wider = saved(wider)  # rows that run into an end are gone
        found = wider.agg(F.count("*").alias("n"), F.max("new").alias("new")).first()
        done = not found["new"] and found["n"] == reach.count()
        reach = wider.drop("new")
        if done or not found["n"]:
            break
    led = reach.select("node", "leader").join(links, "node")
    left = saved(led.select("node", "leader", F.when(F.col("next") != F.col("leader"), F.col("next")).alias("to"), F.when(F.col("next") != F.col("leader"), 1).otherwise(0).alias("left")))
    while not left.filter("to IS NOT NULL").isEmpty():
        after = left.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("left").alias("more"))
        left = saved(left.join(after, "to", "left").select("node", "leader", F.col("further").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    size = F.count("*").over(Window.partitionBy("leader"))
    return left.select("node", "leader", (size - 1 - F.col("left")).cast("int").alias("rank"))


def linked_pieces(pieces: DataFrame) -> DataFrame:
    """(region, box, chain, piece, ring): where a piece leaves, the coast goes on along the box to the next that enters.

    Only pieces that come in and go out over the edge take part. If several leave before one enters, the last of them goes
    on with it; rings are named by their least piece.
    """
    ends = saved(_ends(pieces).filter("first_edge AND last_edge").withColumn("node", F.concat_ws("/", *[F.col(c).cast("string") for c in PIECE])))
    sides = ends.select("region", "box", "node", F.col("enters").alias("p"), F.lit(0).alias("out")).unionAll(ends.select("region", "box", "node", F.col("leaves").alias("p"), F.lit(1).alias("out")))
    group = Window.partitionBy("region", "box")
    entry = F.when(F.col("out") == 0, F.struct(F.col("node").alias("next"), F.col("p").alias("target")))
    later = F.last(entry, ignorenulls=True).over(group.orderBy(F.desc("p"), F.desc("out"), F.desc("node")).rowsBetween(Window.unboundedPreceding, -1))
    found = sides.withColumn("to", F.coalesce(later, F.min_by(entry, F.when(F.col("out") == 0, F.struct("p", "node"))).over(group))).filter("out = 1")
    found = ends.join(found.select("node", "to.next", "to.target"), "node")
    away = F.col("target") - F.col("leaves") + F.when(F.col("target") <= F.col("leaves"), F.col("around")).otherwise(0.0)
    found = saved(found.withColumn("nth", F.row_number().over(Window.partitionBy("next").orderBy(away, "node"))).filter("nth = 1"))
    rank = cycles(found.select("node", "next"))
    place = lambda part, k: F.struct("rank", F.lit(part).alias("part"), k.alias("k"), "lat", "lon").alias("v")
    vertex = pieces.join(ends.select(*PIECE, "node"), [*PIECE]).join(rank, "node").select("leader", place(0, F.col("k").cast("double")))
    corner = _corners(found.join(rank, "node"), "target", "leader", "rank").select("leader", place(1, F.col("away")))
    rings = vertex.unionAll(corner).groupBy("leader").agg(F.array_sort(F.collect_list("v")).alias("v"))
    open_ = F.transform("v", lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon")))
    named = rings.join(ends.select(F.col("node").alias("leader"), *PIECE), "leader").select(*PIECE, open_.alias("ring"))
    return named.withColumn("ring", F.concat("ring", F.slice("ring", 1, 1))).filter(F.size("ring") >= 4)


def _key(p: Column) -> list[Column]:
    """A place in units of 1e-7 degrees."""
    return [F.floor(p[c] * 1e7 + 0.5).cast("bigint") for c in ("lat", "lon")]


def rings_of_arcs(arcs: DataFrame, group: tuple[str, ...] = ("region", "role")) -> DataFrame:
    """(*group, ring_id, ring): arcs (*group, arc, line) of any direction and order, joined where their ends meet.

    arc numbers are unique in the table. A closed arc is a ring. Where ends of several rings meet in one place, they are
    paired by arc and side. A ring starts with its least arc, forwards, and is named by it; arcs that dangle are dropped.
    """
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    ends = arcs.filter(F.size("line") > 1).withColumns({"a": F.array(*_key(first)), "b": F.array(*_key(last))})
    whole = (F.col("a") == F.col("b")) & (F.size("line") > 3)
    closed = ends.filter(whole).select(*group, F.col("arc").alias("ring_id"), F.col("line").alias("ring"))
    open_ = saved(ends.filter(~whole).select(*group, "arc", "line", "a", "b"))
    sides = open_.select(*group, "arc", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("at")), F.struct(F.lit(1).alias("side"), F.col("b").alias("at")))).alias("s")).select(*group, "arc", "s.*")
    at = Window.partitionBy(*group, "at").orderBy("arc", "side")
    met = sides.withColumn("n", F.row_number().over(at))
    partner = lambda f: F.when(F.col("n") % 2 == (1 if f is F.lead else 0), f(F.struct("arc", "side")).over(at))
    met = met.withColumn("other", F.coalesce(partner(F.lead), partner(F.lag)))
    # a dart is an arc in one direction, 2 arc forwards and 2 arc + 1 backwards; it leaves over the side it runs to
    dart = F.col("arc") * 2 + F.when(F.col("side") == 1, 0).otherwise(1)
    rank = cycles(met.select(dart.alias("node"), (F.col("other.arc") * 2 + F.col("other.side")).alias("next"))).filter("leader % 2 = 0")
    darts = rank.select("leader", "rank", F.expr("node div 2").alias("arc"), (F.col("node") % 2).alias("back")).join(open_, "arc")
    line = F.when(F.col("back") == 1, F.reverse("line")).otherwise(F.col("line"))
    line = F.when(F.col("rank") > 0, F.slice(line, F.lit(2), F.size("line"))).otherwise(line)
    joined = darts.groupBy(*group, "leader").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("parts"))
    rings = joined.select(*group, F.expr("leader div 2").alias("ring_id"), F.flatten(F.transform("parts", lambda p: p["line"])).alias("ring"))
    return closed.unionAll(rings).filter(F.size("ring") >= 4)


def places_in_rings(places: DataFrame, rings: DataFrame, key: tuple[str, ...], match: tuple[str, ...] = (), degrees: float = 0.25) -> DataFrame:
    """(lat, lon, *match, *key) of the different places in rings (*match, *key, ring), by the even-odd rule.

    Places meet boxes of rings by cells, with ids only; then each pair meets the ring's edges in its band of latitude. An
    edge is a row for each band that it spans, so no ring is repeated, or even read, as a whole.
    """
    of = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    boxes = rings.select(*match, *key, of(F.array_min, "lat").alias("south"), of(F.array_min, "lon").alias("west"), of(F.array_max, "lat").alias("north"), of(F.array_max, "lon").alias("east"))
    points = places.select(*match, "lat", "lon").distinct().withColumns({"cy": _cell(F.col("lat"), degrees), "cx": _cell(F.col("lon"), degrees)})
    pairs = points.join(box_cells(boxes, degrees), [*match, "cy", "cx"]).filter(_in(F.col("lat"), F.col("lon"), _box())).select(*match, "lat", "lon", *key, F.col("cy").alias("band"))
    vertices = F.transform("ring", lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    before = F.concat(F.slice("ring", -1, 1), F.slice("ring", F.lit(1), F.greatest(F.size("ring") - 1, F.lit(0))))
    edges = rings.filter(F.size("ring") > 2).select(*match, *key, F.explode(F.zip_with(vertices, before, lambda v, q: F.struct(v["p"].alias("p"), q.alias("q")))).alias("e"))
    edges = edges.select(*match, *key, *[F.col(f"e.{s}.{c}").alias(f"{s}_{c}") for s in "pq" for c in ("lat", "lon")]).filter("p_lat <> q_lat")
    edges = edges.withColumn("band", F.explode(F.sequence(_cell(F.least("p_lat", "q_lat"), degrees), _cell(F.greatest("p_lat", "q_lat"), degrees))))
    met = pairs.join(edges, [*match, *key, "band"])
    away = (F.col("p_lat") > F.col("lat")) != (F.col("q_lat") > F.col("lat"))
    right = F.col("lon") < (F.col("q_lon") - F.col("p_lon")) * ((F.col("lat") - F.col("p_lat")) / (F.col("q_lat") - F.col("p_lat"))) + F.col("p_lon")
    return met.filter(away & right).groupBy(*match, "lat", "lon", *key).count().filter("count % 2 = 1").drop("count")


def with_holes(outers: DataFrame, inners: DataFrame, match: tuple[str, ...] = ("region",)) -> DataFrame:
    """Outer rings (*match, ring_id, ring) with a column of the inner rings (*match, ring) whose first point they hold."""
    hole = inners.select(*match, F.col("ring").alias("hole"), F.element_at("ring", 1)["lat"].alias("lat"), F.element_at("ring", 1)["lon"].alias("lon"))
    held = places_in_rings(hole, outers, ("ring_id",), match)
    holes = hole.join(held, [*match, "lat", "lon"]).groupBy(*match, "ring_id").agg(F.array_sort(F.collect_list("hole")).alias("holes"))
    return outers.join(holes, [*match, "ring_id"], "left").withColumn("holes", F.coalesce("holes", F.array().cast(f"array<{POINTS}>")))


def water(arcs: DataFrame, group: tuple[str, ...] = ("region", "relation")) -> DataFrame:
    """(*group, ring_id, ring, holes): water bodies of arcs (*group, role, arc, line), whose role is inner or anything else."""
    inner = F.coalesce(F.col("role") == "inner", F.lit(False))
    rings = saved(rings_of_arcs(arcs.withColumn("role", F.when(inner, "inner").otherwise("outer")), (*group, "role")))
    outers, inners = (rings.filter(F.col("role") == r).drop("role") for r in ("outer", "inner"))
    return with_holes(outers, inners, group)


def _half(p: np.ndarray, axis: int, limit: float, sign: int) -> np.ndarray:
    """The part of a ring on one side of a line."""
    if not len(p):
        return p
    q = np.roll(p, 1, axis=0)
    here, there = sign * (p[:, axis] - limit) >= 0, sign * (q[:, axis] - limit) >= 0
    cut = here != there
    t = np.divide(limit - q[:, axis], p[:, axis] - q[:, axis], out=np.zeros(len(p)), where=cut)
    met = q + (p - q) * t[:, None]
    met[:, axis] = limit
    return np.stack([met, p], axis=1)[np.stack([cut, here], axis=1)]


def clipped_rings(rings: DataFrame) -> DataFrame:
    """Rings with a box in each row (ring, south, west, north, east), cut to it one edge after the other."""

    def run(ring: pd.Series, south: pd.Series, west: pd.Series, north: pd.Series, east: pd.Series) -> pd.Series:
        out = []
        for r, s, w, n, e in zip(ring, south, west, north, east):
            p = np.array([(v["lat"], v["lon"]) for v in r], float).reshape(-1, 2)
            for axis, limit, sign in ((1, w, 1), (1, e, -1), (0, s, 1), (0, n, -1)):
                p = _half(p, axis, limit, sign)
            out.append([{"lat": y, "lon": x} for y, x in p.tolist()])
        return pd.Series(out)

    cut = F.pandas_udf(run, POINTS).asNondeterministic()  # so that a filter of the result does not make it a second time
    return rings.withColumn("ring", cut("ring", *SIDES))


def rings_by_box(rings: DataFrame, boxes: DataFrame, degrees: float = 5.0, least: int = 4) -> DataFrame:
    """Each pair of a ring (region, ring_id, ring) and a box that its own box meets, with the part of the ring in the box.

    The pairs come from cells and carry ids only; the ring is joined once for each box that it meets. A part has
    `least` points before it is closed; four is the rule of the layers, which leaves out triangles of open rings.
    """
    of = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    own = rings.select("region", "ring_id", of(F.array_min, "lat").alias("s"), of(F.array_min, "lon").alias("w"), of(F.array_max, "lat").alias("n"), of(F.array_max, "lon").alias("e"))
    cells = own.withColumn("cy", F.explode(F.sequence(_cell(F.col("s"), degrees), _cell(F.col("n"), degrees)))).withColumn("cx", F.explode(F.sequence(_cell(F.col("w"), degrees), _cell(F.col("e"), degrees))))
    met = cells.join(box_cells(boxes, degrees), ["cy", "cx"]).filter("s <= north AND south <= n AND w <= east AND west <= e")
    pairs = met.select("region", "ring_id", *boxes.columns).distinct()
    return closed_parts(clipped_rings(rings.join(pairs, ["region", "ring_id"])), least)


def rings_in_own_box(rings: DataFrame, boxes: DataFrame, least: int = 4) -> DataFrame:
    """The rows of `rings_by_box` for a ring and the box that is named as its region; rings that lie in it stay as they are.

    Boxes are a row a region and go to the tasks, so no ring is shuffled.
    """
    of = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    own = F.struct(of(F.array_min, "lat").alias("s"), of(F.array_min, "lon").alias("w"), of(F.array_max, "lat").alias("n"), of(F.array_max, "lon").alias("e"))
    sides = rings.withColumn("_own", F.explode(F.array(own)))  # as values, so that the terms below do not work them out again
    met = sides.join(F.broadcast(boxes), F.col("region") == F.col("box")).filter("_own.s <= north AND south <= _own.n AND _own.w <= east AND west <= _own.e")
    whole = F.expr("_own.s >= south AND _own.n <= north AND _own.w >= west AND _own.e <= east")
    met = met.withColumn("_whole", F.coalesce(whole, F.lit(False))).drop("_own")
    parts = met.filter("_whole").unionByName(clipped_rings(met.filter("NOT _whole"))).drop("_whole")
    return closed_parts(parts, least)


def closed_parts(parts: DataFrame, least: int) -> DataFrame:
    """Parts of rings of some points at least, closed."""
    ends = F.get("ring", F.lit(0)), F.try_element_at("ring", F.lit(-1))
    return parts.filter(F.size("ring") >= least).withColumn("ring", F.when(ends[0] == ends[1], F.col("ring")).otherwise(F.concat("ring", F.array(ends[0]))))


def area(ring: Column) -> Column:
    """Area of a ring in square degrees."""
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))))
    twice = F.aggregate(F.zip_with(ring, before, lambda p, q: q["lon"] * p["lat"] - p["lon"] * q["lat"]), F.lit(0.0), lambda s, x: s + x)
    return F.abs(twice) / 2


#: The world without the poles, the coast near home, and the carved box of home, as (south, west, north, east); thinning
#: and least span of the two kinds of tiles, km; fixed values.
WORLD, NEAR, HOME = (-60.0, -180.0, 80.0, 180.0), (18.0, -170.0, 60.5, -104.0), (32.0, -130.0, 51.3, -116.0)
NEAR_KM, FAR_KM, TILE_SPAN_KM = 2.0, 5.0, 30.0


def around(outer: tuple[float, ...], inner: tuple[float, ...], rows: bool) -> list[tuple[float, float, float, float]]:
    """Four boxes that fill the outer box but for the inner one: two of its whole width (rows) or height, and two between."""
    s, w, n, e = outer
    a, b, c, d = inner
    if rows:
        return [(s, w, a, e), (c, w, n, e), (a, w, c, b), (a, d, c, e)]
    return [(s, w, n, b), (s, d, n, e), (s, b, a, d), (c, b, n, d)]


def tiles(spark: SparkSession, world=WORLD, near=NEAR, home=HOME, near_km: float = NEAR_KM, far_km: float = FAR_KM) -> DataFrame:
    """(box, south, west, north, east, km): disjoint tiles of the world around home, finer near it."""
    rows = [(*b, near_km) for b in around(near, home, True)] + [(*b, far_km) for b in around(world, near, False)]
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "box int, south double, west double, north double, east double, km double")


def finished(parts: DataFrame, km: Column, least_km: float, places: int) -> DataFrame:
    """Parts of rings that span some km, thinned and rounded, of four points at least."""
    long = parts.filter(polygons.span_km(F.col("ring")) >= least_km).withColumn("ring", polygons.thinned_by(F.col("ring"), km))
    ring = F.transform("ring", lambda p: F.struct(geo.rounded(p["lat"], places).alias("lat"), geo.rounded(p["lon"], places).alias("lon")))
    return long.withColumn("ring", ring).filter(F.size("ring") >= 4)


def tiled(rings: DataFrame, tile: DataFrame, least_km: float = TILE_SPAN_KM) -> DataFrame:
    """The coarse land: rings (region, ring_id, ring) by tiles, small parts dropped, each tile thinned to its own detail."""
    return finished(rings_by_box(rings, tile, 10.0), F.col("km"), least_km, 3).select("region", "ring_id", "box", "ring")


#: Thinning of a region's land and water, and least spans of land and of navigable water, km; fixed values.
REGION_LAND_KM, REGION_WATER_KM, REGION_DROP_KM, NAVIGABLE_KM = 0.04, 0.05, 0.08, 1.0


def region_land(islands: DataFrame, boxes: DataFrame) -> DataFrame:
    """Land of regions: their closed rings only, cut to the region's box, thinned, less what is too small."""
    mine = rings_in_own_box(islands, boxes)
    return finished(mine, F.lit(REGION_LAND_KM), REGION_DROP_KM, 5).select("region", "ring_id", "ring")


def region_water(bodies: DataFrame, boxes: DataFrame) -> DataFrame:
    """Navigable water of regions (region, ring_id, ring, holes), cut to their boxes and thinned, and so are its holes."""
    outer = finished(rings_in_own_box(bodies.drop("holes"), boxes), F.lit(REGION_WATER_KM), NAVIGABLE_KM, 5).select("region", "ring_id", "ring")
    hole = bodies.select("region", F.col("ring_id").alias("body"), F.posexplode("holes").alias("nth", "ring")).withColumn("ring_id", F.concat_ws("/", F.col("body").cast("string"), F.col("nth").cast("string")))
    kept = finished(rings_in_own_box(hole, boxes), F.lit(REGION_WATER_KM), REGION_DROP_KM, 5)
    holes = kept.groupBy("region", F.col("body").alias("ring_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "ring"))), lambda x: x["ring"]).alias("holes"))
    return outer.join(holes, ["region", "ring_id"], "left").withColumn("holes", F.coalesce("holes", F.array().cast(f"array<{POINTS}>")))


def build_counts(islands: DataFrame, bodies: DataFrame, boxes: DataFrame) -> DataFrame:
    """(region, kind, stage, rings): how many rings of land and water are there, meet the region's box, and are long enough."""
    whole = None
    for kind, rings, least in (("land", islands.select("region", "ring_id", "ring"), REGION_DROP_KM), ("water", bodies.select("region", "ring_id", "ring"), NAVIGABLE_KM)):
        given = rings.groupBy("region").agg(F.count("*").alias("rings")).select("region", F.lit("given").alias("stage"), "rings")
        cut = rings_in_own_box(rings, boxes).select("region", (polygons.span_km(F.col("ring")) >= least).alias("long"))
        sums = cut.groupBy("region").agg(F.count("*").alias("cut"), F.sum(F.col("long").cast("bigint")).alias("kept")).unpivot("region", ["cut", "kept"], "stage", "rings").filter("rings > 0")
        both = given.unionAll(sums).select("region", F.lit(kind).alias("kind"), "stage", "rings")
        whole = both if whole is None else whole.unionAll(both)
    return whole


#: Regions of several zones, and boxes that replace derived ones; around a zone, degrees; fixed values.
MERGED = {"astoria-columbia": "columbia", "portland": "columbia", "golden-gate": "sf-bay", "sf-bay-oakland": "sf-bay"}
OVERRIDES = {"columbia": (45.45, -124.10, 46.35, -122.50)}
CORRIDORS = {"inside-passage": (54.0, -134.2, 58.6, -129.6), "bc-central-south": (50.7, -130.8, 52.5, -125.5), "bc-central-north": (52.3, -130.8, 54.15, -126.5)}
ZONE_PAD = 0.2


def derived_regions(zones: DataFrame, merged: dict[str, str] = MERGED, overrides: dict[str, tuple] = OVERRIDES, corridors: dict[str, tuple] = CORRIDORS) -> DataFrame:
    """(region, south, west, north, east): boxes of zones (zone_id, south .. east), some of several zones, with more around.

    A box that is given replaces a derived one; corridors are regions without a zone.
    """
    spark = zones.sparkSession
    named = spark.createDataFrame(list(merged.items()) or [("", "")], "zone_id string, into string")
    given = "region string, g_south double, g_west double, g_north double, g_east double"
    fixed = spark.createDataFrame([(k, *map(float, b)) for k, b in overrides.items()], given)
    of = zones.join(F.broadcast(named), "zone_id", "left").withColumn("region", F.coalesce("into", "zone_id"))
    box = of.groupBy("region").agg((F.min("south") - ZONE_PAD).alias("south"), (F.min("west") - ZONE_PAD).alias("west"), (F.max("north") + ZONE_PAD).alias("north"), (F.max("east") + ZONE_PAD).alias("east"))
    box = box.join(F.broadcast(fixed), "region", "left").select("region", *[F.coalesce(f"g_{s}", geo.rounded(F.col(s), 4)).alias(s) for s in SIDES])
    more = spark.createDataFrame([(k, *map(float, b)) for k, b in corridors.items()], "region string, south double, west double, north double, east double")
    return box.unionByName(more)
