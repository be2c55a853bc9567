"""Polygon work on rings, arrays of (lat, lon): clipping, thinning, joining ways, holes and checks.

Each ring is a row; batches of rings go through small array functions. Joining coastline ways follows end nodes and
needs a whole dump's ways of one region together, so it is grouped by region.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions import geo

RING = "array<struct<lat:double,lon:double>>"
#: Where the coast keeps full detail, and the detail by distance from home: up to km, thinning km, least span of an island
#: km; fixed values.
DETAIL_HOME = (48.4299, -123.3622)
FINE_BOXES = ((49.00, -123.30, 49.40, -122.70), (48.40, -123.20, 48.80, -122.50), (47.40, -122.65, 48.10, -122.20))
DETAIL = ((60.0, 0.025, 0.05), (160.0, 0.12, 0.3), (2600.0, 0.30, 1.0), (float("inf"), 0.6, 2.0))


def detail(lat: Column, lon: Column) -> Column:
    """The detail of the coast at a place: thinning and least span of an island, km."""
    km = geo.haversine_km(F.lit(DETAIL_HOME[0]), F.lit(DETAIL_HOME[1]), lat, lon)
    levels = [F.struct(F.lit(a).alias("thin_km"), F.lit(b).alias("drop_km")) for _, a, b in DETAIL]
    out = F.when(km <= DETAIL[0][0], levels[0])
    for (most, _, _), level in zip(DETAIL[1:-1], levels[1:-1]):
        out = out.when(km <= most, level)
    out = out.otherwise(levels[-1])
    for box in FINE_BOXES:
        out = F.when(geo.in_box(lat, lon, box), levels[0]).otherwise(out)
    return out


def thin_km(lat: float, lon: float) -> float:
    """The thinning of `detail` at one place, for `thinned`."""
    if any(s <= lat <= n and w <= lon <= e for s, w, n, e in FINE_BOXES):
        return DETAIL[0][1]
    p, q = np.radians(DETAIL_HOME[0]), np.radians(lat)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon - DETAIL_HOME[1]) / 2) ** 2
    km = 2 * geo.KM * np.arcsin(min(1.0, h**0.5))
    return next(thin for most, thin, _ in DETAIL if km <= most)


def _mapped(ring: Column, f) -> Column:
    @F.pandas_udf(RING)
    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([[{"lat": a, "lon": b} for a, b in f(np.array([(p["lat"], p["lon"]) for p in r], float).reshape(-1, 2))] for r in rings])

    return run(ring)


def clip(ring: Column, south: float, west: float, north: float, east: float) -> Column:
    """The part of a ring in a box, edge by edge of the box; empty if nothing is left."""

    def one(points: np.ndarray) -> np.ndarray:
        for axis, limit, sign in ((0, south, 1), (0, north, -1), (1, west, 1), (1, east, -1)):
            out, n = [], len(points)
            for k in range(n):
                p, q = points[k - 1], points[k]
                a, b = sign * (p[axis] - limit) >= 0, sign * (q[axis] - limit) >= 0
                if a != b:
                    f = (limit - p[axis]) / (q[axis] - p[axis])
                    out.append(p + (q - p) * f)
                if b:
                    out.append(q)
            points = np.array(out, float).reshape(-1, 2)
        return points

    return _mapped(ring, one)


def _thin(p: np.ndarray, km: float | Callable[[float, float], float]) -> np.ndarray:
    if len(p) < 3:
        return p
    keep, todo = np.zeros(len(p), bool), [(0, len(p) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        scale = np.array([111.32, 111.32 * np.cos(np.radians(p[a, 0]))])
        d, inner = (p[b] - p[a]) * scale, (p[a + 1 : b] - p[a]) * scale
        t = np.clip(inner @ d / max(float(d @ d), 1e-12), 0, 1)
        away = np.hypot(*(inner - t[:, None] * d).T)
        k = a + 1 + int(away.argmax())
        if away.max() > (km(*p[k]) if callable(km) else km):
            keep[k] = True
            todo += [(a, k), (k, b)]
    return p[keep]


def thinned(ring: Column, km: float | Callable[[float, float], float]) -> Column:
    """Fewer points, none of the dropped further than `km` from the new line; ends stay.

    If km is a function of (lat, lon), the distance allowed is that at the furthest point.
    """
    return _mapped(ring, lambda p: _thin(p, km))


def thinned_by(ring: Column, km: Column) -> Column:
    """The same with a distance of its own for each ring."""

    @F.pandas_udf(RING)
    def run(rings: pd.Series, far: pd.Series) -> pd.Series:
        return pd.Series([[{"lat": a, "lon": b} for a, b in _thin(np.array([(p["lat"], p["lon"]) for p in r], float).reshape(-1, 2), k)] for r, k in zip(rings, far)])

    return run(ring, km.cast("double"))


def span_km(ring: Column) -> Column:
    """Diagonal of a ring's box."""
    side = lambda c: (F.array_min(F.transform(ring, lambda p: p[c])), F.array_max(F.transform(ring, lambda p: p[c])))
    (s, n), (w, e) = side("lat"), side("lon")
    return geo.haversine_km(s, w, n, e)


def joined_ways(ways: DataFrame) -> DataFrame:
    """(region, closed, nodes): directed ways (region, id, nodes) chained where one ends and another begins.

    Ways of one id are one way. A chain that comes back to its first node is closed.
    """

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        left = {r.id: list(r.nodes) for r in g.itertuples()}
        heads: dict[int, list[int]] = {}
        for k, nodes in left.items():
            heads.setdefault(nodes[0], []).append(k)
        ends = {nodes[-1] for nodes in left.values()}
        out = []
        for k in [*(k for k, n in left.items() if n[0] not in ends), *left]:  # open chains from their true start first
            if k not in left:
                continue
            nodes = left.pop(k)
            while nodes[-1] != nodes[0]:
                after = next((x for x in heads.get(nodes[-1], []) if x in left), None)
                if after is None:
                    break
                nodes = nodes + left.pop(after)[1:]
            out.append((g.region.iloc[0], nodes[0] == nodes[-1] and len(nodes) > 3, nodes))
        return pd.DataFrame(out, columns=["region", "closed", "nodes"])

    return ways.dropDuplicates(["region", "id"]).groupBy("region").applyInPandas(chain, "region string, closed boolean, nodes array<bigint>")


#: How far points of a region's rings may lie outside its box, degrees; a fixed value.
BOX_PAD = 0.5


def problems(rings: DataFrame, boxes: DataFrame | None = None, pad: float = BOX_PAD) -> DataFrame:
    """Rings (region, ring_id, ring) that break a rule: too few points, points off the globe or that are no numbers.

    With boxes (region, south, west, north, east) also rings that leave their region's padded box; then a region whose box
    is malformed, or that has no rings, is a row without a ring_id.
    """
    off = F.transform("ring", lambda p: ~F.coalesce(p["lat"].between(-90, 90) & p["lon"].between(-180, 180), F.lit(False)) | F.isnan(p["lat"]) | F.isnan(p["lon"]))
    problem = F.when(F.size("ring") < 4, "too few points").when(F.exists(off, lambda x: x), "off the globe")
    if boxes is None:
        return rings.select("region", "ring_id", problem.alias("problem")).filter("problem is not null")
    box = boxes.select("region", *[F.col(c).alias(f"box_{c}") for c in ("south", "west", "north", "east")])
    inside = lambda p: p["lat"].between(F.col("box_south") - pad, F.col("box_north") + pad) & p["lon"].between(F.col("box_west") - pad, F.col("box_east") + pad)
    out = rings.join(box, "region", "left").select("region", "ring_id", problem.when(F.exists("ring", lambda p: ~inside(p)), "outside the region").alias("problem"))
    bad = box.filter("box_south >= box_north OR box_west >= box_east").select("region", F.lit("malformed box").alias("problem"))
    empty = box.join(rings.select("region").distinct(), "region", "left_anti").select("region", F.lit("no rings").alias("problem"))
    whole = bad.unionAll(empty).select("region", F.lit(None).cast(rings.schema["ring_id"].dataType).alias("ring_id"), "problem")
    return out.filter("problem is not null").unionAll(whole)
