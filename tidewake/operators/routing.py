"""Land, water routes across gaps, and the few waypoints that a trail needs.

Polygons are small and go to the tasks with the function. A gap is a row, so gaps are routed in parallel wherever their
vessel is, those with equal ends and courses once; the search grid is made anew for each and bounded by `max_cells` a side.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions import geo, vessels
from tidewake.operators import tracks
from tidewake.operators.stored import saved

Ring = list[tuple[float, float]]
GAP_MS, GAP_KM, STEP_KM = 1_200_000, 5.0, 0.25
KM = 111.32


def inside(lat: np.ndarray, lon: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd test of many points in one ring."""
    out = np.zeros(lat.shape, bool)
    for (ya, xa), (yb, xb) in zip(ring, np.roll(ring, 1, axis=0)):
        if ya != yb:
            out ^= ((ya > lat) != (yb > lat)) & (lon < (xb - xa) * (lat - ya) / (yb - ya) + xa)
    return out


#: Edges from which a ring is looked up by bands of latitude, and pairs of points and edges that are made at a time.
FEW_EDGES, PAIRS = 32, 1 << 20


class Banded:
    """A ring with its box, and the edges that each band of latitude meets: a point is tested against those of its band."""

    def __init__(self, ring: Ring):
        r = np.array(ring, float).reshape(-1, 2)
        self.ring, self.box = r, (*r.min(axis=0), *r.max(axis=0))
        self.bands = 0
        if len(r) < FEW_EDGES:
            return
        q = np.roll(r, 1, axis=0)
        level = r[:, 0] != q[:, 0]
        self.p, self.q = r[level], q[level]
        self.bands = max(1, len(self.p) // 4)
        self.tall = max((self.box[2] - self.box[0]) / self.bands, 1e-12)
        first, last = self._band(np.minimum(self.p[:, 0], self.q[:, 0])), self._band(np.maximum(self.p[:, 0], self.q[:, 0]))
        edge = np.repeat(np.arange(len(self.p)), last - first + 1)
        band = np.arange(len(edge)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[edge]
        self.edges = edge[np.argsort(band, kind="stable")]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(band, minlength=self.bands))])

    def _band(self, lat: np.ndarray) -> np.ndarray:
        return np.clip(((lat - self.box[0]) / self.tall).astype(np.int64), 0, self.bands - 1)

    def holds(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        south, west, north, east = self.box
        out = (lat >= south) & (lat <= north) & (lon >= west) & (lon <= east)
        if out.any():
            out[out] = self._inside(lat[out], lon[out]) if self.bands else inside(lat[out], lon[out], self.ring)
        return out

    def _inside(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        band, out = self._band(lat), np.zeros(len(lat), bool)
        count = self.at[band + 1] - self.at[band]
        until = np.concatenate([[0], np.cumsum(count)])
        a = 0
        while a < len(lat):
            b = max(a + 1, int(np.searchsorted(until, until[a] + PAIRS, "right")) - 1)
            n = count[a:b]
            point = np.repeat(np.arange(a, b), n)
            edge = self.edges[np.repeat(self.at[band[a:b]] - (until[a:b] - until[a]), n) + np.arange(len(point))]
            (ya, xa), (yb, xb), y, x = self.p[edge].T, self.q[edge].T, lat[point], lon[point]
            met = ((ya > y) != (yb > y)) & (x < (xb - xa) * (y - ya) / (yb - ya) + xa)
            out[a:b] = np.bincount(point[met] - a, minlength=b - a) % 2 == 1
            a = b
        return out


#: The least size of a cell in km, and cells of the longer side of a grid at most; fixed values.
FLOOR_KM, MAX_CELLS = 0.2, 4000


@dataclass
class Land:
    """Rings of land, less rings of water; a piece of water may have islands in it."""

    land: list[Ring]
    water: list[tuple[Ring, list[Ring]]] = field(default_factory=list)
    #: Rings that were looked up here, by identity; they do not go to the tasks.
    made: dict[int, Banded] = field(default_factory=dict, repr=False, compare=False, kw_only=True)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": {}}

    def _near(self, ring: Ring, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        if id(ring) not in self.made:
            self.made[id(ring)] = Banded(ring)
        return self.made[id(ring)].holds(lat, lon)

    def is_land(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        lat, lon = np.asarray(lat, float), np.asarray(lon, float)
        out = np.zeros(lat.shape, bool)
        for ring in self.land:
            out |= self._near(ring, lat, lon)
        for outer, holes in self.water:
            if not out.any():
                break
            wet = out & self._near(outer, lat, lon)
            for hole in holes:
                wet &= ~self._near(hole, lat, lon)
            out &= ~wet
        return out

    def crosses(self, a: tuple[float, float], b: tuple[float, float], step_km: float = STEP_KM) -> bool:
        f = np.linspace(0, 1, max(2, int(np.ceil(distance(*a, *b) / step_km))) + 1)
        return bool(self.is_land(a[0] + (b[0] - a[0]) * f, a[1] + (b[1] - a[1]) * f).any())

    def crossed(self, a: np.ndarray, b: np.ndarray, step_km: float = STEP_KM) -> np.ndarray:
        """`crosses` for many lines at once, from places a to places b, arrays of (lat, lon)."""
        out = np.zeros(len(a), bool)
        n = np.maximum(2, np.ceil(np.nan_to_num(distance(a[:, 0], a[:, 1], b[:, 0], b[:, 1]) / step_km))).astype(np.int64)
        until = np.concatenate([[0], np.cumsum(n + 1)])
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(until, until[i] + PAIRS, "right")) - 1)
            line, first = np.repeat(np.arange(i, j), n[i:j] + 1), until[i:j] - until[i]
            f = (np.arange(len(line)) - first[line - i]) * (1 / n[line])
            f[first + n[i:j]] = 1.0
            at = a[line] + (b[line] - a[line]) * f[:, None]
            out[i:j] = np.logical_or.reduceat(self.is_land(at[:, 0], at[:, 1]), first)
            i = j
        return out


@dataclass
class Region:
    """Fine land and water of a box (south, west, north, east)."""

    box: tuple[float, float, float, float]
    land: list[Ring] = field(default_factory=list)
    water: list[tuple[Ring, list[Ring]]] = field(default_factory=list)

    def holds(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        south, west, north, east = self.box
        return (lat >= south) & (lat <= north) & (lon >= west) & (lon <= east)


@dataclass
class RegionLand(Land):
    """Home land and coarse land less water. In the box of a region with land of its own, the first such region decides
    with home land, and coarse land does not count, so narrow water stays open; water of other regions counts in their boxes.
    """

    coarse: list[Ring] = field(default_factory=list)
    regions: list[Region] = field(default_factory=list)

    def is_land(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        lat, lon = np.asarray(lat, float), np.asarray(lon, float)
        out, left = np.zeros(lat.shape, bool), np.ones(lat.shape, bool)
        for region in self.regions:
            if region.land:
                here = left & region.holds(lat, lon)
                out[here] = Land(self.land + region.land, self.water + region.water, made=self.made).is_land(lat[here], lon[here])
                left &= ~here
        out[left] = Land(self.land + self.coarse, self.water, made=self.made).is_land(lat[left], lon[left])
        for region in self.regions:
            here = left & out & region.holds(lat, lon)
            for outer, holes in region.water:
                wet = self._near(outer, lat[here], lon[here])
                for hole in holes:
                    wet &= ~self._near(hole, lat[here], lon[here])
                out[here] &= ~wet
                here = here & out
        return out

    def within(self, south: float, west: float, north: float, east: float) -> RegionLand:
        """With those regions only whose boxes meet an extent."""
        met = [r for r in self.regions if r.box[0] <= north and south <= r.box[2] and r.box[1] <= east and west <= r.box[3]]
        return RegionLand(self.land, self.water, self.coarse, met, made=self.made)


def distance(lat1, lon1, lat2, lon2):
    """Great-circle km."""
    p, q = np.radians(lat1), np.radians(lat2)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.KM * np.arcsin(np.minimum(1, np.sqrt(h)))


def is_land(lat: Column, lon: Column, land: Land) -> Column:
    """Whether points lie on land, as an Arrow function over batches of points."""

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(land.is_land(a.to_numpy(float), b.to_numpy(float)))

    return test(lat, lon)


class Grid:
    """Square cells over the box of a gap and a margin, with land, and the distance to land in cells.

    Cells are looked at in tiles, when a search first comes to them, so memory follows the way and not the box.
    """

    TILE = 64
    #: Rings around a place that are looked at together.
    SQUARES = (0, 4, 16, 64)

    def __init__(self, a: tuple[float, float], b: tuple[float, float], land: Land, max_cells: int, near_km: float = 4.0):
        direct = float(distance(*a, *b))
        margin = min(90.0, max(12.0, 0.6 * direct))
        self.km = max(FLOOR_KM, (direct + 2 * margin) / max_cells)
        squeeze = np.cos(np.radians((a[0] + b[0]) / 2))
        self.dlat, self.dlon = self.km / KM, self.km / (KM * squeeze)
        self.south, self.west = min(a[0], b[0]) - margin / KM, min(a[1], b[1]) - margin / (KM * squeeze)
        self.rows = int(np.ceil((max(a[0], b[0]) + margin / KM - self.south) / self.dlat)) + 1
        self.cols = int(np.ceil((max(a[1], b[1]) + margin / (KM * squeeze) - self.west) / self.dlon)) + 1
        self.reach, self.source = min(8, max(1, round(near_km / self.km))), land
        self.tiles: dict[tuple[int, int], np.ndarray] = {}

    def on_land(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Whether cells are land; beyond the box there is none."""
        r, c = np.asarray(r), np.asarray(c)
        within = (r >= 0) & (r < self.rows) & (c >= 0) & (c < self.cols)
        return within & self.source.is_land(self.south + self.dlat * r, self.west + self.dlon * c)

    def tile(self, i: int, j: int) -> np.ndarray:
        """Cells to the nearest land of a tile's cells, at most `reach`: 0 is land, 1 lies beside it."""
        if (i, j) not in self.tiles:
            n, k = self.TILE, self.reach
            r, c = np.meshgrid(i * n - k + np.arange(n + 2 * k), j * n - k + np.arange(n + 2 * k), indexing="ij")
            grown = self.on_land(r.ravel(), c.ravel()).reshape(r.shape)
            away = np.where(grown, 0, k)
            for step in range(1, k):
                if not grown.any():
                    break
                wide = np.pad(grown, 1)
                grown = sum(wide[y : y + n + 2 * k, x : x + n + 2 * k] for y in range(3) for x in range(3)) > 0
                away[grown & (away > step)] = step
            self.tiles[i, j] = away[k : n + k, k : n + k]
        return self.tiles[i, j]

    def away(self, r: int, c: int) -> int:
        return int(self.tile(r // self.TILE, c // self.TILE)[r % self.TILE, c % self.TILE])

    def cell(self, lat: float, lon: float) -> tuple[int, int] | None:
        """The nearest water cell, by rings around the place; None if there is none in the box."""
        r = int(np.clip(round((lat - self.south) / self.dlat), 0, self.rows - 1))
        c = int(np.clip(round((lon - self.west) / self.dlon), 0, self.cols - 1))
        last, seen = max(self.rows, self.cols), -1
        for most in self.SQUARES:  # near rings together
            i, j = (x.ravel() for x in np.meshgrid(*[np.arange(-most, most + 1)] * 2, indexing="ij"))
            k = np.maximum(np.abs(i), np.abs(j))
            new = (k > seen) & (k < last) & (i + r >= 0) & (i + r < self.rows) & (j + c >= 0) & (j + c < self.cols)
            i, j, k = i[new], j[new], k[new]
            wet = np.flatnonzero(~self.on_land(i + r, j + c))
            if len(wet):
                first = wet[np.lexsort((j[wet], i[wet], k[wet]))[0]]
                return int(i[first] + r), int(j[first] + c)
            seen = most
        for k in range(seen + 1, last):
            side = np.arange(-k, k + 1)
            ring = np.unique(np.concatenate([np.stack(x, axis=1) for e in (-k, k) for x in ((np.full(2 * k + 1, e), side), (side, np.full(2 * k + 1, e)))]), axis=0) + (r, c)
            ring = ring[(ring[:, 0] >= 0) & (ring[:, 0] < self.rows) & (ring[:, 1] >= 0) & (ring[:, 1] < self.cols)]
            wet = ring[~self.on_land(ring[:, 0], ring[:, 1])]
            if len(wet):
                return int(wet[0, 0]), int(wet[0, 1])
        return None

    def place(self, r: int, c: int) -> tuple[float, float]:
        return self.south + r * self.dlat, self.west + c * self.dlon

    def search(self, start: tuple[int, int], goal: tuple[int, int], clearance: int, narrow: float, courses: list) -> list[tuple[int, int]] | None:
        """Cheapest way by A* over cells that are further than `clearance` from land.

        Water near land costs more, and so do turns back at the ends.
        """
        near = [(self.reach - d) / self.reach for d in range(self.reach + 1)]
        price = [1 + 2 * x + narrow * x * x for x in near]
        best, parent, done = {start: 0.0}, {}, set()
        steps = [(i, j, self.km * (i * i + j * j) ** 0.5) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
        ahead = lambda r, c: self.km * ((r - goal[0]) ** 2 + (c - goal[1]) ** 2) ** 0.5
        heap = [(ahead(*start), start)]
        while heap:
            _, at = heapq.heappop(heap)
            if at in done:
                continue
            if at == goal:
                way = [at]
                while way[-1] in parent:
                    way.append(parent[way[-1]])
                return way[::-1]
            done.add(at)
            r, c = at
            for i, j, length in steps:
                n = (r + i, c + j)
                if not (0 <= n[0] < self.rows and 0 <= n[1] < self.cols) or n in done:
                    continue
                away = self.away(*n)
                if away <= clearance and n != goal:
                    continue
                turn = 0.0
                for (er, ec), (dy, dx) in courses:
                    d = self.km * ((r - er) ** 2 + (c - ec) ** 2) ** 0.5
                    if d < 4:
                        turn += 5 * max(0.0, -(i * dy + j * dx) / (i * i + j * j) ** 0.5) * (1 - d / 4)
                cost = best[at] + length * (price[away] + turn)
                if cost < best.get(n, np.inf):
                    best[n], parent[n] = cost, at
                    heapq.heappush(heap, (cost + ahead(*n), n))
        return None


def route(a: tuple[float, float], b: tuple[float, float], land: Land, narrow: float = 3.0, entry: float | None = None, leave: float | None = None, max_cells: int = MAX_CELLS) -> list[tuple[float, float]] | None:
    """Waypoints over water from a to b, ends included, or None if there is no way.

    First with a cell of clearance to land, else without; then cells between which a straight line is clear are left out.
    """
    grid = Grid(a, b, land, max_cells)
    start, goal = grid.cell(*a), grid.cell(*b)
    if start is None or goal is None:
        return None
    course = lambda deg: (np.cos(np.radians(deg)), np.sin(np.radians(deg)))
    courses = [(p, course(d)) for p, d in ((start, entry), (goal, leave)) if d is not None and not np.isnan(d)]
    for clearance in (1, 0):
        way = grid.search(start, goal, clearance, narrow, courses)
        if way:
            break
    else:
        return None

    def clear(p: tuple[int, int], q: tuple[int, int]) -> bool:
        n = max(1, 2 * max(abs(p[0] - q[0]), abs(p[1] - q[1])))
        f = np.linspace(0, 1, n + 1)
        r, c = np.rint(p[0] + (q[0] - p[0]) * f).astype(int), np.rint(p[1] + (q[1] - p[1]) * f).astype(int)
        return all(grid.away(x, y) > clearance for x, y in zip(r[1:-1].tolist(), c[1:-1].tolist())) and not land.crosses(grid.place(*p), grid.place(*q), grid.km / 2)

    kept = [way[0]]
    for k in range(2, len(way)):
        if not clear(kept[-1], way[k]):
            kept.append(way[k - 1])
    return [a, *(grid.place(*p) for p in kept[1:]), b]


def smoothed(way: list[tuple[float, float]], land: Land, passes: int = 12, points: int = 16) -> list[tuple[float, float]]:
    """The route with more points, each pulled towards its neighbours' middle where that keeps clear of land."""
    if len(way) < 3:
        return way
    legs = [float(distance(*p, *q)) for p, q in zip(way, way[1:])]
    step = max(1.0, sum(legs) / points)
    out = [np.array(way[0])]
    for p, q, d in zip(way, way[1:], legs):
        n = max(1, round(d / step))
        out += [np.array(p) + (np.array(q) - p) * k / n for k in range(1, n + 1)]
    out = np.array(out)
    for _ in range(passes):
        p, x, q = out[:-2], out[1:-1], out[2:]
        y = x + 0.5 * ((p + q) / 2 - x)
        stays = land.crossed(np.concatenate([p, y]), np.concatenate([y, q]), 0.1).reshape(2, -1).any(axis=0)
        out = np.concatenate([out[:1], np.where(stays[:, None], x, y), out[-1:]])
    return [tuple(float(v) for v in x) for x in out]


def simplified(way: list[tuple[float, float]], land: Land, km: float = 0.03) -> list[tuple[float, float]]:
    """The fewest points, taken greedily, whose straight pieces stay within `km` of the route and off land."""
    at, kept = 0, [way[0]]
    p = np.array(way)
    while at < len(way) - 1:
        last = at + 1
        for k in range(at + 2, len(way)):
            scale = np.array([KM, KM * np.cos(np.radians(p[at, 0]))])
            d, inner = (p[k] - p[at]) * scale, (p[at + 1 : k] - p[at]) * scale
            t = np.clip(inner @ d / max(float(d @ d), 1e-12), 0, 1)
            if np.hypot(*(inner - t[:, None] * d).T).max() > km or land.crosses(tuple(p[at]), tuple(p[k])):
                break
            last = k
        kept.append(way[last])
        at = last
    return kept


def crosses_land(a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column, land: Land) -> Column:
    """Whether the straight line between two places crosses land, as an Arrow function."""

    @F.pandas_udf("boolean")
    def test(y: pd.Series, x: pd.Series, v: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(land.crossed(np.column_stack([y, x]).astype(float), np.column_stack([v, u]).astype(float)))

    return test(a_lat, a_lon, b_lat, b_lon)


def crossing_gaps(track: DataFrame, land: Land) -> DataFrame:
    """Gaps of time or distance of each journey whose straight line crosses land, with the courses before and after."""
    w = tracks.ordered("journey")
    p = lambda k: [F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w) for c in ("lat", "lon")]
    a, b = p(1), [F.col("lat"), F.col("lon")]
    rows = track.withColumns({"a_lat": a[0], "a_lon": a[1], "a_t": F.lag("t").over(w), "a_tier": F.lag("tier").over(w), "entry": geo.bearing_deg(*p(2), *a), "leave": geo.bearing_deg(*b, *p(-1))})
    wide = (F.col("t") - F.col("a_t") > GAP_MS) | (geo.haversine_km(F.col("a_lat"), F.col("a_lon"), *b) > GAP_KM)
    gaps = rows.filter(F.col("a_t").isNotNull() & wide).filter(crosses_land(F.col("a_lat"), F.col("a_lon"), *b, land))
    return gaps.select("mmsi", "journey", "a_t", F.col("t").alias("b_t"), "a_lat", "a_lon", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), "entry", "leave", "length", "a_tier", F.col("tier").alias("b_tier"))


def land_gaps(fixes: DataFrame, land: Land) -> DataFrame:
    """The crossing gaps of fixes as they are, less those that hardly move."""
    return crossing_gaps(tracks.journeys(tracks.dedup(fixes)), land)


#: What a way follows from.
WAY = ("a_lat", "a_lon", "b_lat", "b_lon", "entry", "leave", "weight")


def water_routes(gaps: DataFrame, land: Land, max_cells: int = MAX_CELLS, full: bool = False) -> DataFrame:
    """(mmsi, segment, seq, t, lat, lon): the inferred points inside each gap that has a way over water.

    Without `full` only the points that the way needs are kept. Times are spread evenly over the full way. A way follows
    from its ends, courses and weight alone, so gaps with the same ones share a way, and each is searched once.
    """
    keyed = gaps.withColumn("segment", vessels.segment_key(F.col("a_t"), F.col("b_t"), F.col("length"))).withColumn("weight", vessels.channel_weight(F.col("length")))
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    keyed = saved(keyed.select("mmsi", "segment", "a_t", "b_t", "a_lat", "a_lon", "b_lat", "b_lon", known("entry"), known("leave"), "weight"))  # two steps read it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            out = []
            for r in g.itertuples():
                way = route((r.a_lat, r.a_lon), (r.b_lat, r.b_lon), land, r.weight, r.entry, r.leave, max_cells)
                if not way or len(way) < 3:
                    continue
                way = smoothed(way, land)
                step = {p: k for k, p in enumerate(way)}
                inner = (way if full else simplified(way, land))[1:-1]
                out += [(*r[1:], k, step[p], len(way) - 1, p[0], p[1]) for k, p in enumerate(inner)]
            kinds = {**dict.fromkeys(WAY, float), "seq": "int32", "step": "int32", "steps": "int32", "lat": float, "lon": float}
            yield pd.DataFrame(out, columns=[*kinds]).astype(kinds)

    count = int(gaps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are few and take long, so small partitions are not put together
    ways = keyed.select(*WAY).distinct().repartition(count, *WAY).mapInPandas(run, ", ".join(f"{c} double" for c in WAY) + ", seq int, step int, steps int, lat double, lon double")
    ways = saved(ways).withColumnsRenamed({c: f"way_{c}" for c in WAY})
    met = F.lit(True)
    for c in WAY:
        met = met & F.col(c).eqNullSafe(F.col(f"way_{c}"))
    t = F.col("a_t") + (F.col("b_t") - F.col("a_t")) * F.col("step") / F.col("steps")
    return keyed.join(ways, met).select("mmsi", "segment", "seq", t.cast("double").alias("t"), "lat", "lon")
