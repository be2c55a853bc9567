"""Coast operators against plain versions: clip and closure of chains, rings of arcs, points in rings, tiles, regions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import coast

RING = "array<struct<lat:double,lon:double>>"
BOX = "box string, south double, west double, north double, east double"


def plain_inside(p, b):
    return b[0] <= p[0] <= b[2] and b[1] <= p[1] <= b[3]


def plain_crossing(a, c, b):
    found = []
    for axis, edge in ((1, b[1]), (1, b[3]), (0, b[0]), (0, b[2])):
        if c[axis] != a[axis]:
            t = (edge - a[axis]) / (c[axis] - a[axis])
            q = [a[0] + (c[0] - a[0]) * t, a[1] + (c[1] - a[1]) * t]
            q[axis] = edge
            if 0 < t <= 1 and b[0] - 1e-9 <= q[0] <= b[2] + 1e-9 and b[1] - 1e-9 <= q[1] <= b[3] + 1e-9:
                found.append((t, len(found), tuple(q)))
    return min(found)[2] if found else None


def plain_clip(chain, b):
    """Pieces of a chain in a box, with crossings."""
    out, now = [], None
    for k, p in enumerate(chain):
        if plain_inside(p, b):
            if now is None:
                now = [x for x in [plain_crossing(chain[k - 1], p, b) if k else None] if x]
            now.append(p)
        elif now is not None:
            now += [x for x in [plain_crossing(chain[k - 1], p, b)] if x]
            out.append(now)
            now = None
    return [x for x in [*out, now or []] if len(x) > 1]


def plain_place(p, b):
    s, w, n, e = b
    if abs(p[0] - s) < 1e-6:
        return p[1] - w
    if abs(p[1] - e) < 1e-6:
        return (e - w) + p[0] - s
    if abs(p[0] - n) < 1e-6:
        return (e - w) + (n - s) + e - p[1]
    return 2 * (e - w) + (n - s) + n - p[0]


def plain_arc(a, z, b):
    """Corners from place a counter-clockwise to place z."""
    s, w, n, e = b
    around, out = 2 * (e - w + n - s), []
    z = z + around if z <= a else z
    for p, corner in ((0, (s, w)), (e - w, (s, e)), (e - w + n - s, (n, e)), (2 * (e - w) + n - s, (n, w))):
        p = p + around if p < a else p
        if a < p < z:
            out.append((p, corner))
    return [c for _, c in sorted(out)]


@pytest.fixture(scope="module")
def walks(spark):
    rng = random.Random(3)
    chains = {}
    for c in range(25):
        y, x, out = rng.uniform(0, 10), rng.uniform(0, 10), []
        for _ in range(rng.randint(1, 60)):
            out.append((y, x))
            y, x = y + rng.uniform(-2, 2), x + rng.uniform(-2, 2)
        chains[c] = out
    boxes = {"a": (2.0, 2.0, 6.0, 7.0), "b": (0.5, 5.0, 9.0, 9.5), "c": (100.0, 100.0, 101.0, 101.0)}
    rows = [("r", c, 10 * k, y, x) for c, v in chains.items() for k, (y, x) in enumerate(v)]
    table = spark.createDataFrame(rows, "region string, chain bigint, seq int, lat double, lon double").repartition(4)
    return chains, boxes, table, spark.createDataFrame([(k, *b) for k, b in boxes.items()], BOX)


def by_piece(rows, *key):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in key), []).append(r)
    return out


def near(a, b):
    return len(a) == len(b) and all(math.isclose(x, y, abs_tol=1e-9) for p, q in zip(a, b) for x, y in zip(p, q))


def test_pieces_and_their_closure_equal_a_walk_along_each_chain(walks):
    chains, boxes, table, box = walks
    pieces = coast.clipped_chains(table, box)
    got = by_piece(pieces.collect(), "chain", "box")
    rings = by_piece(coast.closed_pieces(pieces).collect(), "chain", "box")
    for c, v in chains.items():
        for name, b in boxes.items():
            want = plain_clip(v, b)
            mine = [[(r.lat, r.lon) for r in sorted(p, key=lambda r: r.k)] for _, p in sorted(by_piece(got.get((c, name), []), "piece").items())]
            assert len(mine) == len(want) and all(near(x, y) for x, y in zip(mine, want))
            closed = [p + plain_arc(plain_place(p[-1], b), plain_place(p[0], b), b) + p[:1] for p in want]
            mine = [[(q.lat, q.lon) for q in r.ring] for r in sorted(rings.get((c, name), []), key=lambda r: r.piece)]
            assert len(mine) == len([x for x in closed if len(x) >= 4]) and all(near(x, y) for x, y in zip(mine, [x for x in closed if len(x) >= 4]))


def test_coasts_go_on_to_the_next_that_enters(spark):
    """Two channels cut a box into three lands; with land on the left the middle one is bounded by two coasts."""
    rows = [("r", 1, k, y, 3.0) for k, y in enumerate([-1.0, 2.0, 8.0, 11.0])] + [("r", 2, k, y, 7.0) for k, y in enumerate([11.0, 8.0, 2.0, -1.0])]
    table = spark.createDataFrame(rows, "region string, chain bigint, seq int, lat double, lon double")
    box = spark.createDataFrame([("b", 0.0, 0.0, 10.0, 10.0)], BOX)
    pieces = coast.clipped_chains(table, box)
    linked = coast.linked_pieces(pieces).collect()
    sizes = sorted(r.a for r in coast.linked_pieces(pieces).select(coast.area(F.col("ring")).alias("a")).collect())
    assert [r.chain for r in sorted(linked, key=lambda r: r.chain)] == [1, 2] and sizes == [30.0, 30.0]
    back = table.withColumn("seq", -F.col("seq"))
    both = coast.linked_pieces(coast.clipped_chains(back, box)).select(coast.area(F.col("ring")).alias("a"), F.size("ring").alias("n")).collect()
    assert [(r.a, r.n) for r in both] == [(40.0, 9)]  # one ring of both coasts


def test_cycles_of_links(spark):
    rng = random.Random(1)
    nodes = list(range(1000))
    rng.shuffle(nodes)
    links, want, at = [], {}, 0
    for size in (1, 2, 3, 5, 8, 64, 100):
        ring = nodes[at : at + size]
        at += size
        links += [(a, b) for a, b in zip(ring, [*ring[1:], ring[0]])]
        lead = ring.index(min(ring))
        want |= {x: (min(ring), (k - lead) % size) for k, x in enumerate(ring)}
    path = nodes[at : at + 50]
    links += [*zip(path, path[1:]), (path[-1], None)]
    got = coast.cycles(spark.createDataFrame(links, "node bigint, next bigint")).collect()
    assert {r.node: (r.leader, r.rank) for r in got} == want
    assert coast.cycles(spark.createDataFrame([(1, None)], "node bigint, next bigint")).count() == 0


def plain_rings(arcs):
    """Rings by walking from the first unused arc to whatever arc shares its end."""
    left, out = dict(arcs), []
    for k in sorted(arcs):
        if k not in left:
            continue
        ring = list(left.pop(k))
        while ring[0] != ring[-1] or len(ring) <= 3:
            j = next((j for j in sorted(left) if ring[-1] in (left[j][0], left[j][-1])), None)
            if j is None:
                break
            line = left.pop(j)
            ring += (line if line[0] == ring[-1] else line[::-1])[1:]
        if ring[0] == ring[-1] and len(ring) > 3:
            out.append((k, ring))
    return out


def circle(y, x, r, n, rng):
    return [(y + r * (1 + rng.random() / 4) * math.sin(2 * math.pi * k / n), x + r * (1 + rng.random() / 4) * math.cos(2 * math.pi * k / n)) for k in range(n)]


def cut_into_arcs(ring, rng):
    """A closed ring as arcs of any direction."""
    at = sorted(rng.sample(range(len(ring)), rng.randint(1, min(9, len(ring)))))
    whole = ring[at[0] :] + ring[: at[0]] + [ring[at[0]]]
    ends = [a - at[0] for a in at] + [len(ring)]
    return [whole[a : b + 1][:: rng.choice([1, -1])] for a, b in zip(ends, ends[1:])]


def test_rings_of_shuffled_and_reversed_arcs(spark):
    rng = random.Random(8)
    arcs = [a for k in range(30) for a in cut_into_arcs(circle(k % 6 * 3, k // 6 * 3, 1.0, rng.randint(4, 30), rng), rng)]
    arcs += [[(50.0, 0.0), (51.0, 0.0)], [(51.0, 0.0), (52.0, 1.0), (53.0, 1.0)]]  # these dangle
    rng.shuffle(arcs)
    numbered = dict(enumerate(arcs))
    rows = [("r", "outer", k, [{"lat": y, "lon": x} for y, x in a]) for k, a in numbered.items()]
    got = coast.rings_of_arcs(spark.createDataFrame(rows, f"region string, role string, arc bigint, line {RING}").repartition(5)).collect()
    assert {r.ring_id: [(p.lat, p.lon) for p in r.ring] for r in got} == dict(plain_rings(numbered))


def test_water_with_islands(spark):
    rng = random.Random(2)
    rows, arc = [], 0
    for relation, (y, x) in enumerate([(0.0, 0.0), (0.0, 10.0), (10.0, 0.0)]):
        outer, holes = circle(y, x, 3.0, 24, rng), [circle(y - 1, x, 0.4, 8, rng), circle(y + 1, x, 0.4, 8, rng)][: relation + 1 if relation < 2 else 0]
        for role, ring in [("outer", outer)] + [("inner", h) for h in holes] + ([("inner", circle(40.0, 40.0, 0.3, 6, rng))] if relation == 2 else []):
            for line in cut_into_arcs(ring, rng):
                rows.append(("r", relation, role if role == "inner" else rng.choice(["outer", None, ""]), arc, [{"lat": a, "lon": b} for a, b in line]))
                arc += 1
    rng.shuffle(rows)
    got = coast.water(spark.createDataFrame(rows, f"region string, relation int, role string, arc bigint, line {RING}")).collect()
    assert {r.relation: len(r.holes) for r in got} == {0: 1, 1: 2, 2: 0}


def plain_in_ring(y, x, ring):
    inside = False
    for (a, b), (c, d) in zip(ring, [ring[-1], *ring[:-1]]):
        if (a > y) != (c > y) and x < (d - b) * ((y - a) / (c - a)) + b:
            inside = not inside
    return inside


@pytest.mark.parametrize("degrees", [0.25, 3.0])
def test_points_meet_edges_and_not_rings(spark, degrees):
    rng = random.Random(6)
    rings = [circle(rng.uniform(0, 8), rng.uniform(-4, 4), rng.uniform(0.1, 4), rng.randint(3, 40), rng) for _ in range(25)]
    points = [(rng.uniform(-2, 10), rng.uniform(-6, 6)) for _ in range(300)] + [rings[0][0], rings[1][1]]
    table = spark.createDataFrame([("r", k, [{"lat": y, "lon": x} for y, x in r]) for k, r in enumerate(rings)], f"region string, ring_id int, ring {RING}")
    places = spark.createDataFrame(points + points[:5], "lat double, lon double")
    got = coast.places_in_rings(places, table, ("region", "ring_id"), degrees=degrees).collect()
    assert sorted((r.lat, r.lon, r.ring_id) for r in got) == sorted((*p, k) for p in points for k, r in enumerate(rings) if plain_in_ring(*p, r))


def test_tiles_fill_the_world_around_home(spark):
    tile = coast.tiles(spark)
    assert tile.count() == 8
    world, home = ((b[2] - b[0]) * (b[3] - b[1]) for b in (coast.WORLD, coast.HOME))
    assert math.isclose(tile.agg(F.sum((F.col("north") - F.col("south")) * (F.col("east") - F.col("west")))).first()[0], world - home)
    rng = random.Random(5)
    rings = spark.createDataFrame([("r", k, [{"lat": y, "lon": x} for y, x in circle(rng.uniform(20, 58), rng.uniform(-165, -100), rng.uniform(2, 14), 30, rng)]) for k in range(12)], f"region string, ring_id int, ring {RING}")
    parts = coast.rings_by_box(rings, tile, least=3).groupBy("ring_id").agg(F.sum(coast.area(F.col("ring"))).alias("a"))
    homes = coast.rings_by_box(rings, spark.createDataFrame([("home", *coast.HOME)], BOX), least=3).groupBy("ring_id").agg(F.sum(coast.area(F.col("ring"))).alias("h"))
    for r in rings.select("ring_id", coast.area(F.col("ring")).alias("whole")).join(parts, "ring_id").join(homes, "ring_id", "left").collect():
        assert math.isclose(r.whole - (r.h or 0), r.a, abs_tol=1e-6)
    done = coast.tiled(rings, tile).collect()
    assert done and all(len(r.ring) >= 4 and all(round(p.lat, 3) == p.lat for p in r.ring) for r in done)
    assert coast.tiled(rings, tile, least_km=1e6).count() == 0


def test_a_region_is_built_from_islands_and_water(spark):
    rng = random.Random(4)
    box = spark.createDataFrame([("r", 48.0, -123.0, 49.0, -122.0)], BOX)
    islands = spark.createDataFrame([("r", k, [{"lat": y, "lon": x} for y, x in circle(48.5, -122.5 + k, r, 40, rng)]) for k, r in enumerate((0.1, 0.6, 0.1))] + [("r", 9, [{"lat": y, "lon": x} for y, x in circle(48.4, -122.4, 0.0002, 9, rng)])], f"region string, ring_id int, ring {RING}")
    land = {r.ring_id: r.ring for r in coast.region_land(islands, box).collect()}
    assert set(land) == {0, 1} and all(48 <= p.lat <= 49 and -123 <= p.lon <= -122 for r in land.values() for p in r)
    hole = lambda r: [{"lat": y, "lon": x} for y, x in circle(48.5, -122.5, r, 12, rng)]
    bodies = spark.createDataFrame([("r", 1, hole(0.2), [hole(0.05), hole(0.0001)]), ("r", 2, hole(0.002), [])], f"region string, ring_id int, ring {RING}, holes array<{RING}>")
    assert [(r.ring_id, len(r.holes)) for r in coast.region_water(bodies, box).collect()] == [(1, 1)]
    counts = {(r.kind, r.stage): r.rings for r in coast.build_counts(islands, bodies, box).collect()}
    assert counts == {("land", "given"): 4, ("land", "cut"): 3, ("land", "kept"): 2, ("water", "given"): 2, ("water", "cut"): 2, ("water", "kept"): 1}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "region string, chain bigint, seq int, lat double, lon double")
    box = spark.createDataFrame([("b", 0.0, 0.0, 1.0, 1.0)], BOX)
    pieces = coast.clipped_chains(none, box)
    assert coast.closed_pieces(pieces).count() == 0 and coast.linked_pieces(pieces).count() == 0
    assert coast.rings_of_arcs(spark.createDataFrame([], f"region string, role string, arc bigint, line {RING}")).count() == 0
