"""Quality of curves against plain loops."""

from __future__ import annotations

import math
import random

from tidewake.operators import quality, routing

CONTROL = "mmsi bigint, journey bigint, id bigint, t double, lat double, lon double, fake boolean"
SAMPLE = "mmsi bigint, journey bigint, id bigint, i int, t double, lat double, lon double"


def plain_km(p, a, b):
    k = 111.32 * math.cos(math.radians((a[0] + b[0]) / 2))
    (ay, ax), (by, bx), (py, px) = ((c[0] * 111.32, c[1] * k) for c in (a, b, p))
    dx, dy = bx - ax, by - ay
    t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(px - ax - t * dx, py - ay - t * dy)


def plain_haversine(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def plain_bearing(a, b):
    p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) % 360


def curves(rng):
    """Control points with steps of all lengths, and samples that stray from them by metres up to many kilometres."""
    controls, samples = [], []
    for v in range(4):
        y, x, line = rng.uniform(30, 60), rng.uniform(-130, -120), []
        for k in range(40):
            line.append((v, k // 25, k, float(1000 * k), y, x, k % 4 == 1))
            step = 10 ** rng.uniform(-4, 0.3)
            y, x = y + rng.uniform(-step, step), x + rng.uniform(-step, step)
        controls += line
        for a, b in zip(line, line[1:]):
            if a[1] == b[1]:
                for i in range(3):
                    off = 10 ** rng.uniform(-5, 0) if i else 0.0
                    samples.append((v, a[1], a[2], i, a[3] + 333 * i, a[4] + (b[4] - a[4]) * i / 3 + rng.choice([-1, 1]) * off, a[5] + (b[5] - a[5]) * i / 3))
        samples += [(v, r[1], r[2], 0, r[3], r[4], r[5]) for r in (line[24], line[39])]
    return controls, samples


def test_strays_and_turns_equal_plain_loops(spark):
    controls, samples = curves(random.Random(11))
    c, s = spark.createDataFrame(controls, CONTROL).repartition(3), spark.createDataFrame(samples, SAMPLE).repartition(3)
    got = {(r.mmsi, r.journey, r.id, r.i): r.km for r in quality.strayed(s, c).collect()}
    turns = {(r.mmsi, r.journey, r.id, r.i): r.turn for r in quality.far_turns(s, c).collect()}
    want_turns = {}
    for v, j in {r[:2] for r in controls}:
        line = [r[4:6] for r in controls if r[:2] == (v, j)]
        real = [r[4:6] for r in controls if r[:2] == (v, j) and not r[6]]
        mine = sorted((r for r in samples if r[:2] == (v, j)), key=lambda r: (r[4], r[2], r[3]))
        for k, r in enumerate(mine):
            assert math.isclose(got[r[:4]], min(plain_km(r[5:], a, b) for a, b in zip(line, line[1:])), abs_tol=1e-9), r
            if 0 < k < len(mine) - 1:
                d = abs(plain_bearing(r[5:], mine[k + 1][5:]) - plain_bearing(mine[k - 1][5:], r[5:])) % 360
                d = 360 - d if d > 180 else d
                if d >= 60 and all(plain_haversine(x, r[5:]) > 2 for x in real):
                    want_turns[r[:4]] = d
    assert set(turns) == set(want_turns) and len(turns) > 10 and all(math.isclose(turns[k], d, abs_tol=1e-6) for k, d in want_turns.items())
    whole = {r.mmsi: r for r in quality.report(s, c).collect()}
    for v, r in whole.items():
        assert r.samples == sum(x[0] == v for x in samples) and r.kinks == sum(k[0] == v for k in want_turns)
        assert math.isclose(r.max_overshoot_km, max(d for k, d in got.items() if k[0] == v), abs_tol=1e-9)


def test_depth_on_land_away_from_real_fixes(spark):
    land = routing.Land([[(48.0, -124.0), (48.1, -124.0), (48.1, -123.9), (48.0, -123.9)]])
    controls = [(1, 0, 0, 0.0, 47.9, -123.95, False), (1, 0, 1, 1.0, 48.2, -123.95, False), (2, 0, 0, 0.0, 48.05, -123.95, False), (2, 0, 1, 1.0, 48.06, -123.95, False)]
    samples = [(1, 0, 0, 0, 0.0, 47.9, -123.95), (1, 0, 0, 1, 0.5, 48.05, -123.95), (1, 0, 1, 0, 1.0, 48.2, -123.95), (2, 0, 0, 0, 0.0, 48.05, -123.95), (2, 0, 1, 0, 1.0, 48.06, -123.95)]
    got = {r.mmsi: (r.land_defects, round(r.max_depth_km, 2)) for r in quality.report(spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(controls, CONTROL), land).collect()}
    assert got == {1: (1, 2.0), 2: (0, 0.0)}
