"""Tables in parts, regions on demand, the trail job's store, scan state and older stores."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewake.operators import routing, stored, trails
from tidewake.sources import regions
from tidewake.streaming import ingest as stream

RING = "array<struct<lat:double,lon:double>>"
ROWS = "k bigint, n int, v string"


def table(spark, root, **how):
    return stored.Parts(spark, str(root), ROWS, ("k",), count=8, **how)


def content(parts, **how):
    return sorted(map(tuple, parts.read(**how).collect()))


def test_only_changed_parts_are_written(spark, tmp_path):
    parts = table(spark, tmp_path)
    assert parts.version() == 0 and content(parts) == []
    assert parts.replace(spark.createDataFrame([(k, j, "a") for k in range(40) for j in (0, 1)], ROWS), token="one") == 1
    first = parts.manifest()["parts"]
    assert parts.replace(spark.createDataFrame([(3, 0, "b")], ROWS), spark.createDataFrame([(5,)], "k bigint"), token="two") == 2
    second = parts.manifest()["parts"]
    touched = [p for p in first if first[p] != second.get(p)]
    assert 1 <= len(touched) <= 2
    assert content(parts) == sorted([(k, j, "a") for k in range(40) if k not in (3, 5) for j in (0, 1)] + [(3, 0, "b")])
    assert len(content(parts, version=1)) == 80
    assert parts.replace(spark.createDataFrame([(3, 0, "c")], ROWS), token="two") == 2 and (3, 0, "b") in content(parts)
    assert parts.replace(spark.createDataFrame([], ROWS), spark.createDataFrame([(k,) for k in range(40)], "k bigint")) == 3 and content(parts) == []


def test_a_job_that_dies_before_the_name_changes_nothing(spark, tmp_path, monkeypatch):
    parts = table(spark, tmp_path)
    parts.replace(spark.createDataFrame([(1, 0, "a")], ROWS), token="one")
    put = stored.Folder.put
    monkeypatch.setattr(stored.Folder, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        parts.replace(spark.createDataFrame([(1, 0, "b")], ROWS), token="two")
    monkeypatch.setattr(stored.Folder, "put", put)
    assert parts.version() == 1 and content(table(spark, tmp_path)) == [(1, 0, "a")]
    assert parts.replace(spark.createDataFrame([(1, 0, "b")], ROWS), token="two") == 2 and content(parts) == [(1, 0, "b")]
    assert len(parts.vacuum(1)) == 2 and content(parts) == [(1, 0, "b")]
    with pytest.raises(FileExistsError):
        parts.folder.put("manifest/2.json", "{}")


def square(y, x, r):
    return [{"lat": y + a * r, "lon": x + b * r} for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1))]


def test_regions_load_when_an_extent_meets_them(spark, tmp_path):
    files = regions.region_files(spark, str(tmp_path))
    rows = [(r, "land", 1, square(y, x, 0.5), []) for r, y, x in (("a", 48.0, -123.0), ("b", 33.0, -118.0), ("c", 21.0, -157.0), ("d", 40.0, -70.0))]
    files.replace_parts(spark.createDataFrame(rows, regions.SCHEMA))
    about = files.manifest()["parts"]
    assert (about["a"]["south"], about["a"]["east"], about["a"]["vertices"]) == (47.5, -122.5, 4)
    for r in "bc":  # one file is broken, one region is gone
        folder = tmp_path / about[r]["folder"]
        for name in os.listdir(folder):
            (folder / name).write_bytes(b"broken") if r == "b" and name.endswith(".parquet") else os.remove(folder / name)
    os.rmdir(tmp_path / about["c"]["folder"])
    box = lambda *b: spark.createDataFrame([tuple(map(float, b))], "south double, west double, north double, east double")
    here = regions.Regions(spark, str(tmp_path))
    read = []
    here.files.rows_of = lambda parts, options=None: read.append(parts) or stored.Parts.rows_of(here.files, parts, options)
    assert [r.region for r in here.within(box(47, -124, 47.5, -122.9)).collect()] == ["a"] and [set(p) for p in read] == [{"a"}]
    assert all("part=a" in f for f in stored.Parts.rows_of(here.files, read[0]).inputFiles())
    assert [r.region for r in here.within(box(30, -120, 35, -117)).collect()] == ["a"]
    assert [r.region for r in here.within(box(20, -160, 22, -150)).collect()] == ["a"] and set(here.known) == {"a", "b", "c"}
    read.clear()
    assert sorted(r.region for r in here.within(box(30, -130, 50, -60)).collect()) == ["a", "d"] and [set(p) for p in read] == [{"d"}]
    assert here.within(box(30, -130, 50, -60)).count() == 2 and len(read) == 1
    files.replace_parts(spark.createDataFrame([("a", "water", 7, square(48.0, -123.0, 0.1), [square(48.0, -123.0, 0.01)])], regions.SCHEMA))
    assert [(r.kind, len(r.holes)) for r in regions.Regions(spark, str(tmp_path)).within(box(48, -123, 48, -123)).collect()] == [("water", 1)]


HOUR = 3_600_000
LAND = routing.Land([[(48.2, -123.5), (48.4, -123.5), (48.4, -123.3), (48.2, -123.3)]])


def test_the_trail_job_writes_what_it_decides_once(spark, tmp_path, monkeypatch):
    rows = [(1, k, k * HOUR, 48.3, x, 5.0, "local", 200) for k, x in enumerate((-123.7, -123.6, -123.2, -123.1))] + [(2, 10 + k, k * HOUR, 47.0 + k / 10, -124.0, 5.0, "local", None) for k in range(3)]
    fixes = spark.createDataFrame(rows, "mmsi long, id long, t long, lat double, lon double, speed double, tier string, length long").withColumn("fake", F.lit(False))
    vessel = spark.createDataFrame([(1, 1, 0, 3 * HOUR, 9), (2, 1, 0, 2 * HOUR, 8)], "mmsi long, of_interest int, first_direct_at long, last_pos_ts long, last_seen long")
    store = trails.TrailStore(spark, str(tmp_path))
    replace = stored.Parts.replace
    monkeypatch.setattr(stored.Parts, "replace", lambda self, *a: (_ for _ in ()).throw(RuntimeError("killed")) if "done" in self.schema else replace(self, *a))
    with pytest.raises(RuntimeError):  # points are named, the state is not
        store.run(fixes, vessel, LAND, "global-1")
    monkeypatch.setattr(stored.Parts, "replace", replace)
    first = sorted(map(tuple, store.points.read().collect()))
    assert first and store.state.read().count() == 0
    assert store.run(fixes, vessel, LAND, "global-1") and sorted(map(tuple, store.points.read().collect())) == first
    assert {r.mmsi: r.done for r in store.state.read().collect()} == {1: 3 * HOUR, 2: 2 * HOUR}
    assert [(r.mmsi, r.points) for r in store.segments.read().collect()] == [(1, len(first))]
    assert not store.run(fixes, vessel, LAND, "global-1")
    version = store.points.version()
    assert store.run(fixes, vessel, LAND, "global-2") and sorted(map(tuple, store.points.read().collect())) == first
    assert trails.due(vessel, store.state.read()).count() == 0
    assert [r.mmsi for r in trails.due(vessel, store.state.read(), regenerate=True, limit=1).collect()] == [1]
    assert [r.mmsi for r in trails.due(vessel, store.state.read(), regenerate=True, only=2).collect()] == [2]
    assert store.points.version() >= version


def messages(spark, at):
    rows = [(k, json.dumps({"MessageType": "PositionReport", "MetaData": {"MMSI": 316000000 + k, "ShipName": f"V{k}", "latitude": 48.3 + at / 1e3, "longitude": -123.4}, "Message": {"PositionReport": {"Sog": 9.0, "TrueHeading": 10}}})) for k in range(3)]
    return spark.createDataFrame(rows, "seq bigint, value string")


def test_scan_state_and_the_call_after_a_scan(spark, tmp_path):
    raw = messages(spark, 0).withColumn("scan_ts", F.lit(1000).cast("bigint"))
    raw.coalesce(1).write.parquet(str(tmp_path / "in"))
    store, called = stream.Store(spark, str(tmp_path / "store")), []
    read = lambda: spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))

    def fails(store, token):
        called.append(token)
        raise RuntimeError("killed after the batch is in the store")

    with pytest.raises(Exception, match="killed"):
        stream.run(read(), store, "direct", str(tmp_path / "check"), after=fails).awaitTermination(300)
    again = stream.Store(spark, str(tmp_path / "store"))
    assert again.version == 0 and {r.key: r.value for r in again.meta().collect()} == {"last_scan_direct": 1000}
    stream.run(read(), again, "direct", str(tmp_path / "check"), after=lambda s, token: called.append(token)).awaitTermination(300)
    assert called == ["direct-0", "direct-0"] and again.positions().count() == 3
    for k, cursor in ((1, 12), (2, 24), (3, 36), (4, 7)):
        stream.apply_scan(again, k, messages(spark, k), "direct", 1000 + k, places=41, step=12)
        assert {r.key: r.value for r in again.meta().collect()} == {"last_scan_direct": 1000 + k, "cursor_direct": cursor}


def test_an_older_store_opens_as_the_newest(spark, tmp_path):
    root = str(tmp_path / "old")
    columns = [c for c in stream.VESSELS.split(", ") if not c.startswith("direct_entry_count")]
    rows = [(m, None, None, None, None, 1.0, 2.0, None, None, None, 5, 1, interest, "direct", None, 2) for m, interest in ((1, 1), (2, 1), (3, 0))]
    spark.createDataFrame(rows, ", ".join(columns)).write.parquet(f"{root}/vessels/batch=7")
    spark.createDataFrame([(1, 1, 1.0, 2.0, None, None, 3, "global"), (2, 2, 1.0, 2.0, None, None, 3, "local"), (3, 3, 1.0, 2.0, None, None, 3, "global")], stream.POSITIONS).write.parquet(f"{root}/positions/batch=7")
    spark.createDataFrame([], stream.VISITS).write.parquet(f"{root}/visits/batch=7")
    spark.createDataFrame([(7, 2)], "batch bigint, schema int").write.json(f"{root}/current")
    store = stream.Store(spark, root)
    want = {1: (1, "global"), 2: (1, "local"), 3: (0, "direct")}
    assert store.schema() == 2 and {r.mmsi: (r.direct_entry_count, r.max_extent) for r in store.vessels().collect()} == want
    stream.apply_scan(store, 8, messages(spark, 0), "direct", 9)
    newer = stream.Store(spark, root)
    assert newer.schema() == stream.NEWEST and {r.mmsi: (r.direct_entry_count, r.max_extent) for r in newer.vessels().filter("mmsi < 9").collect()} == want
