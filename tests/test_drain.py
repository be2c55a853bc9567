"""A bounded drain of frames gives what the merge of the same messages gives."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewake.sources import adapter, ais
from tidewake.streaming import drain

SMALL = "/root/testdata/sf0.001"
BOXES = [(48.0, -124.0, 48.5, -123.0), (33.0, -119.0, 34.0, -118.0)]


def test_a_drain_gives_the_merge_of_its_messages(spark, tmp_path):
    fix = adapter.fixes(spark, SMALL)
    raw = adapter.messages(fix, hours=24 * 60).select("seq", "value").orderBy("seq").collect()
    (tmp_path / "in").mkdir()
    for k in range(6):
        lines = [r.value for r in raw[k * len(raw) // 6 : (k + 1) * len(raw) // 6]] + (["{broken", json.dumps({"MessageType": "Other", "MetaData": {"MMSI": 1}})] if k == 2 else [])
        (tmp_path / "in" / f"{k:04}.json").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "_hidden").write_text("not read")
    heard = drain.drain(spark, str(tmp_path / "in"), str(tmp_path / "work"), 20_000, files_per_batch=2)
    want = ais.merge(ais.parse(spark.createDataFrame(raw)), ("mmsi",))
    assert sorted(map(str, heard.select(want.columns).collect())) == sorted(map(str, want.collect())) and heard.count() > 5
    number = heard.agg(F.min("mmsi")).first()[0]
    some = drain.drain(spark, str(tmp_path / "in"), str(tmp_path / "work"), 15_000, BOXES, [number, number + 1])
    inside = ais.parse(spark.createDataFrame(raw)).filter(F.col("mmsi").isin(number, number + 1))
    inside = inside.filter("lat IS NULL OR (lat BETWEEN 48.0 AND 48.5 AND lon BETWEEN -124.0 AND -123.0) OR (lat BETWEEN 33.0 AND 34.0 AND lon BETWEEN -119.0 AND -118.0)")
    assert sorted(map(str, some.collect())) == sorted(map(str, ais.merge(inside, ("mmsi",)).select(some.columns).collect())) and some.count() > 0


def test_a_reader_shows_no_files_after_its_time(tmp_path):
    (tmp_path / "a.json").write_text("{}\n")
    reader = drain.FrameReader({"path": str(tmp_path), "drainMs": "60000"})
    assert reader.latestOffset() == {"files": 1}
    (tmp_path / "b.json").write_text("{}\n")
    reader.began -= 61
    assert reader.latestOffset() == {"files": 1} and [p.path[-6:] for p in reader.partitions({"files": 0}, {"files": 1})] == ["a.json"]
    late = drain.FrameReader({"path": str(tmp_path), "filesPerBatch": "1"})
    assert [late.latestOffset()["files"] for _ in range(3)] == [1, 2, 2]
