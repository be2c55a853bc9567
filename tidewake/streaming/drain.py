"""A drain of bounded length: a stream source of frames in files, with boxes, numbers and kinds pushed into it.

A frame is a line of JSON. Files are read in the order of their names, and a file that was put in place is not changed; an
offset is the number of files that were read. Boxes, vessels' numbers and kinds are filtered where a frame is read, as a
feed does that is asked for them; a frame that cannot be parsed passes, so that it is counted where messages are parsed.
After the drain's time the source shows no further files.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewake.sources import ais

Box = tuple[float, float, float, float]


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Frames(InputPartition):
    """One file, and its number in the order of names."""

    path: str
    number: int


class FrameSource(DataSource):
    """Rows (seq, value) of frames. Options: path, boxes and numbers (JSON lists), drainMs, filesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "ais_frames"

    def schema(self) -> str:
        return "seq bigint, value string"

    def streamReader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))


class FrameReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        option = {k.lower(): v for k, v in options.items()}
        self.path = option["path"]
        self.boxes: list[Box] = [tuple(b) for b in json.loads(option.get("boxes", "[]"))]
        self.numbers = frozenset(json.loads(option.get("numbers", "[]")))
        self.ms, self.most = float(option.get("drainms", "inf")), int(option.get("filesperbatch", "1000"))
        self.began, self.shown = time.time(), 0

    def _files(self) -> list[str]:
        fs, root = _folder(self.path)
        return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and not f.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        if time.time() - self.began < self.ms / 1000:
            self.shown = max(self.shown, min(len(self._files()), self.shown + self.most))
        return {"files": self.shown}

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        self.shown = max(self.shown, end["files"])  # a query that starts again goes on where it was
        return [Frames(p, start["files"] + k) for k, p in enumerate(self._files()[start["files"] : end["files"]])]

    def read(self, partition: Frames) -> Iterator[tuple[int, str]]:
        fs, _ = _folder(self.path)
        with fs.open_input_stream(partition.path) as f:
            for k, line in enumerate(f.read().decode("utf-8", "replace").splitlines()):
                if line.strip() and self.wanted(line):
                    yield partition.number << 32 | k, line

    def wanted(self, line: str) -> bool:
        try:
            frame = json.loads(line)
            about = frame["MetaData"]
            kind, number = frame["MessageType"], about["MMSI"]
            lat, lon = about.get("latitude"), about.get("longitude")
        except (ValueError, KeyError, TypeError, AttributeError):
            return True
        if kind not in ais.KINDS or (self.numbers and number not in self.numbers):
            return False
        if not self.boxes or lat is None or lon is None:
            return True
        return any(s <= lat <= n and w <= lon <= e for s, w, n, e in self.boxes)


def frames(spark: SparkSession, path: str, boxes: list[Box] = (), numbers: list[int] = (), drain_ms: float | None = None, files_per_batch: int = 1000) -> DataFrame:
    """The stream of frames (seq, value) in the files of a folder."""
    spark.dataSource.register(FrameSource)
    read = spark.readStream.format("ais_frames").option("path", path).option("boxes", json.dumps(list(boxes))).option("numbers", json.dumps(list(numbers))).option("filesPerBatch", files_per_batch)
    return (read if drain_ms is None else read.option("drainMs", drain_ms)).load()


def drain(spark: SparkSession, path: str, folder: str, drain_ms: float, boxes: list[Box] = (), numbers: list[int] = (), files_per_batch: int = 1000) -> DataFrame:
    """What a drain of some time hears: for each vessel the last word on every field.

    Frames are kept below `folder`, which driver and executors share, in a place of this drain.
    """
    at = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    stream = frames(spark, path, boxes, numbers, drain_ms, files_per_batch)
    query = stream.writeStream.format("parquet").option("path", f"{at}/frames").option("checkpointLocation", f"{at}/offsets").trigger(processingTime="200 milliseconds").start()
    query.awaitTermination(max(1, int(drain_ms / 1000)))
    query.processAllAvailable()
    query.stop()
    raw = spark.read.schema("seq bigint, value string").parquet(f"{at}/frames")
    return ais.merge(ais.parse(raw).withColumn("scan_id", F.lit(0)), ("mmsi",))
