"""Region geometry in files: a part for each region, a manifest of boxes, and loading of the regions that extents meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import geo
from tidewake.operators import coast
from tidewake.operators.stored import Parts

SCHEMA = "region string, kind string, ring_id bigint, ring array<struct<lat:double,lon:double>>, holes array<array<struct<lat:double,lon:double>>>"
#: A file that cannot be read, or is gone, counts as absent: coarser layers then take its place.
ABSENT = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}


def region_files(spark: SparkSession, root: str) -> Parts:
    """Land and water rings by region; a build replaces whole regions and names them in the manifest at last."""
    edge = lambda f, g, c: f(F.transform("ring", lambda p: p[c])) if g is None else g(f(F.transform("ring", lambda p: p[c])))
    about = {"south": edge(F.array_min, F.min, "lat"), "west": edge(F.array_min, F.min, "lon"), "north": edge(F.array_max, F.max, "lat"), "east": edge(F.array_max, F.max, "lon"), "vertices": F.sum(F.size("ring"))}
    return Parts(spark, root, SCHEMA, ("region", "kind", "ring_id"), F.col("region"), about=about)


class Regions:
    """Regions of a folder, loaded when an extent first meets their box, and once in a session."""

    def __init__(self, spark: SparkSession, root: str, degrees: float = 5.0):
        self.spark, self.files, self.degrees = spark, region_files(spark, root), degrees
        self.manifest = self.files.manifest()["parts"]
        self.known: dict[str, dict] = {}
        self.loaded: DataFrame | None = None

    def boxes(self) -> DataFrame:
        rows = [(r, *[float(m[s]) for s in coast.SIDES]) for r, m in self.manifest.items()]
        return self.spark.createDataFrame(rows, "region string, south double, west double, north double, east double")

    def met(self, extents: DataFrame) -> DataFrame:
        """(region): those whose box shares a point with one of the extents (south, west, north, east), by cells."""
        cells = coast.box_cells(extents.select(*[F.col(s).alias(f"x_{s}") for s in coast.SIDES], *coast.SIDES), self.degrees).drop(*coast.SIDES)
        both = cells.join(coast.box_cells(self.boxes(), self.degrees), ["cy", "cx"])
        sides = [tuple(F.col(f"{p}{s}") for s in coast.SIDES) for p in ("x_", "")]
        return both.filter(geo.boxes_overlap(*sides)).select("region").distinct()

    def within(self, extents: DataFrame) -> DataFrame:
        """Rings of all regions that these and earlier extents meet; only files of regions that are new are read."""
        new = {r["region"]: self.manifest[r["region"]] for r in self.met(extents).collect() if r["region"] not in self.known}  # at most the manifest
        self.known |= new
        there = {r: m for r, m in new.items() if self.files.folder.exists(m["folder"])}
        if there or self.loaded is None:
            rows = self.files.rows_of(there, ABSENT).persist()
            self.loaded = rows if self.loaded is None else self.loaded.unionByName(rows)
        return self.loaded
