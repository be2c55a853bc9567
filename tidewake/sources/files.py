"""Files of tracks and polygons: captured tracks, store dumps, GeoJSON and OSM elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACK = "mmsi bigint, name string, vesselLength int, points array<struct<lat:double,lon:double,speed:double,t:bigint,tier:string,heading:int>>"
GEOMETRY = "type:string,coordinates:string"


def captured_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Points of captured tracks (newest first in the file), with ids that grow with time."""
    rows = spark.read.schema(TRACK).json(path, multiLine=True).select("mmsi", "name", F.col("vesselLength").alias("length"), F.posexplode("points").alias("pos", "p"))
    return rows.select("mmsi", "name", F.col("length").cast("bigint"), (-F.col("pos")).cast("bigint").alias("id"), "p.*")


def store_dump(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a store dump, [{results: [...]}], oldest first."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.*")
    return rows.withColumn("t", F.unix_millis(F.to_timestamp("ts_utc")) if "ts_utc" in rows.columns else F.col("ts")).orderBy("t")


def geojson_rings(spark: SparkSession, path: str) -> DataFrame:
    """(feature, part, ring): outer rings of polygons and multipolygons; coordinates come as (lon, lat)."""
    f = spark.read.schema(f"features array<struct<geometry:struct<{GEOMETRY}>>>").json(path, multiLine=True)
    g = f.select(F.posexplode("features").alias("feature", "f")).select("feature", "f.geometry.type", "f.geometry.coordinates")
    many = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", "array<array<array<double>>>"))).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", "array<array<array<array<double>>>>"))
    parts = g.select("feature", F.posexplode(many).alias("part", "rings"))
    return parts.select("feature", "part", F.transform(F.element_at("rings", 1), lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon"))).alias("ring"))


def osm_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ways, nodes) of one or more dumps, {elements: [...]}; a way that several dumps have is one way."""
    e = spark.read.schema("elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>").json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    return e.filter("type = 'way'").select("id", "nodes", "tags").dropDuplicates(["id"]), e.filter("type = 'node'").select("id", "lat", "lon").dropDuplicates(["id"])
