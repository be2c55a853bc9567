"""AIS text messages: parsing with bad frames set aside, and the merge of a drain by vessel.

A drain keeps, for each vessel, what its last message of each kind said, field by field and nulls included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions.vessels import blank_to_null

SCHEMA = "MessageType string, MetaData struct<MMSI:bigint,ShipName:string,latitude:double,longitude:double>, Message struct<PositionReport:struct<Sog:double,TrueHeading:int>,ShipStaticData:struct<Type:int,Dimension:struct<A:int,B:int>,Destination:string,Name:string>>"
KINDS = ("PositionReport", "ShipStaticData")


def parse(raw: DataFrame) -> DataFrame:
    """Reports and static data of well-formed frames as flat columns; other kinds and broken frames are left out."""
    m = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"})
    report, static = F.col("m.Message.PositionReport"), F.col("m.Message.ShipStaticData")
    is_report = F.col("m.MessageType") == KINDS[0]
    length = static["Dimension"]["A"] + static["Dimension"]["B"]
    good = raw.withColumn("m", m).filter(F.col("m.MessageType").isin(*KINDS) & F.col("m.MetaData.MMSI").isNotNull())
    return good.select(
        *[c for c in raw.columns if c != "value"], F.col("m.MessageType").alias("kind"), F.col("m.MetaData.MMSI").alias("mmsi"),
        blank_to_null(F.when(is_report, F.col("m.MetaData.ShipName")).otherwise(static["Name"])).alias("name"),
        F.col("m.MetaData.latitude").alias("lat"), F.col("m.MetaData.longitude").alias("lon"), report["Sog"].alias("speed"), F.nullif(report["TrueHeading"], F.lit(511)).alias("heading"),
        F.nullif(static["Type"], F.lit(0)).alias("vessel_type"), F.when(length > 0, length).alias("length"), blank_to_null(static["Destination"]).alias("destination"),
    )


def merge(messages: DataFrame, by: tuple[str, ...] = ("scan_id", "mmsi")) -> DataFrame:
    """One row per drain and vessel: the last word on every field, and whether a position or static data was heard."""
    report, static = F.col("kind") == KINDS[0], F.col("kind") == KINDS[1]

    def last(of: Column, *fields: str) -> Column:
        return F.max_by(F.when(of, F.struct(*fields)), F.when(of, F.col("seq")))

    moves, statics = ("lat", "lon", "speed", "heading"), ("vessel_type", "length", "destination")
    out = messages.groupBy(*by).agg(last(F.lit(True), "name").alias("any"), last(report, *moves).alias("report"), last(static, *statics).alias("static"), F.max(report).alias("has_position"), F.max(static).alias("has_static"))
    return out.select(*by, "any.name", *[f"report.{c}" for c in moves], *[f"static.{c}" for c in statics], "has_position", "has_static")


def complete(merged: DataFrame) -> DataFrame:
    """Vessels whose position was heard."""
    return merged.filter("has_position").drop("has_position", "has_static")


def static_only(merged: DataFrame) -> DataFrame:
    """Vessels of which only static data was heard."""
    return merged.filter(~F.col("has_position") & F.col("has_static")).select("scan_id", "mmsi", "name", "vessel_type", "length", "destination")
