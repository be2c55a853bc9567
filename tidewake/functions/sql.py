"""The column functions under names for SQL, as temporary functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewake.functions import geo, vessels

#: name: (arguments, type of the result, how to make it from columns)
FUNCTIONS = {
    "haversine_nm": ("lat1 double, lon1 double, lat2 double, lon2 double", "double", geo.haversine_nm),
    "haversine_km": ("lat1 double, lon1 double, lat2 double, lon2 double", "double", geo.haversine_km),
    "bearing_deg": ("lat1 double, lon1 double, lat2 double, lon2 double", "double", geo.bearing_deg),
    "heading_delta": ("a double, b double", "double", geo.heading_delta),
    "tier_of": ("lat double, lon double", "string", vessels.tier_of),
    "is_large": ("kind int, length bigint", "boolean", vessels.is_large),
    "is_confirmed_small": ("kind int, length bigint", "boolean", vessels.is_confirmed_small),
    "is_inbound": ("kind int, length bigint, destination string", "boolean", vessels.is_inbound),
    "worker_class": ("kind int", "string", vessels.worker_class),
    "simulator_class": ("kind int", "string", vessels.simulator_class),
    "display_class": ("mmsi bigint, name string, kind int, length bigint", "string", vessels.display_class),
    "journey_class": ("extent string, entries bigint", "string", vessels.journey_class),
    "channel_weight": ("length bigint", "double", vessels.channel_weight),
    "age_label": ("age_ms bigint", "string", vessels.age_label),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to spark.sql; returns their names."""
    for name, (arguments, kind, make) in FUNCTIONS.items():
        names = [a.split()[0] for a in arguments.split(", ")]
        plan = spark.createDataFrame([], arguments).select(make(*[F.col(n) for n in names]).alias("x"))._jdf.queryExecution().analyzed()
        body = plan.projectList().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN CAST({body} AS {kind})")
    return list(FUNCTIONS)
