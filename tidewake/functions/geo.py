"""Great-circle and plane geometry as column expressions; angles in degrees, all inputs may be null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NM, KM = 3440.065, 6371.0


def _haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * radius)


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return _haversine(lat1, lon1, lat2, lon2, NM)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return _haversine(lat1, lon1, lat2, lon2, KM)


def bearing_rad(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course from the first point, not brought into a range."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.atan2(y, x)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course in [0, 360)."""
    return F.pmod(F.degrees(bearing_rad(lat1, lon1, lat2, lon2)), F.lit(360.0))


def cross_track_nm(lat0: Column, lon0: Column, course: Column, lat: Column, lon: Column) -> Column:
    """Distance of a point from the great circle through the origin with a course in radians."""
    d = haversine_nm(lat0, lon0, lat, lon) / NM
    return F.abs(F.asin(F.sin(d) * F.sin(bearing_rad(lat0, lon0, lat, lon) - course)) * NM)


def heading_delta(a: Column, b: Column) -> Column:
    """Angle between two headings in [0, 180]; null if either is."""
    d = F.abs(a - b) % 360
    return F.when(d > 180, 360 - d).otherwise(d)


def point_segment_km(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance to a segment on the plane that touches the sphere at the point."""
    k = F.cos(F.radians(lat))
    per = 111.32
    ax, ay, bx, by = (lon1 - lon) * k * per, (lat1 - lat) * per, (lon2 - lon) * k * per, (lat2 - lat) * per
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))))
    x, y = ax + t * dx, ay + t * dy
    return F.sqrt(x * x + y * y)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive on all sides."""
    south, west, north, east = box
    return lat.between(south, north) & lon.between(west, east)


def boxes_overlap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether two boxes (south, west, north, east) share a point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd test of a point in a ring, an array of structs (lat, lon); edges are half open."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(ring, F.when(i == 0, n).otherwise(i))
        away = (p["lat"] > lat) != (q["lat"] > lat)
        return away & (lon < (q["lon"] - p["lon"]) * F.try_divide(lat - p["lat"], q["lat"] - p["lat"]) + p["lon"])

    marked = F.transform(ring, lambda p, i: F.when(crosses(p, i), 1).otherwise(0))
    return F.aggregate(marked, F.lit(0), lambda a, x: a + x) % 2 == 1


def in_water(lat: Column, lon: Column, outer: Column, holes: Column) -> Column:
    """In the outer ring and in none of the holes."""
    return in_ring(lat, lon, outer) & ~F.exists(F.coalesce(holes, F.array().cast("array<array<struct<lat:double,lon:double>>>")), lambda h: in_ring(lat, lon, h))


def rounded(x: Column, places: int = 6) -> Column:
    """Half up, as floor(x * 10^places + 0.5) / 10^places; the same in any engine, which round() is not."""
    k = float(10**places)
    return F.floor(x * k + 0.5) / k
