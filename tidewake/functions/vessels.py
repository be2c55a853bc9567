"""Predicates, classes and times of vessels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewake.functions import dims
from tidewake.functions.geo import haversine_nm, heading_delta, in_box

def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _any(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs)


def by_tier(tier: Column, values: dict[str, float]) -> Column:
    """The value of a tier; unknown tiers get the local one."""
    return F.when(tier == "direct", values["direct"]).when(tier == "global", values["global"]).otherwise(values["local"])


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def tier_of(lat: Column, lon: Column) -> Column:
    return F.when(in_box(lat, lon, dims.DIRECT_BOX), "direct").when(in_box(lat, lon, dims.LOCAL_BOX), "local").otherwise("global")


def is_large(kind: Column, length: Column) -> Column:
    return _yes(kind.between(70, 89)) | _yes(length >= dims.LARGE_M)


def is_confirmed_small(kind: Column, length: Column) -> Column:
    """Not large, and enough is known to say so."""
    return (kind.isNotNull() | length.isNotNull()) & ~is_large(kind, length)


def is_low_value(kind: Column) -> Column:
    return _yes(kind.isin(*dims.LOW_VALUE_TYPES))


def is_moving(speed: Column) -> Column:
    return _yes(speed > dims.MOVING_KN)


def is_inbound(kind: Column, length: Column, destination: Column) -> Column:
    """Large, or bound for a port of the region and either fairly large or of an ocean-going type."""
    named = _yes(_any([F.upper(destination).contains(t) for t in dims.INBOUND]))
    return _yes(length >= dims.BIG_M) | (named & (_yes(length >= dims.MID_M) | _yes(kind.between(60, 89))))


def worker_class(kind: Column) -> Column:
    return F.when(kind.between(70, 79), "cargo").when(kind.between(80, 89), "tanker").when(kind.between(60, 69), "passenger").when(kind.isin(36, 37), "pleasure").when(kind.between(31, 32), "tug").when(kind == 30, "fishing").when(kind.between(40, 49), "ferry").otherwise("unknown")


def simulator_class(kind: Column) -> Column:
    """As worker_class, but a known type of no class is `other`."""
    return F.when(kind.isNotNull() & (worker_class(kind) == "unknown"), "other").otherwise(worker_class(kind))


def display_class(mmsi: Column, name: Column, kind: Column, length: Column) -> Column:
    """The class that is shown: known ferries, names of ferries and cruise ships, state vessels, then the type."""
    up = F.upper(F.coalesce(name, F.lit("")))
    starts = lambda xs: _any([up.startswith(x) for x in xs])
    holds = lambda xs: _any([up.contains(x) for x in xs])
    long_ = lambda m: _yes(length > m)
    return (
        F.when(mmsi.isin(*dims.KNOWN_FERRIES) | starts(dims.FERRY_STARTS) | holds(dims.FERRY_PARTS), "ferry")
        .when((kind.isNull() | kind.between(60, 69)) & (starts(dims.CRUISE_STARTS) | holds(dims.CRUISE_PARTS)), "cruise")
        .when(kind.isNull() & long_(150), "cargo")
        .when(kind.isNull() & starts(dims.STATE_STARTS), "government")
        .when(kind.isNull(), "unknown")
        .when(kind.between(70, 79), "cargo")
        .when(kind.between(80, 89), "tanker")
        .when(kind.between(60, 69) & long_(200), "cruise")
        .when(kind.between(60, 69) | kind.between(40, 49), "ferry")
        .when(kind == 35, "military")
        .when(kind.isin(36, 37), "pleasure")
        .when(kind == 30, "fishing")
        .when(kind.isin(31, 32, 52, 53), "tug")
        .when(kind.between(33, 34) | kind.isin(50, 51) | kind.between(54, 59) | kind.between(90, 99), "government")
        .otherwise("unknown")
    )


def flag(iso2: Column) -> Column:
    """The two regional indicator signs of a country code."""
    sign = lambda k: F.decode(F.unhex(F.concat(F.lit("F09F87"), F.hex(F.ascii(F.substring(iso2, k, 1)) + 101))), "UTF-8")
    return F.concat(sign(1), sign(2))


def journey_class(max_extent: Column, entries: Column) -> Column:
    return F.when(max_extent == "global", "distant_visitor").when((max_extent == "direct") | (entries >= 3), "local_boat").otherwise("passing_through")


def status(speed: Column) -> Column:
    return F.when(speed >= dims.PHANTOM_KN, "moving").otherwise("stopped")


def extent_rank(extent: Column) -> Column:
    return F.when(extent == "direct", 0).when(extent == "local", 1).when(extent == "global", 2)


def wider(a: Column, b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, dims.TIERS)), F.greatest(extent_rank(a), extent_rank(b)) + 1)


def initial_extent(kind: Column, length: Column) -> Column:
    return F.when(is_large(kind, length), "local").otherwise("direct")


def heartbeat_ms(last_pos_ts: Column, now: Column) -> Column:
    """How often a vessel that has been parked for some time is written again."""
    parked = now - last_pos_ts
    (long_, slow), (some, less) = dims.HEARTBEAT_STEPS
    return F.when(parked > long_, slow).when(parked > some, less).otherwise(dims.HEARTBEAT_MS).cast("bigint")


def channel_weight(length: Column) -> Column:
    """Weight of narrow water for a length: 0.5 up to 20 m, 7 from 120 m, linear between, 3 if unknown."""
    at = (length - 20.0) / 100.0
    return F.when(length.isNull(), 3.0).when(length <= 20, 0.5).when(length >= 120, 7.0).otherwise(at * 6.5 + 0.5)


def marker_fade(age_ms: Column, tier: Column) -> Column:
    ttl = F.when(tier == "global", 86_400_000.0).otherwise(7_200_000.0)
    return F.greatest(F.lit(0.30), F.greatest(F.lit(0.0), 1.0 - age_ms / ttl))


def age_label(age_ms: Column) -> Column:
    s = F.floor(age_ms / 1000.0)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s ago"))).when(s < 3600, F.concat(F.floor(s / 60.0).cast("string"), F.lit("m ago"))).otherwise(F.concat(F.floor(s / 3600.0).cast("string"), F.lit("h ago")))


def segment_key(a_ts: Column, b_ts: Column, length: Column, version: int = 1) -> Column:
    return F.concat_ws("-", a_ts.cast("string"), b_ts.cast("string"), F.coalesce(length.cast("string"), F.lit("n")), F.lit(f"v{version}"))


def significant_move(new: dict[str, Column], old: dict[str, Column], tier: Column) -> Column:
    """Whether a fix (lat, lon, speed, heading, kind, ts) says more than the last kept one.

    Below the tier's floor it never does. Above it, one of these does: a long gap in distance or time, a turn, a change
    of speed, a start or a stop. Vessels of low value may have gaps twice as long.
    """
    d = haversine_nm(old["lat"], old["lon"], new["lat"], new["lon"])
    of = lambda k: by_tier(tier, {t: dims.MOVE[t][k] for t in dims.TIERS})
    factor = F.when(is_low_value(new["kind"]), dims.LOW_VALUE_FACTOR).otherwise(1)
    was, now = F.coalesce(old["speed"], F.lit(0.0)), F.coalesce(new["speed"], F.lit(0.0))
    change = (d >= of("gap_nm") * factor) | _yes(new["ts"] - old["ts"] >= of("gap_ms") * factor) | _yes(heading_delta(old["heading"], new["heading"]) >= of("turn")) | (F.abs(now - was) >= of("speed")) | ((was > dims.MOVING_KN) != (now > dims.MOVING_KN))
    return (d >= of("floor")) & change


def scan_kind(minute: Column) -> Column:
    """Which scan a minute of the hour starts, if any."""
    return F.when(minute == 50, "global").when((minute <= 48) & (minute % 2 == 0), "direct").when((minute <= 49) & (minute % 4 == 1), "local").when((minute <= 49) & (minute % 4 == 3), "foreign")
