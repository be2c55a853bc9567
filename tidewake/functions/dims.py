"""Fixed values of the vessel-track model, and the small tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Boxes (south, west, north, east), thresholds by tier, token lists and zones. Results depend on them.
DIRECT_BOX = (48.070, -123.70, 48.524, -123.02)
LOCAL_BOX = (47.0, -128.7, 51.2, -122.0)
TIERS = ("direct", "local", "global")
#: Online compressor: jitter floor in nm, turn in degrees, speed in knots, largest gaps in nm and ms.
MOVE = {
    "direct": {"floor": 0.05, "turn": 15.0, "speed": 1.0, "gap_nm": 0.15, "gap_ms": 180_000},
    "local": {"floor": 0.5, "turn": 25.0, "speed": 2.0, "gap_nm": 3.0, "gap_ms": 1_800_000},
    "global": {"floor": 5.0, "turn": 30.0, "speed": 3.0, "gap_nm": 25.0, "gap_ms": 7_200_000},
}
#: Corridor simulator: corridor and gap in nm, speed in knots, gap in ms.
CORRIDOR = {
    "direct": {"corridor": 0.05, "speed": 1.0, "gap_ms": 600_000, "gap_nm": 0.5},
    "local": {"corridor": 0.30, "speed": 2.0, "gap_ms": 1_800_000, "gap_nm": 3.0},
    "global": {"corridor": 2.00, "speed": 3.0, "gap_ms": 7_200_000, "gap_nm": 25.0},
}
MOVING_KN = 0.5
LOW_VALUE_TYPES = (30, 31, 32, 36, 37, 52)
LOW_VALUE_FACTOR = 2
PHANTOM_KN = 1.5
PHANTOM_STALL_MS = 1_200_000
ZONE_THROTTLE_MS = 1_800_000
HEARTBEAT_MS = 600_000
HEARTBEAT_STEPS = ((21_600_000, 3_600_000), (3_600_000, 1_800_000))  # parked longer than, beat every
LIVE_MS = {"direct": 21_600_000, "local": 259_200_000, "global": 259_200_000}
SEVER_MS = {"direct": 7_200_000, "local": 21_600_000, "global": 21_600_000}
DEDUP_KM = 0.02
SPLINE_SAMPLES = 12
FOREIGN_BATCH, FOREIGN_REFRESH_MS, FOREIGN_POSITION_MS, FOREIGN_MAX_POSITIONS, FOREIGN_MAX_NEW = 12, 21_600_000, 1_800_000, 25, 200
GLOBAL_CHUNK, GLOBAL_ROUNDS = 75, 3
BIG_M, MID_M, LARGE_M = 100, 70, 50
INBOUND = "VANCOUVER,CAVAN,PRINCE RUPERT,CAPRR,VICTORIA,CAVIC,NANAIMO,CANAN,SEATTLE,USSEA,TACOMA,USTIW,EVERETT,USEVR,BELLINGHAM,ANACORTES,PORTLAND,USPDX,CHERRY POINT,PUGET,SALISH".split(",")
KNOWN_FERRIES = (366929710, 311001249)
FERRY_STARTS, FERRY_PARTS = ("WSF ", "QUEEN OF", "SALISH "), (" FERRY",)
CRUISE_STARTS = ("MSC ", "CELEBRITY ", "CARNIVAL ", "NORWEGIAN ", "VIKING ", "SILVER ", "SEABOURN ", "SEVEN SEAS", "QUEEN ELIZABETH", "QUEEN VICTORIA", "QUEEN MARY")
CRUISE_PARTS = ("NOORDAM", "VOLENDAM", "WESTERDAM", "ZUIDERDAM", "KONINGSDAM", "OOSTERDAM", "NIEUW", "ROTTERDAM", "POESIA", "OVATION", "RADIANCE", "SERENADE", "QUANTUM", "ENCORE", "JOY")
STATE_STARTS = ("CCGS ", "USCGC ", "CDN WARSHIP", "YDT ", "RV ", "R/V ", "CG")
#: Country of the first three digits of an MMSI, for the commonest flags; callers may pass a full table.
COUNTRIES = {209: "CY", 211: "DE", 219: "DK", 220: "DK", 227: "FR", 229: "MT", 232: "GB", 235: "GB", 240: "GR", 244: "NL", 247: "IT", 257: "NO", 265: "SE", 303: "US", 308: "BS", 309: "BS", 311: "BS", 316: "CA", 319: "KY", 338: "US", 345: "MX", 351: "PA", 352: "PA", 355: "PA", 357: "PA", 366: "US", 367: "US", 368: "US", 369: "US", 370: "PA", 371: "PA", 372: "PA", 373: "PA", 412: "CN", 413: "CN", 414: "CN", 416: "TW", 431: "JP", 432: "JP", 440: "KR", 441: "KR", 477: "HK", 503: "AU", 512: "NZ", 533: "MY", 538: "MH", 548: "PH", 563: "SG", 564: "SG", 565: "SG", 566: "SG", 636: "LR", 637: "LR"}
#: id, name, kind, reach, south, west, north, east; the first zone that holds a point wins.
ZONES = [
    ("victoria-harbour", "Victoria Harbour", "port", "local", 48.40, -123.41, 48.44, -123.35),
    ("esquimalt", "Esquimalt", "port", "local", 48.42, -123.46, 48.46, -123.41),
    ("vancouver-burrard", "Vancouver (Burrard Inlet)", "port", "local", 49.27, -123.16, 49.32, -122.93),
    ("roberts-bank", "Roberts Bank / Deltaport", "port", "local", 48.98, -123.20, 49.04, -123.09),
    ("fraser-newwest", "Fraser / New Westminster", "river", "local", 49.15, -122.96, 49.23, -122.84),
    ("nanaimo", "Nanaimo", "port", "local", 49.15, -123.98, 49.21, -123.89),
    ("bellingham", "Bellingham", "port", "local", 48.69, -122.54, 48.78, -122.45),
    ("anacortes", "Anacortes", "port", "local", 48.49, -122.64, 48.54, -122.57),
    ("port-angeles", "Port Angeles", "port", "local", 48.10, -123.50, 48.16, -123.40),
    ("everett", "Everett", "port", "local", 47.96, -122.27, 48.02, -122.18),
    ("seattle-elliott", "Seattle (Elliott Bay)", "port", "local", 47.58, -122.40, 47.64, -122.33),
    ("bremerton", "Bremerton", "port", "local", 47.53, -122.66, 47.58, -122.58),
    ("tacoma", "Tacoma (Commencement Bay)", "port", "local", 47.25, -122.46, 47.30, -122.38),
    ("unimak-pass", "Unimak Pass", "chokepoint", "foreign", 54.20, -165.10, 54.45, -164.60),
    ("dixon-entrance", "Dixon Entrance", "chokepoint", "foreign", 54.10, -132.80, 54.55, -132.00),
    ("golden-gate", "Golden Gate", "chokepoint", "foreign", 37.79, -122.50, 37.84, -122.44),
    ("panama-pacific", "Panama Canal (Pacific)", "chokepoint", "foreign", 8.85, -79.60, 8.98, -79.45),
    ("prince-rupert", "Prince Rupert", "port", "foreign", 54.25, -130.40, 54.36, -130.20),
    ("ketchikan", "Ketchikan", "cruise", "foreign", 55.30, -131.70, 55.40, -131.58),
    ("juneau", "Juneau", "cruise", "foreign", 58.26, -134.46, 58.34, -134.34),
    ("glacier-bay", "Glacier Bay", "cruise", "foreign", 58.40, -136.30, 58.75, -135.80),
    ("skagway", "Skagway", "cruise", "foreign", 59.43, -135.36, 59.48, -135.28),
    ("anchorage", "Anchorage / Cook Inlet", "port", "foreign", 61.18, -150.05, 61.28, -149.80),
    ("dutch-harbor", "Dutch Harbor / Unalaska", "port", "foreign", 53.85, -166.62, 53.96, -166.44),
    ("astoria-columbia", "Astoria / Columbia mouth", "river", "foreign", 46.15, -123.95, 46.27, -123.74),
    ("portland", "Portland (Columbia/Willamette)", "river", "foreign", 45.50, -122.78, 45.65, -122.58),
    ("coos-bay", "Coos Bay", "port", "foreign", 43.34, -124.26, 43.44, -124.14),
    ("sf-bay-oakland", "Oakland / SF Bay", "port", "foreign", 37.72, -122.38, 37.84, -122.22),
    ("la-long-beach", "LA / Long Beach", "port", "foreign", 33.60, -118.33, 33.80, -118.10),
    ("san-diego", "San Diego", "port", "foreign", 32.66, -117.26, 32.75, -117.12),
    ("ensenada", "Ensenada", "port", "foreign", 31.82, -116.66, 31.89, -116.58),
    ("cabo-san-lucas", "Cabo San Lucas", "cruise", "foreign", 22.85, -109.96, 22.92, -109.86),
    ("manzanillo", "Manzanillo", "port", "foreign", 19.01, -104.36, 19.11, -104.26),
    ("lazaro-cardenas", "Lázaro Cárdenas", "port", "foreign", 17.90, -102.26, 17.99, -102.14),
    ("honolulu", "Honolulu", "port", "foreign", 21.28, -157.91, 21.35, -157.83),
    ("hilo", "Hilo", "port", "foreign", 19.71, -155.10, 19.77, -155.02),
    ("kahului", "Kahului (Maui)", "cruise", "foreign", 20.88, -156.50, 20.93, -156.44),
    ("tokyo-bay", "Tokyo Bay", "port", "foreign", 35.30, 139.70, 35.70, 140.05),
    ("nagoya", "Nagoya", "port", "foreign", 34.95, 136.78, 35.12, 136.96),
    ("osaka-kobe", "Osaka / Kobe", "port", "foreign", 34.58, 135.18, 34.76, 135.52),
    ("kitakyushu", "Kitakyushu / Moji", "port", "foreign", 33.85, 130.80, 33.97, 131.02),
    ("busan", "Busan", "port", "foreign", 35.04, 128.98, 35.16, 129.14),
    ("shanghai-yangshan", "Shanghai (Yangshan)", "port", "foreign", 30.55, 121.95, 30.72, 122.18),
    ("ningbo-zhoushan", "Ningbo-Zhoushan", "port", "foreign", 29.82, 121.92, 30.08, 122.24),
    ("qingdao", "Qingdao", "port", "foreign", 35.98, 120.18, 36.14, 120.42),
    ("tianjin", "Tianjin", "port", "foreign", 38.88, 117.58, 39.06, 117.88),
    ("hong-kong", "Hong Kong / Shenzhen", "port", "foreign", 22.24, 114.02, 22.42, 114.28),
    ("kaohsiung", "Kaohsiung", "port", "foreign", 22.54, 120.24, 22.66, 120.36),
    ("keelung", "Keelung (Taipei)", "port", "foreign", 25.09, 121.70, 25.18, 121.79),
    ("singapore", "Singapore", "port", "foreign", 1.08, 103.55, 1.36, 104.08),
    ("port-klang", "Port Klang", "port", "foreign", 2.94, 101.28, 3.06, 101.46),
    ("manila", "Manila", "port", "foreign", 14.54, 120.84, 14.66, 121.00),
    ("sydney", "Sydney", "port", "foreign", -33.92, 151.14, -33.82, 151.30),
    ("auckland", "Auckland", "port", "foreign", -36.90, 174.70, -36.80, 174.86),]
# End of the fixed values.

ZONE_SCHEMA = "ordinal int, zone_id string, zone_name string, kind string, reach string, south double, west double, north double, east double"


def zones(spark: SparkSession) -> DataFrame:
    """The zone table in its order."""
    return spark.createDataFrame([(k, *z[:4], *map(float, z[4:])) for k, z in enumerate(ZONES)], ZONE_SCHEMA)


def countries(spark: SparkSession, table: dict[int, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((table or COUNTRIES).items()), "mid int, iso2 string")
