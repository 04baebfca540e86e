"""Dates, numbers and small JSON of the posting engine, as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0

# Places that a distance search knows, (latitude, longitude).
CITIES = {
    "berlin": (52.5200, 13.4050), "hamburg": (53.5753, 10.0153), "münchen": (48.1351, 11.5820), "munich": (48.1351, 11.5820), "köln": (50.9333, 6.9500), "cologne": (50.9333, 6.9500),
    "frankfurt": (50.1109, 8.6821), "stuttgart": (48.7758, 9.1829), "düsseldorf": (51.2217, 6.7762), "dortmund": (51.5136, 7.4653), "essen": (51.4556, 7.0116), "bremen": (53.0793, 8.8017),
    "leipzig": (51.3397, 12.3731), "dresden": (51.0504, 13.7373), "hannover": (52.3759, 9.7320), "nürnberg": (49.4521, 11.0767), "nuremberg": (49.4521, 11.0767), "duisburg": (51.4344, 6.7623),
    "bochum": (51.4818, 7.2162), "wuppertal": (51.2562, 7.1508), "mannheim": (49.4875, 8.4660), "bonn": (50.7374, 7.0982), "karlsruhe": (49.0069, 8.4037), "münster": (51.9607, 7.6261),
    "augsburg": (48.3705, 10.8978), "wiesbaden": (50.0782, 8.2398), "gelsenkirchen": (51.5177, 7.0857), "mönchengladbach": (51.1805, 6.4428), "braunschweig": (52.2689, 10.5268), "kiel": (54.3233, 10.1394),
    "aachen": (50.7753, 6.0839), "magdeburg": (52.1205, 11.6276), "freiburg": (47.9990, 7.8421), "oberhausen": (51.4963, 6.8638), "erfurt": (50.9848, 11.0299), "rostock": (54.0887, 12.1400),
    "mainz": (49.9929, 8.2473), "kassel": (51.3127, 9.4797), "halle": (51.4828, 11.9697), "heidelberg": (49.3988, 8.6724),
}


def iso_timestamp(col: Column) -> Column:
    """ISO text as a timestamp, Z as UTC, 26 characters at most, null if it isn't one."""
    return F.try_to_timestamp(F.nullif(F.left(F.replace(col, F.lit("Z"), F.lit("+00:00")), F.lit(26)), F.lit("")))


def posted_timestamp(col: Column) -> Column:
    """Like iso_timestamp with the whole text, else its first ten characters as a date."""
    whole = F.try_to_timestamp(F.nullif(F.replace(col, F.lit("Z"), F.lit("+00:00")), F.lit("")))
    return F.coalesce(whole, F.try_to_timestamp(F.left(col, F.lit(10)), F.lit("yyyy-MM-dd")))


def anchor(now: Column, hour: int) -> Column:
    """The last instant at or before ``now`` at this full hour, UTC."""
    today = F.date_trunc("day", now) + F.make_dt_interval(hours=F.lit(hour))
    return F.when(today > now, today - F.expr("INTERVAL 1 DAY")).otherwise(today)


def is_stale(at: Column, now: Column, days: int) -> Column:
    return at.isNull() | (at < now - F.make_dt_interval(days=F.lit(days)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def geocode(place: str) -> tuple[float, float] | None:
    """A known place's coordinates: by name, else the first of which one holds the other."""
    key = place.strip().lower()
    return CITIES.get(key) or next((at for name, at in CITIES.items() if name in key or key in name), None)


def bounding_box(lat: Column, lon: Column, centre: tuple[float, float], km: float) -> Column:
    d_lat = km / KM_PER_DEGREE
    d_lon = km / (KM_PER_DEGREE * max(0.01, math.cos(math.radians(centre[0]))))
    return lat.between(centre[0] - d_lat, centre[0] + d_lat) & lon.between(centre[1] - d_lon, centre[1] + d_lon)


def rounded(col: Column, digits: int) -> Column:
    """To so many decimals by the double's exact value, as Python rounds; half to even where the value is just between two."""
    x, scale = F.abs(col.cast("double")), float(10**digits)
    # The product and what it lost in rounding, by halves of the factors that multiply without loss; together they are exact.
    product, split = x * scale, x * 134217729.0
    high = split - (split - x)
    lost = (high * scale - product) + (x - high) * scale
    whole = F.floor(product).cast("double")
    over = product - (whole + 0.5)
    up = (over > 0) | ((over == 0) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
    # Beyond 2^52 there are no decimals, and the halves of very large numbers would overflow.
    near = F.when(product < 4503599627370496.0, (whole + F.when(up, 1.0).otherwise(0.0)) / scale).otherwise(x)
    return F.when(col < 0, -near).otherwise(near)


def counter(stats: Column, name: str) -> Column:
    """A whole number out of JSON, 0 where it is missing."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(stats), f"$.{name}", "bigint"), F.lit(0))


def city_table(spark):
    """(city, lat, lon, pos) of the places that a distance search knows."""
    return spark.createDataFrame([(n, *at, i) for i, (n, at) in enumerate(CITIES.items())], "city string, lat double, lon double, pos int")
