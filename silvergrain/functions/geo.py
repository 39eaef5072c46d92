"""Coordinates: validity, buckets, distance, tiles, degrees."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0
GPS_EPSILON = 0.000001
MAX_TILE_LATITUDE = 85.05112878


def has_gps(lat: Column, lon: Column) -> Column:
    """True for a pair that is present and not the (0, 0) placeholder."""
    a, b = lat.try_cast("double"), lon.try_cast("double")
    return F.coalesce((F.abs(a) > GPS_EPSILON) | (F.abs(b) > GPS_EPSILON), F.lit(False)) & a.isNotNull() & b.isNotNull()


def bucket(value: Column, decimals: int) -> Column:
    return F.round(value, decimals) + F.lit(0.0)


def coord_key(lat: Column, lon: Column, decimals: int = 3) -> Column:
    pattern = f"%.{decimals}f,%.{decimals}f"
    return F.format_string(pattern, bucket(lat, decimals), bucket(lon, decimals))


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular ground distance, exact enough at short range."""
    x = (F.radians(lon2) - F.radians(lon1)) * F.cos((F.radians(lat1) + F.radians(lat2)) / 2)
    y = F.radians(lat2) - F.radians(lat1)
    return F.sqrt(x * x + y * y) * EARTH_RADIUS_M


def tile_x(lon: Column, zoom: Column) -> Column:
    return F.floor((lon + 180) / 360 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_y(lat: Column, zoom: Column) -> Column:
    held = F.least(F.greatest(lat, F.lit(-MAX_TILE_LATITUDE)), F.lit(MAX_TILE_LATITUDE))
    t = F.tan(F.radians(held))
    return F.floor((1 - F.asinh(t) / math.pi) / 2 * F.pow(F.lit(2.0), zoom)).cast("long")


def rational(value: Column) -> Column:
    """``struct<num,den>`` as a double; a zero denominator gives null."""
    return F.when(value["den"] != 0, value["num"].cast("double") / value["den"].cast("double"))


def dms_to_degrees(parts: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds plus hemisphere letter, as signed degrees."""
    deg = (rational(F.get(parts, F.lit(0))) + rational(F.get(parts, F.lit(1))) / 60.0
           + rational(F.get(parts, F.lit(2))) / 3600.0)
    signed = F.when(F.upper(ref).isin("S", "W"), -deg).otherwise(deg)
    return F.when(F.size(parts) == 3, signed)


def altitude(value: Column, ref: Column) -> Column:
    metres = rational(value)
    return F.when(ref == 1, -metres).otherwise(metres)
