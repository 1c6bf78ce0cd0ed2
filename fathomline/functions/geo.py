"""Spherical geometry as column expressions; angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_NM, EARTH_KM = 3440.065, 6371.0


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def half_chord(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a, b = F.sin(F.radians(lat2 - lat1) / 2.0), F.sin(F.radians(lon2 - lon1) / 2.0)
    # beyond a pole cosines are negative, and what is zero may end up a hair below
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b))


def arc(h: Column, radius: float) -> Column:
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(h), F.sqrt(1.0 - h))


def haversine_nm(lat1, lon1, lat2, lon2) -> Column:
    return arc(half_chord(lat1, lon1, lat2, lon2), EARTH_NM)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return arc(half_chord(lat1, lon1, lat2, lon2), EARTH_KM)


def mod360(x: Column) -> Column:
    return x - 360.0 * F.floor(x / 360.0)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return mod360(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360.0)


def fold(a, b) -> Column:
    """The angle between two directions, 0 to 180."""
    d = F.abs(mod360(col(a)) - mod360(col(b)))
    return F.least(d, 360.0 - d)


def opposition(a, b) -> Column:
    """0 for equal directions, 1 for opposite ones."""
    return (1.0 - F.cos(F.radians(fold(a, b)))) / 2.0


def circular_mean(angle) -> Column:
    """An aggregate: the direction of the mean unit vector."""
    a = F.radians(col(angle))
    return mod360(F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))) + 360.0)


def clamp(x, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(float(low))), F.lit(float(high)))


def uv_from(speed, direction) -> tuple[Column, Column]:
    """Components of a wind that comes from `direction`."""
    a = F.radians(col(direction))
    return -col(speed) * F.sin(a), -col(speed) * F.cos(a)


def uv_toward(speed, direction) -> tuple[Column, Column]:
    a = F.radians(col(direction))
    return col(speed) * F.sin(a), col(speed) * F.cos(a)


def direction_from(u, v) -> Column:
    return mod360(F.degrees(F.atan2(-col(u), -col(v))) + 360.0)


def direction_toward(u, v) -> Column:
    return mod360(F.degrees(F.atan2(col(u), col(v))) + 360.0)


def rounded(x, digits: int = 6) -> Column:
    """Half up by floor, the same in every engine: what is a tie but for the last bits counts as one."""
    scale = float(10**digits)
    return F.floor(col(x) * scale + 0.50001) / scale
