"""Distances and directions on the sphere, as column expressions in degrees and metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import Num, _c

EARTH = 6371000.0


def haversine(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    s, t = F.sin(F.radians(lat2 - lat1) / 2.0), F.sin(F.radians(lon2 - lon1) / 2.0)
    a = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t
    return EARTH * 2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def bearing(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Initial bearing, 0 to 360."""
    p, q, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    y, x = F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def destination(lat: Num, lon: Num, towards: Num, metres: Num = 35.0) -> tuple[Column, Column]:
    """Where a way of so many metres at an initial bearing ends."""
    p, q, b, d = F.radians(_c(lat)), F.radians(_c(lon)), F.radians(_c(towards)), _c(metres) / EARTH
    end = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    return F.degrees(end), F.degrees(q + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(end)))


def planar(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Distance in degrees on the plane."""
    return F.hypot(_c(lat2) - _c(lat1), _c(lon2) - _c(lon1))


def on_earth(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
