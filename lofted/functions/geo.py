"""Geodesy and plane-vector functions on Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EARTH_RADIUS_M, KNOT_MS

METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; degrees in, null in null out."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def wrap360(degrees: Column) -> Column:
    """Degrees in [0, 360)."""
    return F.pmod(degrees, F.lit(360.0))


def wrap180(degrees: Column) -> Column:
    """Degrees in [-180, 180)."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    d, a, b = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    return wrap360(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))))


def destination(lat: Column, lon: Column, course: Column, metres: Column) -> tuple[Column, Column]:
    """Latitude and longitude reached on a course after so many metres."""
    a, t, d = F.radians(lat), F.radians(course), metres / EARTH_RADIUS_M
    b = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    step = F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(b))
    return F.degrees(b), wrap180(lon + F.degrees(step))


def metres_per_degree_lon(lat: Column) -> Column:
    return METRES_PER_DEGREE * F.cos(F.radians(lat))


def valid_point(lat: Column, lon: Column) -> Column:
    """Whether both are present and in range."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def wind_components(direction: Column, speed: Column) -> tuple[Column, Column]:
    """East and north components of a wind that blows from `direction`."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def wind_polar(east: Column, north: Column) -> tuple[Column, Column]:
    """Speed, and the direction that the wind comes from."""
    return F.hypot(east, north), wrap360(F.degrees(F.atan2(-east, -north)))


def knots(speed: Column) -> Column:
    return speed * KNOT_MS
