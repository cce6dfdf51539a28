"""Distances and angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0
KM_PER_NM = 1.852


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """A quick distance in degrees of 111 km, without the narrowing of meridians."""
    return KM_PER_DEGREE * F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(lon2 - lon1, 2))


def turn_deg(a: Column, b: Column) -> Column:
    """The smaller angle between two courses."""
    d = F.abs(b - a) % 360
    return F.least(d, 360 - d)


def valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)
