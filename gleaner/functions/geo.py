"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000
#: Side of a grid cell, in degrees.
CELL = 0.01


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def cell(degrees: Column) -> Column:
    return F.floor(degrees / CELL)
