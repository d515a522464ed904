"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere's radius in metres, and metres in a unit.
RADIUS = 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2.0 * RADIUS * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v)) / UNITS[unit]
