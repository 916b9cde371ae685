"""Distances and simulated road legs on coordinate columns, in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, DEGREE_KM, GRID_FACTOR = 6371.0, 111.32, 1.15


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def grid_km(lat1, lon1, lat2, lon2) -> Column:
    """Leg along a street grid, to 10 m."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    north = F.abs(lat2 - lat1) * DEGREE_KM
    east = F.abs(lon2 - lon1) * DEGREE_KM * F.cos(F.radians((lat1 + lat2) / 2))
    return F.round((north + east) * GRID_FACTOR, 2)


def grid_minutes(km) -> Column:
    """Three minutes a kilometre, two more for a leg that goes anywhere."""
    km = _col(km)
    return F.round(km * 3 + F.when(km != 0, 2).otherwise(0), 2)
