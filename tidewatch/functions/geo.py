"""Distances and grid cells as Column expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius in km of the catalogue work and of the live feeds.
EARTH_KM = 6371.0088
LIVE_EARTH_KM = 6371.0

# Spacing in degrees of the weather grid.
WEATHER_LAT_STEP = 0.5
WEATHER_LON_STEP = 0.625


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance; the argument of asin is held at 1 against rounding."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def weather_cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Centre of the weather grid cell that holds a point (half to even, like the grid's own index)."""
    snap_lat = F.bround(F.rint(lat / WEATHER_LAT_STEP) * WEATHER_LAT_STEP, 3)
    snap_lon = F.bround(F.rint(lon / WEATHER_LON_STEP) * WEATHER_LON_STEP, 3)
    return snap_lat, snap_lon


def degree_cell(lat: Column, lon: Column, size: int = 5) -> Column:
    return F.concat_ws("_", F.floor(lat / size).cast("string"), F.floor(lon / size).cast("string"))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """A place as a point on the unit globe."""
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def chord_km(square: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance for a squared straight-line distance on the unit globe."""
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(square) / 2))


def sphere_axes(lat: Column, lon: Column, size_km: float) -> list[Column]:
    """Cell index along x, y, z of a cube grid laid through the globe.

    A chord is never longer than its arc, so two points within ``size_km`` of each other
    are at most one cell apart on each axis. Poles and the date line need no special case.
    """
    phi, lam = F.radians(lat), F.radians(lon)
    axes = (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    return [F.floor(axis * F.lit(EARTH_KM) / F.lit(size_km)).cast("long") for axis in axes]


def cell_key(*axes: Column) -> Column:
    return F.concat_ws(":", *[axis.cast("string") for axis in axes])


def neighbour_keys(axes: list[Column], head: str = "") -> Column:
    """Keys of the cell itself and of every cell that touches it, each after ``head``."""

    def key(i: Column) -> Column:
        parts = []
        for axis in axes:
            parts.append((axis + i % 3 - 1).cast("string"))
            i = F.floor(i / 3)
        return F.concat(F.lit(head), F.concat_ws(":", *parts))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(3 ** len(axes) - 1).cast("long")), key)


def square_degrees_to_km2(area: Column, lat: Column) -> Column:
    return area * (111.32 ** 2) * F.cos(F.radians(lat))


def degrees_for(km: float) -> float:
    """Padding in degrees of latitude that surely covers ``km``."""
    return km / 111.0 * 1.4


def lon_within(lon: Column, west: Column, east: Column) -> Column:
    """Inside a longitude range on a map that may be wrapped once in either direction."""
    return lon.between(west, east) | (lon + 360).between(west, east) | (lon - 360).between(west, east)


