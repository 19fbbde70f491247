"""Distances and grid cells as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Metres in a degree of latitude.
DEGREE_M = EARTH_M * 3.141592653589793 / 180


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def half_up(x: Column, places: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x * 10.0**places + 0.5) / 10.0**places if places else F.floor(x + 0.5)


def grid(radius_m: float) -> tuple[float, int]:
    """(cell size in degrees, columns around the globe) for neighbours within ``radius_m``: cells are twice as wide, so most points touch four to six."""
    columns = max(1, int(180 * DEGREE_M / (radius_m * 1.001)))
    return 360.0 / columns, columns


#: Rows of cells that reach beyond this latitude have one column: all meridians meet there.
POLAR_DEG = 89.9


def _column(y: Column, x: Column, size: float) -> Column:
    return F.when(F.greatest(F.abs(y), F.abs(y + 1)) * size > POLAR_DEG, F.lit(0).cast("long")).otherwise(x)


def cell(lat: Column, lng: Column, radius_m: float) -> Column:
    """The grid cell of a point; columns wrap at the antimeridian."""
    size, columns = grid(radius_m)
    y = F.floor(lat / size)
    return F.struct(y.alias("y"), _column(y, F.pmod(F.floor((lng + 180) / size), F.lit(columns)), size).alias("x"))


def cells_near(lat: Column, lng: Column, radius_m: float) -> Column:
    """All cells that can hold a point within ``radius_m``: the rows and columns that the box around the circle touches."""
    size, columns = grid(radius_m)
    # with room for rounding; no two points are further apart than 180 degrees
    reach = min(180.0, radius_m * 1.001 / DEGREE_M)
    narrow = F.cos(F.radians(F.least(F.abs(lat) + reach, F.lit(89.95))))
    across = 1.001 * F.degrees(2 * F.asin(F.least(F.lit(1.0), math.sin(math.radians(reach / 2)) / narrow)))
    span = lambda at, by: F.sequence(F.floor((at - by) / size), F.floor((at + by) / size))
    wide = F.array_distinct(F.transform(span(lng + 180, across), lambda c: F.pmod(c, F.lit(columns))))
    rows = F.transform(span(lat, F.lit(reach)), lambda y: F.transform(wide, lambda c: F.struct(y.alias("y"), _column(y, c, size).alias("x"))))
    return F.array_distinct(F.flatten(rows))


def in_box(lat: Column, lng: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Inclusive containment."""
    return lat.between(south, north) & lng.between(west, east)


def crosses(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Whether an edge crosses the ray from a point towards larger longitudes."""
    spans = (lat1 > lat) != (lat2 > lat)
    return spans & (lng < (lng2 - lng1) * (lat - lat1) / F.when(lat2 != lat1, lat2 - lat1) + lng1)
