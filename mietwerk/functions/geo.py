"""Plane geometry over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a degree at the equator.
DEGREE = 111_320.0


def project(lat: Column, lon: Column, lat0: float) -> tuple[Column, Column]:
    """Metres east and north by an equirectangular projection."""
    return lon * DEGREE * F.cos(F.radians(F.lit(lat0))), lat * DEGREE


def usable(lat: Column, lon: Column) -> Column:
    """Whether both coordinates are in range and neither is missing, 0 or -1."""
    fine = lambda v, most: v.isNotNull() & (v != 0) & (v != -1) & (F.abs(v) <= most)
    return fine(lat, 90) & fine(lon, 180)


def cell(x: Column, y: Column, size: float) -> Column:
    return F.concat(F.floor(x / size), F.lit(":"), F.floor(y / size))


def inside(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies inside a ring of corners, by counting crossings; its edge lines count as crossed once."""
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        at = (y - y1) * ((x2 - x1) / (y2 - y1)) + x1
        crossed = crossed + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at), 1).otherwise(0)
    return crossed % 2 == 1
