"""Geometry and angles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.config import EARTH_RADIUS_M

#: Metres per degree of the planar projection that the interaction features use.
PLANAR_LAT_M, PLANAR_LON_M, MPS_PER_KNOT = 110_540.0, 111_320.0, 0.514444


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def local_x(lon: Column, lat0: Column, lon0: Column) -> Column:
    """Metres east of a reference point (equirectangular)."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_RADIUS_M


def local_y(lat: Column, lat0: Column) -> Column:
    return F.radians(lat - lat0) * EARTH_RADIUS_M


def local_lat(y: Column, lat0: Column) -> Column:
    return lat0 + F.degrees(y / EARTH_RADIUS_M)


def local_lon(x: Column, lat0: Column, lon0: Column) -> Column:
    return lon0 + F.degrees(x / (F.lit(EARTH_RADIUS_M) * F.cos(F.radians(lat0))))


def circular_interp(a: Column, b: Column, alpha: Column) -> Column:
    """Degrees between two bearings along the blend of their unit vectors; null if either is."""
    s = (1 - alpha) * F.sin(F.radians(a)) + alpha * F.sin(F.radians(b))
    c = (1 - alpha) * F.cos(F.radians(a)) + alpha * F.cos(F.radians(b))
    return F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0))


def guarded_interp(a: Column, b: Column, alpha: Column, most: float) -> Column:
    """Linear blend, null unless both are present and differ by at most `most`."""
    return F.when(F.abs(b - a) <= most, (1 - alpha) * a + alpha * b)


def wrap_degrees(a: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def turn_degrees(a: Column, b: Column) -> Column:
    return F.abs(wrap_degrees(b - a))


def half_even(v: Column, digits: int) -> Column:
    """Round half to even, as arrays of the released data are rounded."""
    return F.rint(v * 10.0**digits) / 10.0**digits


def planar_x(lon: Column, lat0: Column, lon0: Column) -> Column:
    return (lon - lon0) * PLANAR_LON_M * F.cos(F.radians(lat0))


def planar_y(lat: Column, lat0: Column) -> Column:
    return (lat - lat0) * PLANAR_LAT_M


def velocity(sog: Column, cog: Column) -> tuple[Column, Column]:
    """East and north speed in m/s; 0 where speed or course is missing."""
    known = sog.isNotNull() & cog.isNotNull()
    speed = sog * MPS_PER_KNOT
    return F.when(known, speed * F.sin(F.radians(cog))).otherwise(0.0), F.when(known, speed * F.cos(F.radians(cog))).otherwise(0.0)


def approach(x: Column, y: Column, vx: Column, vy: Column) -> tuple[Column, Column]:
    """Distance and time of the closest approach, negative if it is past; null for equal velocities."""
    v2 = vx * vx + vy * vy
    t = F.when(v2 > 1e-8, -(x * vx + y * vy) / v2)
    return F.sqrt(F.pow(x + t * vx, 2) + F.pow(y + t * vy, 2)), t


def point_segment_m(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of the origin from a segment."""
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    t = F.when(n <= 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x0 * dx + y0 * dy) / F.greatest(n, F.lit(1e-300)))))
    return F.hypot(x0 + t * dx, y0 + t * dy)


def clip_square(x0: Column, y0: Column, x1: Column, y1: Column, radius: float) -> tuple[Column, Column]:
    """Parameters at which a segment enters and leaves the square of half-side radius; enter > leave if it misses."""
    enter, leave = F.lit(0.0), F.lit(1.0)
    for p, d in ((x0, x1 - x0), (y0, y1 - y0)):
        safe = F.when(d == 0, F.lit(None)).otherwise(d)
        a, b = (-radius - p) / safe, (radius - p) / safe
        outside = (d == 0) & (F.abs(p) > radius)
        enter = F.greatest(enter, F.least(a, b), F.when(outside, 2.0))
        leave = F.least(leave, F.greatest(a, b), F.when(outside, -1.0))
    return enter, leave
