"""Geodesy as Column expressions: a local plane on WGS84, segments, and UTM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 semi-major axis and flattening, the UTM scale factor and false easting and northing.
A, FLATTENING, K0 = 6378137.0, 1 / 298.257223563, 0.9996
FALSE_EAST, FALSE_NORTH = 500_000, 10_000_000
E2 = FLATTENING * (2 - FLATTENING)
# Krueger's series in the third flattening n, up to n cubed (Karney 2011, equations 35 and 36, and the latitude series).
N3 = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N3) * (1 + N3**2 / 4 + N3**4 / 64)
ALPHA = (N3 / 2 - 2 * N3**2 / 3 + 5 * N3**3 / 16, 13 * N3**2 / 48 - 3 * N3**3 / 5, 61 * N3**3 / 240)
BETA = (N3 / 2 - 2 * N3**2 / 3 + 37 * N3**3 / 96, N3**2 / 48 + N3**3 / 15, 17 * N3**3 / 480)
DELTA = (2 * N3 - 2 * N3**2 / 3 - 2 * N3**3, 7 * N3**2 / 3 - 8 * N3**3 / 5, 56 * N3**3 / 15)


def frame_scale(lat: Column) -> tuple[Column, Column]:
    """Metres a radian, east and north, from the radii of curvature at a latitude."""
    s = F.sin(F.radians(lat))
    w = 1 - E2 * s * s
    return F.lit(A) / F.sqrt(w) * F.cos(F.radians(lat)), F.lit(A * (1 - E2)) / (w * F.sqrt(w))


def norm(x: Column, y: Column) -> Column:
    """The length of a vector by squares and a root: each of them is rounded once, in any engine, so equally far places tie in all of them."""
    return F.sqrt(x * x + y * y)


def to_local(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    east, north = frame_scale(lat0)
    return F.radians(lon - lon0) * east, F.radians(lat - lat0) * north


def to_geo(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    east, north = frame_scale(lat0)
    return lat0 + F.degrees(y / north), lon0 + F.degrees(x / east)


def distance_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, lat0: Column) -> Column:
    """Metres between two places on the local plane of a latitude."""
    east, north = frame_scale(lat0)
    return norm(F.radians(lon_b - lon_a) * east, F.radians(lat_b - lat_a) * north)


def project(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Unclamped distance along the segment a-b, and distance from its line (from a, if a = b)."""
    length = norm(bx - ax, by - ay)
    flat = length == 0
    along, off = project_on_unit(px - ax, py - ay, (bx - ax) / length, (by - ay) / length)
    return F.when(flat, 0.0).otherwise(along), F.when(flat, norm(px - ax, py - ay)).otherwise(off)


def project_on_unit(x: Column, y: Column, ux: Column, uy: Column) -> tuple[Column, Column]:
    """The same for a vector and the unit vector of a segment."""
    return x * ux + y * uy, F.abs(x * uy - y * ux)


def point_along(ax: Column, ay: Column, bx: Column, by: Column, along: Column) -> tuple[Column, Column]:
    """The place at a distance from a on the line a-b; a itself if a = b."""
    length = norm(bx - ax, by - ay)
    part = F.when(length == 0, 0.0).otherwise(along / length)
    return ax + (bx - ax) * part, ay + (by - ay) * part


def central_meridian(zone: Column) -> Column:
    return zone * 6 - 183


def utm_to_wgs84(easting: Column, northing: Column, zone: Column, south: Column, strict: bool = False) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of UTM coordinates; for what is no whole zone from 1 to 60 null or, if `strict`, an error."""
    xi = (northing - F.when(south, FALSE_NORTH).otherwise(0)) / (K0 * RADIUS)
    eta = (easting - FALSE_EAST) / (K0 * RADIUS)
    u = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BETA, 1))
    v = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BETA, 1))
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(DELTA, 1))
    fine = zone.between(1, 60) & (zone == F.floor(zone))
    if strict:
        fine = fine | F.raise_error(F.concat(F.lit("no UTM zone: "), F.coalesce(zone.cast("string"), F.lit("null")))).cast("boolean")
    return F.when(fine, F.degrees(lat)), F.when(fine, central_meridian(zone) + F.degrees(F.atan2(F.sinh(v), F.cos(u))))


def wgs84_to_utm(lat: Column, lon: Column, zone: Column | None = None) -> tuple[Column, Column, Column, Column]:
    """(easting, northing, zone, whether south); the zone follows the longitude if it is not given."""
    z = F.floor((lon + 180) / 6) + 1 if zone is None else zone
    south, turn = lat < 0, F.radians(lon - central_meridian(z))
    e = math.sqrt(E2)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    u, v = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    xi = u + sum(a * F.sin(2 * j * u) * F.cosh(2 * j * v) for j, a in enumerate(ALPHA, 1))
    eta = v + sum(a * F.cos(2 * j * u) * F.sinh(2 * j * v) for j, a in enumerate(ALPHA, 1))
    return K0 * RADIUS * eta + FALSE_EAST, K0 * RADIUS * xi + F.when(south, FALSE_NORTH).otherwise(0), z.cast("int"), south
