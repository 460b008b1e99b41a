"""Geodesy as native expressions: the transverse Mercator projection both ways, and distances on the ellipsoid."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float


@dataclass(frozen=True)
class Projection:
    ellipsoid: Ellipsoid
    meridian: float
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0


#: The ellipsoids' axes and flattenings, and the national projection on GRS80.
GRS80 = Ellipsoid(6_378_137.0, 1 / 298.257222101)
WGS84 = Ellipsoid(6_378_137.0, 1 / 298.257223563)
TM35FIN = Projection(GRS80, 27.0)
#: Krueger's series to the fourth order of the third flattening n, a row for each multiple of the angle, its
#: factors of n, n^2, n^3 and n^4: to the plane, from the plane, and from conformal to geodetic latitude.
ALPHA = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
BETA = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
DELTA = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))


def _factors(series: tuple, n: float) -> list[float]:
    return [sum(c * n ** (k + 1) for k, c in enumerate(row)) for row in series]


def _constants(p: Projection) -> tuple[float, float, float]:
    """The third flattening, the first eccentricity, and the scaled radius of the rectifying sphere."""
    n = p.ellipsoid.f / (2 - p.ellipsoid.f)
    return n, 2 * math.sqrt(n) / (1 + n), p.scale * p.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


def to_plane(lon: Column, lat: Column, p: Projection = TM35FIN) -> tuple[Column, Column]:
    """(x, y) in metres of longitude and latitude in degrees."""
    n, e, radius = _constants(p)
    turn, up = F.radians(lon - p.meridian), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(up) - e * F.atanh(e * up))
    xi, eta = F.atan2(t, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(t * t + F.cos(turn) * F.cos(turn)))
    north, east = xi, eta
    for j, a in enumerate(_factors(ALPHA, n), 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return p.east + radius * east, p.north + radius * north


def from_plane(x: Column, y: Column, p: Projection = TM35FIN) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees of a point of the plane."""
    n, _, radius = _constants(p)
    north, east = (y - p.north) / radius, (x - p.east) / radius
    xi, eta = north, east
    for j, b in enumerate(_factors(BETA, n), 1):
        xi = xi - b * F.sin(2 * j * north) * F.cosh(2 * j * east)
        eta = eta - b * F.cos(2 * j * north) * F.sinh(2 * j * east)
    conformal = F.asin(F.sin(xi) / F.cosh(eta))
    lat = conformal
    for j, d in enumerate(_factors(DELTA, n), 1):
        lat = lat + d * F.sin(2 * j * conformal)
    return p.meridian + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, ellipsoid: Ellipsoid = WGS84, rounds: int = 20) -> Column:
    """Length of the geodesic between two points, by iteration of the longitude on the auxiliary sphere.

    0 for equal points. Points that are nearly opposite don't come to rest within the rounds; no station is that far.
    """
    f, a = ellipsoid.f, ellipsoid.a
    b = a * (1 - f)
    reduced = lambda lat: F.atan((1 - f) * F.tan(F.radians(lat)))
    turn = F.radians(lon2 - lon1)
    ends = F.struct(F.sin(reduced(lat1)).alias("s1"), F.cos(reduced(lat1)).alias("c1"), F.sin(reduced(lat2)).alias("s2"), F.cos(reduced(lat2)).alias("c2"), turn.alias("turn"))
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def arc(u: Column, lam: Column) -> Column:
        cross, across = u["c2"] * F.sin(lam), u["c1"] * u["s2"] - u["s1"] * u["c2"] * F.cos(lam)
        return F.struct(F.sqrt(cross * cross + across * across).alias("sin"), (u["s1"] * u["s2"] + u["c1"] * u["c2"] * F.cos(lam)).alias("cos"), lam.alias("lam"))

    def angles(u: Column, s: Column) -> Column:
        azimuth = F.when(s["sin"] == 0, 0.0).otherwise(u["c1"] * u["c2"] * F.sin(s["lam"]) / s["sin"])
        flat = 1 - azimuth * azimuth
        middle = F.when(flat <= 1e-15, 0.0).otherwise(s["cos"] - 2 * u["s1"] * u["s2"] / flat)
        return F.struct(azimuth.alias("azimuth"), flat.alias("flat"), middle.alias("middle"), F.atan2(s["sin"], s["cos"]).alias("sigma"), s["sin"].alias("sin"), s["cos"].alias("cos"))

    solved = lambda u, lam: once(arc(u, lam), lambda s: angles(u, s))

    def turned(u: Column, g: Column) -> Column:
        c = f / 16 * g["flat"] * (4 + f * (4 - 3 * g["flat"]))
        return u["turn"] + (1 - c) * f * g["azimuth"] * (g["sigma"] + c * g["sin"] * (g["middle"] + c * g["cos"] * (2 * g["middle"] * g["middle"] - 1)))

    def length(g: Column) -> Column:
        u2 = g["flat"] * ((a * a - b * b) / (b * b))
        big = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
        small = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
        m, square = g["middle"], g["middle"] * g["middle"]
        shift = small * g["sin"] * (m + small / 4 * (g["cos"] * (2 * square - 1) - small / 6 * m * (4 * g["sin"] * g["sin"] - 3) * (4 * square - 3)))
        return b * big * (g["sigma"] - shift)

    def whole(u: Column) -> Column:
        lam = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), u["turn"], lambda x, _: once(solved(u, x), lambda g: turned(u, g)))
        return once(once(lam, lambda x: solved(u, x)), length)

    return once(ends, whole)
