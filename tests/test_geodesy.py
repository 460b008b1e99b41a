from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from timbergrid.functions import geodesy
from timbergrid.operators import spatial
from timbergrid.sources import layers


def degrees(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


#: Published control points of a national manual on GRS80: zone 55, meridian 147, and the geodesic between them.
ZONE = geodesy.Projection(geodesy.GRS80, 147.0, north=10_000_000.0)
PEAK, BUNINYONG = (degrees(144, 25, 29.52440), degrees(-37, 57, 3.72030)), (degrees(143, 55, 35.38390), degrees(-37, 39, 10.15610))
GRID = {PEAK: (273741.297, 5796489.777), BUNINYONG: (228854.052, 5828259.038)}


def test_published_points_of_the_plane(spark):
    rows = spark.createDataFrame([(*k, *v) for k, v in GRID.items()], "lon double, lat double, x double, y double")
    (x, y), (lon, lat) = geodesy.to_plane(F.col("lon"), F.col("lat"), ZONE), geodesy.from_plane(F.col("x"), F.col("y"), ZONE)
    for r in rows.select("*", x.alias("px"), y.alias("py"), lon.alias("plon"), lat.alias("plat")).collect():
        assert (r.px, r.py) == pytest.approx((r.x, r.y), abs=1e-3)
        assert (r.plon, r.plat) == pytest.approx((r.lon, r.lat), abs=1.2e-8)  # the points are given to a millimetre


def test_published_geodesic(spark):
    row = spark.createDataFrame([(*PEAK, *BUNINYONG)], "a double, b double, c double, d double")
    got = row.select(geodesy.distance_m(*[F.col(c) for c in "abcd"], geodesy.GRS80)).first()[0]
    assert got == pytest.approx(54972.271, abs=1e-3)


def meridian(lat, e, steps=20_000):
    """Arc from the equator, by Simpson's rule."""
    e2 = e.f * (2 - e.f)
    g = lambda t: e.a * (1 - e2) / (1 - e2 * math.sin(t) ** 2) ** 1.5
    h = math.radians(lat) / steps
    return h / 3 * sum((1 if k in (0, steps) else 4 if k % 2 else 2) * g(k * h) for k in range(steps + 1))


def test_meridian_equator_and_equal_points(spark):
    cases = [(27.0, 0.0, 27.0, 62.5), (10.0, 0.0, 11.0, 0.0), (25.0, 61.0, 25.0, 61.0), (25.0, 61.0, None, 61.0)]
    rows = spark.createDataFrame(cases, "a double, b double, c double, d double")
    up, along, none, missing = [r[0] for r in rows.select(geodesy.distance_m(*[F.col(c) for c in "abcd"])).collect()]
    assert up == pytest.approx(meridian(62.5, geodesy.WGS84), abs=1e-3)
    assert along == pytest.approx(math.radians(1) * geodesy.WGS84.a, abs=1e-3)
    assert none == 0.0 and missing is None


def test_the_plane_and_back(spark):
    rows = spark.createDataFrame([(lon / 2, lat / 2) for lon in range(38, 65, 2) for lat in range(118, 142, 2)], "lon double, lat double")
    x, y = geodesy.to_plane(F.col("lon"), F.col("lat"))
    lon, lat = geodesy.from_plane(F.col("x"), F.col("y"))
    back = rows.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", "x", "y", lon.alias("lon2"), lat.alias("lat2")).collect()
    assert max(max(abs(r.lon - r.lon2), abs(r.lat - r.lat2)) for r in back) < 1e-9
    on = {r.lat: r for r in back if r.lon == 27.0}
    assert on[62.0].x == pytest.approx(500_000.0, abs=1e-6) and on[62.0].y == pytest.approx(0.9996 * meridian(62.0, geodesy.GRS80), abs=1e-3)


def test_stations_of_a_box(spark):
    at = "fmisid long, name string, lat double, lon double"
    stations = spark.createDataFrame([(1, "in", 62.0, 25.5), (2, "near", 62.6, 25.74), (2, "again", 62.6, 25.74), (3, "far", 65.0, 25.5), (4, "edge", 61.9, 24.5)], at)
    got = {r.fmisid: r.km for r in spatial.stations_near(stations, 25.0, 61.8, 26.0, 62.3).collect()}
    assert got.keys() == {1, 2, 4} and got[1] == 0.0
    assert got[2] == pytest.approx((meridian(62.6, geodesy.WGS84) - meridian(62.3, geodesy.WGS84)) / 1000, abs=1e-5)
    box = spatial.box_degrees(spark.createDataFrame([(400_000.0, 6_900_000.0, 450_000.0, 6_968_000.0)], "x_min double, y_min double, x_max double, y_max double")).first()
    assert box.west < box.east < 27.0 and 62.0 < box.south < box.north < 63.0


def test_no_protected_areas_at_all(spark):
    none = layers.protected_areas({"state": None, "private": None})
    pts = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    old = spark.createDataFrame([(130.0, 0.0, 0.0)], "meanage double, x double, y double")
    assert none.count() == 0 and layers.protected_areas({}).count() == 0
    assert {r.node_type for r in layers.nodes(none, pts, pts, old).collect()} == {"habitat_s10", "ymparistotuki", "old_stand"}
