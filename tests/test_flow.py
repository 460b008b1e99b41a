from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from timbergrid.operators import hydrology

AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def table(spark, z):
    return spark.createDataFrame([(*k, float(v)) for k, v in z.items()] or [], "row int, col int, z double")


def hills(seed, rows=22, cols=17, holes=0.02):
    rng = random.Random(seed)
    return {(r, c): rng.randrange(25) + 0.5 * r for r in range(rows) for c in range(cols) if rng.random() > holes}


def pits(z):
    return {k for k, v in z.items() if all((k[0] + a, k[1] + b) in z and z[k[0] + a, k[1] + b] >= v for a, b in AROUND)}


def ways(z, pit, reach):
    """Least cost to every cell within the reach, by rounds over all cells; ends count, and nothing beyond them."""
    rim = {k for k in z if any((k[0] + a, k[1] + b) not in z for a, b in AROUND)}
    end = {k for k in z if k != pit and (z[k] < z[pit] or k in rim)}
    near = {k for k in z if abs(k[0] - pit[0]) <= reach and abs(k[1] - pit[1]) <= reach}
    cost, moved = {pit: 0.0}, True
    while moved:
        moved = False
        for k in [k for k in cost if k not in end]:
            for a, b in AROUND:
                x = (k[0] + a, k[1] + b)
                if x in near and (n := cost[k] + max(0.0, z[x] - z[pit]) * math.hypot(a, b)) < cost.get(x, math.inf) - 1e-12:
                    cost[x], moved = n, True
    return min((cost[k] for k in end if k in cost), default=None)


@pytest.mark.parametrize("reach", [1, 4])
def test_breaching(spark, reach):
    z = hills(3)
    dem = table(spark, z)
    got = {(r.row, r.col): r.z for r in hydrology.breached(dem, reach, tile=7).collect()}
    assert got == {(r.row, r.col): r.z for r in hydrology.breached(dem, reach, tile=64).collect()}
    assert got.keys() == z.keys() and all(got[k] <= z[k] for k in z)
    open_, least = pits(z), {p: ways(z, p, reach) for p in pits(z)}
    assert len(open_) > 10 and any(v is not None for v in least.values())
    # What has a way drains, what has none stays as it was, and no cell becomes a pit.
    assert pits(got) == {p for p, v in least.items() if v is None and all(got[p[0] + a, p[1] + b] >= z[p] for a, b in AROUND)}
    assert hydrology.breached(dem.limit(0), reach).count() == 0


def test_the_way_out_is_the_cheapest():
    import numpy as np

    z = hills(5, holes=0.0)
    heights = np.full((26, 21), np.nan)
    for (r, c), v in z.items():
        heights[r + 2, c + 2] = v
    for p in pits(z):
        found, want = hydrology._way_out(heights, p[0] + 2, p[1] + 2, 3), ways(z, p, 3)
        if want is None:
            assert found is None
            continue
        way = [(i - 2, j - 2) for i, j in found[0]]
        assert way[0] == p and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(way, way[1:]))
        assert sum(max(0.0, z[b] - z[p]) * math.dist(a, b) for a, b in zip(way, way[1:])) == pytest.approx(want)


def brute_shares(z):
    """Receivers and shares by the planes of the eight facets."""
    out = {}
    for k, v in z.items():
        best = (0.0, None)
        for direct, diagonal in hydrology.FACETS:
            a, b = (k[0] + direct[0], k[1] + direct[1]), (k[0] + diagonal[0], k[1] + diagonal[1])
            if a in z and b in z:
                s1, s2 = v - z[a], z[a] - z[b]
                angle, slope = math.atan2(s2, s1), math.hypot(s1, s2)
                if angle < 0:
                    angle, slope = 0.0, s1
                elif angle > math.pi / 4:
                    angle, slope = math.pi / 4, (v - z[b]) / math.sqrt(2)
                if slope > best[0] + 1e-12:
                    p = angle / (math.pi / 4)
                    best = (slope, [(a, 1 - p), (b, p)])
        out[k] = [(x, p) for x, p in best[1] or [] if p > 0]
    return out


@pytest.mark.parametrize("tile", [5, 256])
def test_shared_flow(spark, tile):
    rng = random.Random(8)
    z = {(r, c): 3.0 * r + 2.0 * abs(c - 9) + rng.random() for r in range(31) for c in range(19) if rng.random() > 0.01}
    to, want = brute_shares(z), {}
    for k in sorted(z, key=z.get, reverse=True):
        want[k] = want.get(k, 0.0) + 1.0
        for x, p in to[k]:
            want[x] = want.get(x, 0.0) + p * want[k]
    flow = hydrology.d_infinity(table(spark, z))
    got = {(r.row, r.col): r.accum_cells for r in hydrology.shared_accumulation(flow, tile).collect()}
    assert got == pytest.approx(want) and max(got.values()) > 30
    assert hydrology.shared_accumulation(flow.limit(0), tile).count() == 0


def test_a_plane_shares_by_its_angle(spark):
    turn = math.radians(20)
    z = {(r, c): 100 - c * math.cos(turn) + r * math.sin(turn) for r in range(5) for c in range(5)}  # falls east, and a little north
    cell = {(r.row, r.col): r for r in hydrology.d_infinity(table(spark, z)).collect()}[2, 2]
    assert (cell.p1, cell.p2) == pytest.approx((1 - 20 / 45, 20 / 45))
    assert hydrology._AROUND[cell.k1] == (0, 1) and hydrology._AROUND[cell.k2] == (-1, 1)


def test_channel_links(spark):
    #  two heads meet at (2, 2), go on to (5, 2), where a third joins; a cell alone isn't a segment
    to = {(0, 0): (1, 1), (1, 1): (2, 2), (0, 4): (1, 3), (1, 3): (2, 2), (2, 2): (3, 2), (3, 2): (4, 2), (4, 2): (5, 2), (5, 0): (5, 1), (5, 1): (5, 2), (5, 2): (6, 3), (6, 3): None, (9, 9): None}
    flow = spark.createDataFrame([(*k, *(v or (None, None))) for k, v in to.items()], "row int, col int, to_row int, to_col int")
    accum = spark.createDataFrame([(*k, 100) for k in to], "row int, col int, accum_cells long")
    links = hydrology.channel_links(accum, flow, 0.01, 10.0)
    lines = {tuple(r.line[0]): (round(r.length_m, 3), [tuple(v) for v in r.line]) for r in hydrology.channel_lines(links).collect()}
    wide = 10 * 2**0.5
    assert lines == {
        (0, 0): (round(2 * wide, 3), [(0, 0), (1, 1), (2, 2)]),
        (0, 4): (round(2 * wide, 3), [(0, 4), (1, 3), (2, 2)]),
        (2, 2): (30.0, [(2, 2), (3, 2), (4, 2), (5, 2)]),
        (5, 0): (20.0, [(5, 0), (5, 1), (5, 2)]),
        (5, 2): (round(wide, 3), [(5, 2), (6, 3)]),
    }
    assert links.where("step_m is null").count() == 2
    report = hydrology.channel_report(accum, flow, [0.01, 99.0], 10.0).collect()
    assert [(r.threshold_ha, r.n_segments, round(r.length_m, 3)) for r in report] == [(0.01, 5, round(50 + 5 * wide, 3)), (99.0, 0, 0.0)]
    long = spark.createDataFrame([(0, c, 0 if c < 299 else None, c + 1 if c < 299 else None) for c in range(300)], "row int, col int, to_row int, to_col int")
    ranks = hydrology.channel_links(long.select("row", "col", F.lit(9).alias("accum_cells")), long, 0.0, 1.0)
    assert {(r.col, r.rank, r.link) for r in ranks.collect()} == {(c, c, 0) for c in range(300)}


@pytest.mark.parametrize("routing", ["d8", "dinf"])
def test_depth_to_water_from_an_opened_surface(spark, routing):
    z = {(r, c): 2.0 * abs(c - 4) + (30 - r) * 1.0 for r in range(20) for c in range(9)}
    z[8, 4] -= 6.0
    got = {(r.row, r.col): r.dtw for r in hydrology.depth_to_water(table(spark, z), [0.3], 10.0, breach_m=60.0, routing=routing).collect()}
    assert got.keys() == z.keys() and got[19, 4] == 0.0 and got[15, 6] > 0 and min(v for v in got.values() if v is not None) >= 0.0


def test_equal_slopes_of_unequal_bits_are_a_tie(spark):
    #  down to the north-east by 10 / sqrt(2), down to the south-west by sqrt(5 * 5 + 5 * 5): the first facet counts
    z = {(r, c): 20.0 for r in range(3) for c in range(3)} | {(0, 2): 10.0, (0, 1): 19.0, (1, 2): 19.0, (2, 0): 10.0, (1, 0): 15.0, (2, 1): 19.0}
    cell = {(r.row, r.col): r for r in hydrology.d_infinity(table(spark, z)).collect()}[1, 1]
    assert (hydrology._AROUND[cell.k1], hydrology._AROUND[cell.k2], cell.p2) == ((0, 1), (-1, 1), 1.0)


def test_cells_are_not_sent_through_the_driver(spark, monkeypatch):
    """Every join of the grid's cells is a shuffled one, however small its tables are on disk."""
    plans, own = [], hydrology.cut

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df)

    monkeypatch.setattr(hydrology, "cut", told)
    dem = spark.createDataFrame([(r, c, float((r * 7 + c * 13) % 11 + r)) for r in range(12) for c in range(12)], "row int, col int, z double")
    out = hydrology.depth_to_water(dem, [0.1], 16.0, breach_m=64.0)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 144 and any("Join" in x for x in plans)
    assert not [x for x in plans if "BroadcastExchange" in x]
