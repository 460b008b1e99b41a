from __future__ import annotations

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from timbergrid.operators import checkpoints, hydrology, network, raster, spatial, stats, tiles
from timbergrid.operators.spatial import Grid

SEG = "id int, x1 double, y1 double, x2 double, y2 double"


def square(i, x, y, a):
    p = [(x, y), (x + a, y), (x + a, y + a), (x, y + a)]
    return [(i, *map(float, p[k]), *map(float, p[(k + 1) % 4])) for k in range(4)]


def test_nearest_polygons(spark):
    habitat = spark.createDataFrame(square(7, 0, 0, 10), SEG)
    near = [*square(1, 15, 0, 10), *square(2, 25, 0, 10), *square(3, 35, 0, 10), *square(4, 5000, 0, 10)]
    got = {r.id: math.sqrt(r.d2) for r in spatial.nearest(spark.createDataFrame(near, SEG), habitat).collect()}
    assert got == {1: 5.0, 2: 15.0, 3: 25.0, 4: 4990.0}
    assert [(r.id, r.other, r.d2) for r in spatial.nearest(habitat, habitat.limit(0)).collect()] == [(7, None, None)]  # one row for each left feature


def test_setback(spark):
    line = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0)], SEG)
    pts = spark.createDataFrame([(1, 50.0, 5.0, 50.0, 5.0), (2, 50.0, 50.0, 50.0, 50.0)], SEG)
    assert [r.id for r in spatial.too_close(pts, line, 10.0).collect()] == [1]


def test_setback_makes_no_pairs(spark, monkeypatch):
    """Features that all are within the setback of each other aren't paired; a place of many features is one."""
    written, own = [], spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df: written.append(own(df)) or written[-1])
    rng = random.Random(4)
    left = [(k, *2 * (float(rng.randrange(900)), float(rng.randrange(900)))) for k in range(300)] + [(300, None, 1.0, None, 1.0)]
    right = [(k, *2 * (float(rng.randrange(300)), 0.0)) for k in range(200)] + [(k, *2 * (5.0, 5.0)) for k in range(200, 400)]
    want = {a[0] for a in left[:300] if any((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 400**2 for b in right)}
    got = [r.id for r in spatial.too_close(spark.createDataFrame(left, SEG), spark.createDataFrame(right, SEG), 400.0).collect()]
    assert sorted(got) == sorted(want) and 50 < len(got) < 290
    pairs = [t for t in written if {"id", "other"} <= set(t.columns)]
    assert pairs and sum(t.count() for t in pairs) < 20 * 300


def test_burn_matches_point_in_polygon(spark):
    grid = Grid(0.0, 200.0, 10.0, 20, 20)
    ring = [(12, 15), (150, 35), (95, 95), (170, 180), (40, 150), (60, 80)]
    edges = [(1, *map(float, ring[i]), *map(float, ring[(i + 1) % 6])) for i in range(6)] + square(2, 35, 35, 50)
    got = {(r.id, r.row, r.col) for r in spatial.burned(spark.createDataFrame(edges, SEG), grid).collect()}

    def inside(i, x, y):
        own = [e[1:] for e in edges if e[0] == i]
        return sum((a[1] > y) != (a[3] > y) and x < a[0] + (y - a[1]) * (a[2] - a[0]) / (a[3] - a[1]) for a in own) % 2 == 1

    assert got == {(i, r, c) for i in (1, 2) for r in range(20) for c in range(20) if inside(i, 10 * c + 5, 200 - 10 * r - 5)}
    last = spatial.burn_last(spark.createDataFrame(edges, SEG), grid, spark.createDataFrame([(1, 5.0), (2, None)], "id int, value double"))
    assert {r.value for r in last.collect()} == {5.0}
    made = {r.id: (r.area, r.cx, r.cy) for r in spatial.measures(spark.createDataFrame(square(2, 35, 35, 50), SEG)).collect()}
    assert made[2] == pytest.approx((2500, 60, 60))


def test_touched_cells(spark):
    grid = Grid(0.0, 100.0, 10.0, 10, 10)
    got = spatial.touched(spark.createDataFrame([(1, 25.0, 0.5, 25.0, 99.5), (2, 5.0, 95.0, 95.0, 95.0)], SEG), grid)
    assert {(r.row, r.col) for r in got.collect()} == {(r, 2) for r in range(10)} | {(0, c) for c in range(10)}


def test_buffers_of_two_lines(spark):
    grid = Grid(0.0, 100.0, 10.0, 10, 10)
    cells = lambda c: spark.createDataFrame([(r, c) for r in range(10)], "row int, col int")
    got = {r.width: (r.derived_ha, r.additional_ha) for r in raster.buffer_report(cells(2), cells(7), grid, (10, 20, 30)).collect()}
    assert got == {10.0: (0.3, 0.3), 20.0: (0.5, 0.5), 30.0: (0.6, 0.4)}


def test_distances(spark):
    rng, grid = random.Random(5), Grid(0.0, 130.0, 10.0, 13, 17)
    feats = [(rng.randrange(13), rng.randrange(17)) for _ in range(6)]
    frame = spark.createDataFrame(feats, "row int, col int")
    want = {(r, c): min((r - a) ** 2 + (c - b) ** 2 for a, b in feats) for r in range(13) for c in range(17)}
    assert {(r.row, r.col): r.d2 for r in raster.distance_everywhere(frame, grid).collect()} == want
    near = {(r.row, r.col): r.d2 for r in raster.distance_within(frame, 2.5, 13, 17).collect()}
    assert near == {k: v for k, v in want.items() if v <= 6.25}
    assert raster.distance_everywhere(frame.limit(0), grid).count() == 0


def test_slope_of_a_ramp_and_block_means(spark):
    dem = spark.createDataFrame([(r, c, float(c)) for r in range(4) for c in range(4)], "row int, col int, z double")
    assert {round(r.slope_deg, 2) for r in raster.slope_degrees(dem, 10.0).collect()} == {5.71}
    assert sorted(r.z for r in raster.resample(dem, 2.0, 4.0, "z").collect()) == [0.5, 0.5, 2.5, 2.5]
    with pytest.raises(ValueError):
        raster.resample(dem, 2.0, 1.0, "z")


def test_stream_mask(spark):
    rows = [(0, 1, -32768.0), (0, 2, 1.0), (0, 3, 0.0), (0, 4, None), (0, 5, float("nan"))]
    assert [r.col for r in raster.stream_cells(spark.createDataFrame(rows, "row int, col int, stream double")).collect()] == [2]


def test_sampling_modes(spark):
    grid = Grid(0.0, 10.0, 10.0, 1, 3)
    cells = spark.createDataFrame([(0, c, float(c)) for c in range(3)], "row int, col int, v double")
    pts = spark.createDataFrame([(1, 15.0, 5.0), (2, 99.0, 5.0)], "id int, x double, y double")
    assert {r.id: r.v for r in spatial.sampled(pts, cells, grid, ["v"]).collect()} == {1: 1.0, 2: None}
    assert {r.id: r.v for r in spatial.sampled(pts, cells, grid, ["v"], index_mode="round").collect()} == {1: 2.0, 2: None}


def test_alignment(spark):
    source = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(2) for c in range(2)], "row int, col int, v double")
    got = raster.aligned(source, Grid(0.0, 20.0, 10.0, 2, 2), Grid(0.0, 20.0, 5.0, 4, 5), "v").collect()
    assert {(r.row, r.col): r.v for r in got} == {(r, c): (10 * (r // 2) + c // 2 if c < 4 else 0.0) for r in range(4) for c in range(5)}


def test_ranks_and_comparison(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(20)), None if i % 9 == 0 else float(rng.randrange(15))) for i in range(300)]
    frame = spark.createDataFrame(rows, "a double, b double")
    pdf = frame.toPandas().dropna()
    got = stats.spearman(frame, "a", "b").first()
    assert got.n == len(pdf) and got.spearman == pytest.approx(pdf["a"].rank().corr(pdf["b"].rank()))
    same = stats.compared(frame.withColumn("c", F.col("a") + 2), "c", "a").first()
    assert (same.bias, same.rmse, round(same.spearman, 9)) == (2.0, 2.0, 1.0)


def brute_costs(cost, seeds):
    best = {s: 0.0 for s in seeds}
    heap = [(0.0, s) for s in seeds]
    while heap:
        d, (r, c) = heapq.heappop(heap)
        if d > best[r, c]:
            continue
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                v = (r + a, c + b)
                if (a or b) and v in cost and (n := d + (cost[r, c] + cost[v]) / 2 * math.hypot(a, b)) < best.get(v, math.inf):
                    best[v] = n
                    heapq.heappush(heap, (n, v))
    return best


def test_least_cost_both_ways(spark):
    rng = random.Random(4)
    cost = {(r, c): rng.choice([1.0, 5.0, 50.0]) for r in range(9) for c in range(8) if rng.random() > 0.1}
    seeds = {1: [k for k in cost if k[0] < 2][:3], 2: [k for k in cost if k[0] > 6][:3]}
    grid = spark.createDataFrame([(0, *k, v) for k, v in cost.items()], "run int, row int, col int, cost double")
    patches = spark.createDataFrame([(0, p, *k) for p, ks in seeds.items() for k in ks], "run int, patch_id long, row int, col int")
    want = {(p, *k): v for p, ks in seeds.items() for k, v in brute_costs(cost, ks).items()}
    for fields in (network.cost_fields(patches, grid), network.cost_fields(patches, grid, tile=4)):
        assert {(r.patch_id, r.row, r.col): r.cost for r in fields.collect()} == pytest.approx(want)
    pair = network.pair_costs(network.cost_fields(patches, grid), patches).collect()
    assert [(r.i, r.j, r.cost) for r in pair] == [(1, 2, pytest.approx(min(want[1, *k] for k in seeds[2])))]


def test_connectivity_of_three_patches(spark):
    edges = spark.createDataFrame([(0, 0, 1, 5.0), (0, 1, 2, 5.0), (0, 0, 2, 100.0)], "run int, i long, j long, cost double")
    nodes = spark.createDataFrame([(0, k, 2.0, 10.0) for k in range(3)], "run int, patch_id long, area_ha double, dispersal double")
    p = network.max_product(edges, nodes)
    told = {(r.i, r.j): r.p for r in p.collect()}
    assert told[0, 2] == pytest.approx(math.exp(-1)) and told[1, 1] == 1.0
    total = 4 * sum(told.values())
    for r in network.connectivity(p, nodes).collect():
        rest = 4 * sum(v for (i, j), v in told.items() if r.patch_id not in (i, j))
        assert (r.dpc, r.pc) == pytest.approx((100 * (total - rest) / total, total / 36))
    assert {(r.i, r.j) for r in network.backbone(edges, 1).collect()} == {(0, 1), (1, 2)}


def test_components_and_patches(spark):
    cells = [(0, c) for c in range(12)] + [(5, 5), (6, 6), (9, 1)]
    frame = spark.createDataFrame(cells, "row int, col int")
    assert network.components(frame).select("component").distinct().count() == 3
    assert network.components(frame, diagonal=False).select("component").distinct().count() == 4
    gap = spark.createDataFrame([(0, 0), (0, 1), (0, 3), (0, 4), (8, 8)], "row int, col int")
    got = network.patches(gap, 1.5, 1.0, 2.0).collect()
    assert {r.patch_id for r in got} == {0} and {r.area_ha for r in got} == {5.0}


def test_sweep_runs_as_one_plan(spark):
    from timbergrid.plans.config import Resistance, Sweep, perturbed

    cells = spark.createDataFrame([(r, c, 24, 50.0, 10.0, 0.5) for r in range(8) for c in range(12)], "row int, col int, clc int, meanage double, basalarea double, proportionother double")
    patch = spark.createDataFrame([(r, c, p, 2.0) for p, c in ((1, 0), (2, 6), (3, 11)) for r in (3, 4)], "row int, col int, patch_id long, area_ha double")
    labels = cells.select("row", "col", F.floor(F.col("row") / 2).cast("long").alias("label"))
    got = network.sweep(cells, patch, labels, perturbed(Resistance(coarsen=1), Sweep(n_runs=2)), 8, 12)
    assert {r.label for r in got["robust"].collect()} == {0, 1, 2, 3}
    assert {r.run for r in got["connectivity"].collect()} == {0, 1}
    assert got["robust"].agg(F.max("mean_score")).first()[0] > 0


def test_flow_over_a_valley(spark):
    # A valley along column 3 that falls southwards, with a pit in it.
    z = {(r, c): 2.0 * abs(c - 3) + (20 - r) * 1.0 for r in range(12) for c in range(7)}
    z[5, 3] -= 5.0
    dem = spark.createDataFrame([(*k, v) for k, v in z.items()], "row int, col int, z double")
    surface = hydrology.filled(dem)
    assert {(r.row, r.col) for r in surface.join(dem.withColumnRenamed("z", "was"), ["row", "col"]).where("z > was").collect()} >= {(5, 3)}
    flow = hydrology.d8(surface)
    accum = {(r.row, r.col): r.accum_cells for r in hydrology.accumulation(flow).collect()}
    to = {(r.row, r.col): (r.to_row, r.to_col) for r in flow.collect()}
    want = dict.fromkeys(to, 0)
    for start in to:
        k = start
        while k[0] is not None:
            want[k] += 1
            k = to[k]
    assert accum == want and max(accum.values()) > 60
    dtw = {(r.row, r.col): r.dtw for r in hydrology.height_above_stream(dem, flow, spark.createDataFrame([(11, 3)], "row int, col int")).collect()}
    assert dtw[11, 3] == 0.0 and dtw[6, 3] == pytest.approx(5.0)


def _ring(i, x0, y0, x1, y1):
    at = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return [(i, *map(float, a), *map(float, b)) for a, b in zip(at, at[1:] + at[:1], strict=True)]


def test_nearest_of_nested_and_apart_polygons(spark):
    schema = "id long, x1 double, y1 double, x2 double, y2 double"
    left = spark.createDataFrame(_ring(1, 40, 40, 60, 60) + _ring(2, 110, 0, 120, 10) + _ring(3, 300, 300, 400, 400) + _ring(4, 95, 95, 105, 105), schema)
    right = spark.createDataFrame(_ring(7, 0, 0, 100, 100) + _ring(8, 340, 340, 350, 350), schema)
    got = {r.id: (r.other, r.d2) for r in spatial.nearest(left, right, polygons=True).collect()}
    assert got == {1: (7, 0.0), 2: (7, 100.0), 3: (8, 0.0), 4: (7, 0.0)}
    hole = spark.createDataFrame(_ring(7, 0, 0, 100, 100) + _ring(7, 30, 30, 70, 70), schema)
    assert {r.id: r.d2 for r in spatial.nearest(left.where("id = 1"), hole, polygons=True).collect()} == {1: 100.0}
    nothing = spatial.nearest(left, right.limit(0), polygons=True).collect()
    assert sorted(r.id for r in nothing) == [1, 2, 3, 4] and not any(r.other for r in nothing)


def brute_fill(z, rise=1e-4):
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    best = {k: v for k, v in z.items() if any((k[0] + a, k[1] + b) not in z for a, b in around)}
    heap = [(v, k) for k, v in best.items()]
    heapq.heapify(heap)
    while heap:
        d, (r, c) = heapq.heappop(heap)
        for a, b in around:
            k = (r + a, c + b)
            if d == best[r, c] and k in z and (n := max(z[k], d + rise)) < best.get(k, math.inf):
                best[k] = n
                heapq.heappush(heap, (n, k))
    return best


@pytest.mark.parametrize("tile", [4, 256])
def test_filled_in_tiles(spark, tile):
    rng = random.Random(11)
    z = {(r, c): float(rng.randrange(30)) for r in range(23) for c in range(18) if rng.random() > 0.01}
    dem = spark.createDataFrame([(*k, v) for k, v in z.items()], "row int, col int, z double")
    assert {(r.row, r.col): r.z for r in hydrology.filled(dem, tile=tile).collect()} == brute_fill(z)
    assert hydrology.filled(dem.limit(0), tile=tile).count() == 0


def test_least_cost_in_small_tiles(spark):
    rng = random.Random(6)
    cost = {(r, c): rng.choice([1.0, 5.0, 50.0]) for r in range(14) for c in range(11) if rng.random() > 0.2}
    seeds = {1: [(r, c) for r, c in cost if r < 1], 9: [(r, c) for r, c in cost if r > 12 and c < 4]}
    grid = spark.createDataFrame([(run, *k, v + run) for k, v in cost.items() for run in (0, 1)], "run int, row int, col int, cost double")
    patches = spark.createDataFrame([(run, p, *k) for p, ks in seeds.items() for k in ks for run in (0, 1)], "run int, patch_id long, row int, col int")
    want = {(run, p, *k): v for run in (0, 1) for p, ks in seeds.items() for k, v in brute_costs({k: v + run for k, v in cost.items()}, ks).items()}
    got = {(r.run, r.patch_id, r.row, r.col): r.cost for r in network.cost_fields(patches, grid, tile=3).collect()}
    assert got == pytest.approx(want)


def test_corridors_against_brute_force(spark):
    rng = random.Random(8)
    cost = {(r, c): rng.choice([1.0, 4.0, 9.0]) for r in range(10) for c in range(10)}
    seeds = {1: [(0, 0), (0, 1)], 2: [(9, 9)], 3: [(0, 9)]}
    area, dispersal, slack = {1: 2.0, 2: 3.0, 3: 5.0}, 40.0, 0.15
    fields = {p: brute_costs(cost, ks) for p, ks in seeds.items()}
    pairs = {(i, j): min(min(fields[i][k] for k in seeds[j]), min(fields[j][k] for k in seeds[i])) for i, j in ((1, 2), (1, 3), (2, 3))}
    want = {}
    for (i, j), edge in pairs.items():
        through = {k: fields[i][k] + fields[j][k] for k in cost}
        least = min(through.values())
        for k, v in through.items():
            if v <= least * (1 + slack):
                want[k] = want.get(k, 0.0) + area[i] * area[j] * math.exp(-edge / dispersal)
    grid = spark.createDataFrame([(0, *k, v) for k, v in cost.items()], "run int, row int, col int, cost double")
    patches = spark.createDataFrame([(0, p, *k) for p, ks in seeds.items() for k in ks], "run int, patch_id long, row int, col int")
    nodes = spark.createDataFrame([(0, p, a, dispersal) for p, a in area.items()], "run int, patch_id long, area_ha double, dispersal double")
    found = network.cost_fields(patches, grid)
    density = network.corridors(found, network.pair_costs(found, patches), nodes, slack).collect()
    assert {(r.row, r.col): r.density for r in density} == pytest.approx(want)
    # A stand of a corridor's cell and of one without, over two runs of one network.
    labels = spark.createDataFrame([(7, 0, 0), (7, 9, 9), (8, 5, 0)], "label long, row int, col int")
    runs = spark.createDataFrame([(0,), (1,)], "run int")
    scores = {(r.run, r.label): r.score for r in network.stand_scores(labels, network.corridors(found, network.pair_costs(found, patches), nodes, slack), runs).collect()}
    assert scores[0, 7] == pytest.approx((want.get((0, 0), 0) + want.get((9, 9), 0)) / 2) and scores[0, 8] == pytest.approx(want.get((5, 0), 0.0)) and scores[1, 7] == 0.0


def test_fields_end_where_no_corridor_reaches(spark):
    rng = random.Random(12)
    cost = {(r, c): rng.choice([1.0, 4.0, 9.0]) for r in range(40) for c in range(40)}
    seeds = {p: [(5 * (p // 8) + 1, 5 * (p % 8) + rng.randrange(3))] for p in range(64)}
    grid = spark.createDataFrame([(0, *k, v) for k, v in cost.items()], "run int, row int, col int, cost double")
    patches = spark.createDataFrame([(0, p, *k) for p, ks in seeds.items() for k in ks], "run int, patch_id long, row int, col int")
    nodes = spark.createDataFrame([(0, p, 1.0 + p % 3, 40.0) for p in seeds], "run int, patch_id long, area_ha double, dispersal double")

    def dense(fields, edges):
        return {(r.row, r.col): r.density for r in network.corridors(fields, network.backbone(edges, 3), nodes, 0.15).collect()}

    whole = network.cost_fields(patches, grid)
    fields, edges = network.near_fields(patches, grid, 3, 0.15, tile=16)
    assert dense(fields, edges) == pytest.approx(dense(whole, network.pair_costs(whole, patches)))
    assert 0 < fields.count() < 0.7 * whole.count() == 0.7 * 64 * 1600
    few = patches.where("patch_id < 2")  # fewer than three neighbours: as far as there are cells
    assert network.near_fields(few, grid, 3, 0.15)[0].count() == 2 * 1600


def test_tables_of_arrays_have_small_row_groups(spark):
    import pyarrow.parquet as pq

    from timbergrid.operators import checkpoints

    rows = checkpoints.cut(spark.range(0, 60, 1, 1).select("id", F.expr("encode(repeat(cast(id as string), 500000), 'utf-8')").alias("d")))
    groups = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in rows.inputFiles()]
    assert rows.count() == 60 and all(m.row_group(k).num_rows < 60 for m in groups for k in range(m.num_row_groups)) and sum(m.num_row_groups for m in groups) >= 3


def test_fields_of_more_layers_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(tiles, "LAYERS", 2)
    monkeypatch.setattr(tiles, "TABLES", 1)
    rng = random.Random(9)
    cost = {(r, c): rng.choice([1.0, 5.0, 50.0]) for r in range(12) for c in range(12)}
    seeds = {p: [rng.choice(list(cost))] for p in range(7)} | {7: [(40, 40)]}
    grid = spark.createDataFrame([(0, *k, v) for k, v in cost.items()], "run int, row int, col int, cost double")
    patches = spark.createDataFrame([(0, p, *k) for p, ks in seeds.items() for k in ks], "run int, patch_id long, row int, col int")
    want = {(p, *k): v for p, ks in seeds.items() if p < 7 for k, v in brute_costs(cost, ks).items()}
    assert {(r.patch_id, r.row, r.col): r.cost for r in network.cost_fields(patches, grid, tile=5).collect()} == pytest.approx(want)
    assert network.cost_fields(patches.limit(0), grid, tile=5).count() == network.cost_fields(patches, grid.limit(0)).count() == 0


def test_only_tiles_that_were_sent_an_edge_are_settled(spark, monkeypatch):
    """A way along a corridor crosses the tiles one after another; each is settled a few times, not once a round."""
    written = []
    own = tiles.cut
    monkeypatch.setattr(tiles, "cut", lambda df: written.append(own(df)) or written[-1])
    grid = spark.createDataFrame([(0, c, 1.0) for c in range(64)], "row int, col int, g double")
    start = spark.createDataFrame([(0, 0, 0.0)], "row int, col int, v double")
    got = tiles.settled(grid, start, [], lambda d, here, there, length: d + (here + there) * (length / 2), tile=4)
    assert {r.col: r.v for r in got.collect()} == {c: float(c) for c in range(64)}
    settled = [t.where("dr = 0 and dc = 0").count() for t in written if "dr" in t.columns]
    assert len(settled) >= 16 and max(settled) <= 2


@pytest.mark.parametrize("block", [4, 1024])
def test_paths_by_squares_of_blocks(spark, block):
    rng = random.Random(3)
    edges = {}
    for run in (0, 1):
        strip = [(k, k + 1) for k in range(24)]  # a path of 24 hops, and shorter ways across
        for i, j in strip + [tuple(sorted(rng.sample(range(25), 2))) for _ in range(12)]:
            edges[run, 10 * i, 10 * j] = float(rng.randrange(1, 30))
    nodes = [(run, 10 * k, 5.0 + run) for run in (0, 1) for k in range(27)]  # two without any edge
    want = {(run, i, j): 0.0 if i == j else math.inf for run, i, _ in nodes for r, j, _ in nodes if r == run}
    for (run, i, j), c in edges.items():
        want[run, i, j] = want[run, j, i] = min(want[run, i, j], c / (5.0 + run))
    for run in (0, 1):
        for k in range(0, 270, 10):
            for i in range(0, 270, 10):
                for j in range(0, 270, 10):
                    want[run, i, j] = min(want[run, i, j], want[run, i, k] + want[run, k, j])
    frame = spark.createDataFrame([(*k, c) for k, c in edges.items()], "run int, i long, j long, cost double")
    told = spark.createDataFrame(nodes, "run int, patch_id long, dispersal double")
    got = {(r.run, r.i, r.j): r.p for r in network.max_product(frame, told, block=block).collect()}
    assert got == pytest.approx({k: math.exp(-v) for k, v in want.items() if v < math.inf})
    alone = network.max_product(frame.limit(0), told, block=block)
    assert {(r.run, r.i, r.j, r.p) for r in alone.collect()} == {(run, i, i, 1.0) for run, i, _ in nodes}


def test_rounds_of_squaring_grow_with_the_logarithm_of_hops(spark, monkeypatch):
    rounds = []
    own = network.cut
    monkeypatch.setattr(network, "cut", lambda df: rounds.append(df) or own(df))
    frame = spark.createDataFrame([(0, k, k + 1, 1.0) for k in range(70)], "run int, i long, j long, cost double")
    told = spark.createDataFrame([(0, k, 1.0) for k in range(71)], "run int, patch_id long, dispersal double")
    got = network.max_product(frame, told)
    assert got.where("i = 0 and j = 70").first().p == pytest.approx(math.exp(-70))
    assert len(rounds) <= 2 + 8


def test_pairs_of_nodes_are_not_kept_or_shuffled(spark, monkeypatch):
    """What loops write is of the size of the nodes and edges, and the sums are those over all pairs."""
    rng, n = random.Random(5), 400
    edges = spark.createDataFrame([(run, i, j, float(rng.randrange(1, 90) * (1 + run))) for run in (0, 1) for i in range(n) for j in (i + 1, i + 7) if j < n and i != 250], "run int, i long, j long, cost double")
    nodes = spark.createDataFrame([(run, k, (k * 17 % 97) / 8.0, 6.0) for run in (0, 1) for k in range(n + 1)], "run int, patch_id long, area_ha double, dispersal double")
    made = []
    own = network.cut
    monkeypatch.setattr(network, "cut", lambda df: made.append(own(df)) or made[-1])
    p = network.max_product(edges, nodes, block=16)
    told = p.persist()
    assert told.where("i < j").count() == told.where("i > j").count() > n * n / 2
    assert told.where("i = 200 and j = 201").count() == 2 and told.where(f"j = {n} and i <> j").isEmpty()
    assert max(x.count() for x in made) <= 2 * 2 * 2 * n
    want = {(r.run, r.patch_id): (r.dpc, r.pc) for r in network.connectivity(told, nodes).collect()}
    made.clear()
    got = {(r.run, r.patch_id): (r.dpc, r.pc) for r in network.connectivity_of(edges, nodes, block=16).collect()}
    assert got.keys() == want.keys() and len(got) == 2 * (n + 1)
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    # Ways are followed as far as they count: not every part is loaded for every other.
    assert max(x.count() for x in made if x.columns == ["run", "s", "c"]) < 2 * 26 * 26


@pytest.mark.parametrize("levels", [None, 1, 9])
def test_nearest_goes_down_the_pyramid(spark, levels):
    """Ties, equal points, a crowd far from everything, stragglers, NULL coordinates on both sides, repeated rows."""
    rng = random.Random(12)
    at = lambda n, x, spread: [(x + rng.randrange(spread), x + rng.randrange(spread)) for _ in range(n)]
    right = [(i, float(x), float(y)) for i, (x, y) in enumerate(at(60, 0, 40) + at(40, 100_000, 5) + [(7, 7)] * 5)] + [(900, None, 1.0), (901, 1.0, None)]
    left = [(i, float(x), float(y)) for i, (x, y) in enumerate(at(50, 0, 40) + at(10, -3_000_000, 9) + at(10, 50_000, 5000) + at(5, 9_000_000, 9) + [(3, 3)] * 2)]
    points = lambda rows: spark.createDataFrame([(i, x, y, x, y) for i, x, y in rows], "id long, x1 double, y1 double, x2 double, y2 double")
    want = {i: min(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in right if u is not None and v is not None) for i, x, y in left}
    odd = [(500, None, 2.0), (501, 2.0, None), *left[:3]]
    got = spatial.nearest(points(left + odd), points(right), levels=levels).collect()
    assert len(got) == len(left) + 2
    assert {r.id: (r.d2, r.other) for r in got} == {k: (float(d), j) for k, (d, j) in want.items()} | {500: (None, None), 501: (None, None)}
    nothing = spatial.nearest(points(left[:2]), points(right[-2:])).collect()
    assert [(r.other, r.d2) for r in nothing] == [(None, None)] * 2


def test_nearest_polygons_against_all_pairs(spark):
    rng = random.Random(14)

    def rings(n, first, reach, most):
        return [e for i in range(n) for e in square(first + i, rng.randrange(reach), rng.randrange(reach), rng.randrange(1, most))]

    left, right = rings(60, 0, 900, 30), rings(30, 100, 900, 120)

    def apart(a, b):
        box = lambda es: (min(e[1] for e in es), max(e[1] for e in es), min(e[2] for e in es), max(e[2] for e in es))
        (a0, a1, a2, a3), (b0, b1, b2, b3) = box(a), box(b)
        return max(0, a0 - b1, b0 - a1) ** 2 + max(0, a2 - b3, b2 - a3) ** 2

    own = lambda es, i: [e for e in es if e[0] == i]
    want = {i: min((apart(own(left, i), own(right, j)), j) for j in range(100, 130)) for i in range(60)}
    got = spatial.nearest(spark.createDataFrame(left, SEG), spark.createDataFrame(right, SEG), polygons=True).collect()
    assert {r.id: (r.d2, r.other) for r in got} == want


@pytest.mark.parametrize("bins, few", [(4, 3), (1024, 4096), (2, 1)])
def test_quantiles_by_ranges(spark, monkeypatch, bins, few):
    monkeypatch.setattr(stats, "BINS", bins)
    monkeypatch.setattr(stats, "FEW", few)
    rng = random.Random(17)
    rows = [("a", rng.choice([0.0, 1.0, 2.5])) for _ in range(70)] + [("b", rng.uniform(-9, 9) * 10 ** rng.randrange(-20, 20)) for _ in range(41)] + [(None, 5.0), ("one", -3.0), ("c", None), ("c", float("nan")), ("b", float("inf"))]
    frame = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.fraction): r.value for r in stats.quantiles(frame, "v", [0.0, 0.37, 0.5, 0.9, 1.0], ["g"]).collect()}
    want = {}
    for g in ("a", "b", None, "one"):
        vs = sorted(v for k, v in rows if k == g and v is not None and math.isfinite(v))
        for f in (0.0, 0.37, 0.5, 0.9, 1.0):
            at = (len(vs) - 1) * f
            a, b = vs[math.floor(at)], vs[math.ceil(at)]
            want[g, f] = a + (b - a) * (at - math.floor(at))
    assert got == pytest.approx(want, rel=1e-9)
    whole = stats.quantiles(frame.where("g = 'a'"), "v", [0.5]).collect()
    assert [(r.fraction, r.value) for r in whole] == [(0.5, want["a", 0.5])]
    assert stats.quantiles(frame.limit(0), "v", [0.5], ["g"]).count() == 0


def test_class_table(spark):
    rows = [(k, d) for k, ds in {1: [8.0, 9.0, 0.5], 2: [3.0, 4.0], 5: [0.2, 1.5], 6: [0.1], 7: [5.0], 4: [0.0]}.items() for d in ds]
    got = {r.klass: (r.n, r.median_dtw, r.workable_share) for r in stats.class_table(spark.createDataFrame(rows, "klass int, dtw double")).collect()}
    assert got == {"1": (3, 8.0, 0.667), "2": (2, 3.5, 1.0), "5": (2, 0.85, 0.5), "6": (1, 0.1, 0.0), "1-3": (5, 4.0, 0.8), "all": (8, 2.25, 0.625)}
    told = stats.class_table(spark.createDataFrame([(k, 10.0 - k) for k in range(1, 7)], "klass int, dtw double"))
    assert told.where("klass = 'all'").first().spearman == -1.0 and told.where("spearman is not null").count() == 1


def test_resistance_of_burned_stands(spark):
    """Of two stands over a cell the later counts where it has a value; off stands and without values land cover counts."""
    from timbergrid.plans.config import Resistance

    cfg, grid = Resistance(), Grid(0.0, 40.0, 10.0, 4, 4)
    edges = spark.createDataFrame(square(1, 0, 0, 40) + square(2, 0, 0, 20), SEG)
    stands = spark.createDataFrame([(1, "60", 12.5, 0.25), (2, "old", 25.0, None)], "id int, meanage string, basalarea double, proportionother double")
    cover = spark.createDataFrame([(r, c, 24.0) for r in range(2) for c in range(2)], "row int, col int, clc double")
    bands = {(r.row, r.col): (r.meanage, r.basalarea, r.proportionother) for r in raster.stand_bands(edges, stands, grid, ["meanage", "basalarea", "proportionother"]).collect()}
    assert bands == {(r, c): (60.0, 25.0, 0.25) if r > 1 and c < 2 else (60.0, 12.5, 0.25) for r in range(4) for c in range(4)}
    w, t = cfg.weights, cfg.land_cover[next(k for k, v in cfg.classes.items() if 24 in v)]
    blend = lambda basal: cfg.low + (cfg.high - cfg.low) * (w["age"] * 0.5 + w["structure"] * (1 - basal / 25) + w["species"] * 0.5 + w["landcover"] * t)
    got = {(r.row, r.col): r.cost for r in raster.stand_resistance(edges, stands, cover, Grid(0.0, 40.0, 20.0, 2, 2), grid).collect()}
    assert got == pytest.approx({k: blend(b[1]) for k, b in bands.items()})
    none = raster.stand_resistance(edges.limit(0), stands, cover, Grid(0.0, 40.0, 20.0, 2, 2), grid).collect()
    assert {round(r.cost, 9) for r in none} == {round(cfg.low + (cfg.high - cfg.low) * t, 9)} and len(none) == 16


def test_a_larger_graph_has_larger_parts_not_more(spark, monkeypatch):
    rng, blocks, by_parts = random.Random(5), [], network._by_parts
    edges = spark.createDataFrame([(0, i, j, float(rng.randrange(1, 90))) for i in range(70) for j in {(i + 1) % 70, (7 * i + 3) % 70} if i < j], "run int, i int, j int, cost double")
    nodes = spark.createDataFrame([(0, i, 40.0) for i in range(70)], "run int, patch_id int, dispersal double")
    told = {(r.i, r.j): r.p for r in network.max_product(edges, nodes, block=8).collect()}
    monkeypatch.setattr(network, "PARTS", 4)
    monkeypatch.setattr(network, "_by_parts", lambda e, n, by, block, most: blocks.append(block) or by_parts(e, n, by, block, most))
    assert {(r.i, r.j): r.p for r in network.max_product(edges, nodes, block=8).collect()} == told and blocks == [18]


def test_connectivity_over_ground_keeps_no_fields_and_no_pairs(spark, monkeypatch):
    """The same sums as from all fields and pairs, with blocks of two patches, patches in two places or off the ground, and gaps."""
    rng = random.Random(21)
    cost = {(run, r, c): rng.choice([1.0, 3.0, 20.0]) for run in (0, 1) for r in range(18) for c in range(22) if rng.random() > 0.1}
    seeds = {p: [(r, c), (r, c + 1)] for p, (r, c) in enumerate((rng.randrange(18), rng.randrange(21)) for _ in range(24))}
    seeds |= {30: [(0, 0), (17, 20)], 31: [(60, 60)], 32: seeds[3][:1] + seeds[9]}
    grid = spark.createDataFrame([(*k, v) for k, v in cost.items()], "run int, row int, col int, cost double")
    patches = spark.createDataFrame([(run, p, *k) for p, ks in seeds.items() for k in ks for run in (0, 1)], "run int, patch_id long, row int, col int")
    for scale in (30.0, 0.05):  # ways as far as there is ground, or a few cells
        nodes = spark.createDataFrame([(run, p, 1.0 + p % 4, scale * (1 + run)) for p in seeds for run in (0, 1)], "run int, patch_id long, area_ha double, dispersal double")
        fields = network.cost_fields(patches, grid)
        want = {(r.run, r.i): (r.ai, r.s) for r in network.reached_area(network._hops(network.pair_costs(fields, patches), nodes, ["run"]), nodes).collect()}
        made, own = [], checkpoints.cut
        monkeypatch.setattr(network, "cut", lambda df: made.append(own(df)) or made[-1])  # noqa: B023
        for tile, block, held in ((256, 512, 2**24), (4, 2, 600)):
            monkeypatch.setattr(network, "HELD", held)
            got = {(r.run, r.i): (r.ai, r.s) for r in network.reached_over_ground(patches, grid, nodes, tile=tile, block=block).collect()}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
        assert max(x.count() for x in made) <= 2 * sum(len(ks) for ks in seeds.values())
    monkeypatch.setattr(network, "cut", own)
    assert network.reached_over_ground(patches, grid.limit(0), nodes).where("s <> ai").isEmpty()


def test_a_connected_sweep_asks_for_no_whole_fields(spark, monkeypatch):
    from timbergrid.plans.config import Resistance, Sweep, perturbed

    monkeypatch.setattr(network, "cost_fields", None)
    cells = spark.createDataFrame([(r, c, 24, 50.0, 10.0, 0.5) for r in range(8) for c in range(12)], "row int, col int, clc int, meanage double, basalarea double, proportionother double")
    patch = spark.createDataFrame([(r, c, p, 2.0) for p, c in ((1, 0), (2, 6), (3, 11)) for r in (3, 4)], "row int, col int, patch_id long, area_ha double")
    labels = cells.select("row", "col", F.floor(F.col("row") / 2).cast("long").alias("label"))
    base = Resistance(coarsen=1)
    got = network.sweep(cells, patch, labels, [(-1, base), *perturbed(base, Sweep(n_runs=2))], 8, 12)
    alone = network.sweep(cells, patch, labels, perturbed(base, Sweep(n_runs=2)), 8, 12)
    assert {r.run for r in got["connectivity"].collect()} == {-1, 0, 1}
    assert sorted(got["robust"].collect()) == sorted(alone["robust"].collect())


def test_near_fields_of_lone_and_gathered_patches(spark):
    """Patches of one corner come with few tiles, a lone one asks for more; backbone and fields are those of whole fields."""
    rng = random.Random(14)
    cost = {(r, c): rng.uniform(1.0, 9.0) for r in range(30) for c in range(30) if rng.random() > 0.05}
    at = [k for k in cost if max(k) < 9]
    seeds = {p: rng.sample(at, 2) for p in range(12)} | {20: [max(cost)], 21: [(90, 90)]}
    grid = spark.createDataFrame([(0, *k, v) for k, v in cost.items()], "run int, row int, col int, cost double")
    patches = spark.createDataFrame([(0, p, *k) for p, ks in seeds.items() for k in ks], "run int, patch_id long, row int, col int")
    whole = network.cost_fields(patches, grid)
    told = lambda e: {(r.i, r.j): r.cost for r in network.backbone(e, 3).collect()}
    fields, edges = network.near_fields(patches, grid, 3, 0.15, tile=3)
    want = told(network.pair_costs(whole, patches))
    assert told(edges) == pytest.approx(want)
    most = {p: max(v for k, v in want.items() if p in k) * 1.15 + 1e-9 for p in seeds if p != 21}
    got = {(r.patch_id, r.row, r.col): r.cost for r in fields.collect()}
    assert got == pytest.approx({(r.patch_id, r.row, r.col): r.cost for r in whole.collect() if r.cost <= most[r.patch_id]})
    assert network.near_fields(patches, grid.limit(0), 3, 0.15)[0].isEmpty()


def test_sums_over_ground_take_no_passes_over_cells(monkeypatch):
    """Sums from a tree of regions are those of all ways, by patches of one cell, in two places or with gaps about them; a source takes
    fewer sums than two passes over the cells, the least that tell that nothing falls any more, of 14 a cell."""
    import numpy as np
    import pyarrow as pa

    rng, n, tile = random.Random(8), 40, 64
    cost = {(r, c): rng.choice([1.0, 4.0, 30.0]) for r in range(n) for c in range(n) if rng.random() > 0.1 and c != 37}
    seeds = {p: rng.sample(sorted(cost), 1) for p in range(60)} | {90: [(0, 0), (n - 1, n - 1)]}
    seeds |= {91: [*seeds[3], *seeds[90][:1]], 92: [rng.choice([k for k in cost if k[1] > 37])]}
    cost |= {(0, 0): 1.0, (n - 1, n - 1): 1.0}
    ground = np.full((tile + 2, tile + 2), np.nan)
    for (r, c), x in cost.items():
        ground[r + 1, c + 1] = x
    cells = pa.array([{"id": p, "row": r, "col": c, "area": 1.0 + p % 4, "n": len(ks)} for p, ks in seeds.items() for r, c in ks])
    parts = pa.StructArray.from_arrays([pa.array([0]), pa.array([0]), pa.array([ground.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), cells)], ["tr", "tc", "g", "cells"])

    def whole(source):
        far, line, on = dict.fromkeys(seeds[source], 0.0), [(0.0, k) for k in seeds[source]], {}
        for p, ks in seeds.items():
            for k in ks:
                on.setdefault(k, set()).update(ks)
        while line:
            d, k = heapq.heappop(line)
            steps = [(d, x) for x in on.get(k, ())]
            steps += [(d + (cost[k] + cost[x]) / 2 * math.hypot(dr, dc), x) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (x := (k[0] + dr, k[1] + dc)) in cost]
            for v, x in steps:
                if v < far.get(x, math.inf):
                    far[x] = v
                    heapq.heappush(line, (v, x))
        return sum((1.0 + p % 4) * math.exp(-min(far.get(k, math.inf) for k in ks) / 40.0) for p, ks in seeds.items())

    looks, own, told = [], network._min_plus, [3, 7, 20, 55, 90, 91, 92]
    monkeypatch.setattr(network, "_min_plus", lambda w, v: looks.append(w.size * v.shape[1]) or own(w, v))
    want = [whole(p) for p in told]
    for side, times in ((4, 0), (4, 1), (8, 2)):
        looks.clear()
        monkeypatch.setattr(network, "SIDE", side)
        monkeypatch.setattr(network, "WHOLE", times)
        for some in (1, 256):
            monkeypatch.setattr(network, "SOURCES", some)
            assert list(network._sums(parts, np.array(told), 40.0, np.inf, tile)) == pytest.approx(want, rel=1e-12)
        assert sum(looks) < 2 * len(told) * 2 * 14 * n * n


def test_a_graph_comes_to_a_task_in_small_rows(spark, monkeypatch):
    """However large a part and what it reaches: a row holds the edges of a few nodes, and pairs are given out some at a time."""
    rng, n = random.Random(4), 90
    edges = spark.createDataFrame([(run, i, j, float(rng.randrange(1, 90))) for run in (0, 1) for i in range(n) for j in (i + 2, i + 4) if j < n], "run int, i int, j int, cost double")
    nodes = spark.createDataFrame([(run, k, (k * 17 % 97) / 8.0, 40.0) for run in (0, 1) for k in range(n + 1)], "run int, patch_id int, area_ha double, dispersal double")
    p = {(r.run, r.i, r.j): r.p for r in network.max_product(edges, nodes).collect()}
    want = {(r.run, r.patch_id): r.dpc for r in network.connectivity_of(edges, nodes).collect()}
    monkeypatch.setattr(network, "PIECE", 4)
    monkeypatch.setattr(network, "AT_MOST", 7)
    loads = next(network._by_parts(network._hops(edges, nodes, ["run"]), nodes, ["run"], 64, math.inf))
    assert {(r.n, r.e) for r in loads.select(F.size("nodes").alias("n"), F.size("edges").alias("e")).collect()} <= {(a, b) for a in range(1, 5) for b in range(17)}
    assert loads.where("s = 0").agg(F.sum(F.size("edges"))).first()[0] == 4 * edges.where("run = 0").count()
    assert {(r.run, r.i, r.j): r.p for r in network.max_product(edges, nodes).collect()} == p and len(p) == 2 * (45 * 45 * 2 + 1)
    assert {(r.run, r.patch_id): r.dpc for r in network.connectivity_of(edges, nodes, block=16).collect()} == pytest.approx(want)
