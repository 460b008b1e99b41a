"""Flow over grids of heights: breaching, filling, D8 and D-infinity flow, accumulation, channels, height above the stream.

Pits are breached along their cheapest way to lower ground within a reach, each on its own; what is left is filled to its
spill height, tile by tile, in as many rounds as a way out crosses tiles. Directions are joins of cells with their
neighbours. D8 accumulation, links of channels and height above stream follow pointers in doubling steps, so their rounds
grow with the logarithm of the longest path. D-infinity flow has two receivers a cell, so a tile passes its water on in
one go and tiles hand each other what crosses their borders.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbergrid.operators import tiles
from timbergrid.operators.checkpoints import cut, drop, ship, spread

_AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


def _cells(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the grid. As packed on disk it looks small enough to be sent through the driver,
    where it is many times as large; it is shuffled instead."""
    return df.hint("merge")


def _offsets():
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(2**0.5 if r and c else 1.0).alias("n")) for k, (r, c) in enumerate(_AROUND)])


def _around(cells: DataFrame, value: str) -> DataFrame:
    """(row, col, own value, k, n, there): each cell with each neighbour's value."""
    near = cells.select("row", "col", F.col(value).alias("own"), F.explode(_offsets()).alias("o"))
    there = cells.select(F.col("row").alias("nr"), F.col("col").alias("nc"), F.col(value).alias("there"))
    return near.select("row", "col", "own", "o.k", "o.n", (F.col("row") + F.col("o.r")).alias("nr"), (F.col("col") + F.col("o.c")).alias("nc")).join(_cells(there), ["nr", "nc"])


def filled(dem: DataFrame, z: str = "z", rise: float = 1e-4, tile: int = tiles.TILE) -> DataFrame:
    """(row, col, z): every pit raised to its lowest way out; cells at the rim of the data are outlets.

    Each raised cell stands ``rise`` above the next on its way out, so that flats drain. Tiles fill on their own and
    exchange their edges until none changes.
    """
    cells = dem.where(F.col(z).isNotNull()).select("row", "col", F.col(z).alias("g"))
    return tiles.settled(cells, None, [], lambda d, here, there, length: np.maximum(there, d + rise), tile=tile).withColumnRenamed("v", "z")


def _way_out(z: np.ndarray, r: int, c: int, reach: int) -> tuple[list[tuple[int, int]], bool] | None:
    """The cheapest way from a pit to a lower cell, or to the rim, within ``reach`` cells; whether it ends lower.

    A step costs what must be cut from the cell that it enters, times its length. NaN cells aren't there.
    """
    z0, cost, came = z[r, c], {(r, c): 0.0}, {}
    heap = [(0.0, r, c)]
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > cost[i, j]:
            continue
        lower = bool(z[i, j] < z0)
        if lower or ((i, j) != (r, c) and np.isnan(z[i - 1 : i + 2, j - 1 : j + 2]).any()):
            way = [(i, j)]
            while way[-1] != (r, c):
                way.append(came[way[-1]])
            return way[::-1], lower
        for a, b in _AROUND:
            k = (i + a, j + b)
            if abs(k[0] - r) <= reach and abs(k[1] - c) <= reach and z[k] == z[k]:
                n = d + max(0.0, float(z[k] - z0)) * (2**0.5 if a and b else 1.0)
                if n < cost.get(k, math.inf):
                    cost[k], came[k] = n, (i, j)
                    heapq.heappush(heap, (n, *k))
    return None


def breached(dem: DataFrame, reach: int, z: str = "z", rise: float = 1e-4, tile: int = tiles.TILE) -> DataFrame:
    """(row, col, z): every pit with a way to lower ground or the rim within ``reach`` cells is cut open along it.

    A pit is a cell inside the data with no lower neighbour. Its way is searched on the given heights, so pits don't wait
    for each other; a way falls evenly from the pit to its end, and a cell of several ways takes the lowest. The way
    that gave a cell its height goes on below it, so no cut cell is a pit, and no other cell becomes one. Pits without a
    way stay, for ``filled``. A task holds one tile and ``reach`` cells around it.
    """
    ship(dem.sparkSession)
    wide = tile + 2 * (reach + 1)  # a cell's neighbours tell whether it is at the rim

    def cut_ways(key: tuple, group: pa.Table) -> pa.Table:
        r0, c0 = key[0].as_py() * tile - reach - 1, key[1].as_py() * tile - reach - 1
        heights = np.full((wide + 2, wide + 2), np.nan)
        heights[group["row"].to_numpy() - r0 + 1, group["col"].to_numpy() - c0 + 1] = group["z"].to_numpy()
        around = np.stack([heights[1 + a : wide + 1 + a, 1 + b : wide + 1 + b] for a, b in _AROUND])
        own = heights[1:-1, 1:-1]
        pits = (around >= own).all(axis=0)  # false where a neighbour isn't there
        inner = np.zeros_like(pits)
        inner[reach + 1 : reach + 1 + tile, reach + 1 : reach + 1 + tile] = True
        rows, cols, cuts = [], [], []
        for r, c in np.argwhere(pits & inner):
            found = _way_out(heights, int(r) + 1, int(c) + 1, reach)
            if found:
                way, lower = found
                n, top = len(way) - 1, heights[way[0]]
                end = heights[way[-1]] if lower else top - rise * n
                for k, (i, j) in enumerate(way):
                    if heights[i, j] > (cut := top + (end - top) * k / n):
                        rows.append(i - 1 + r0)
                        cols.append(j - 1 + c0)
                        cuts.append(cut)
        return pa.table([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(cuts, pa.float64())], names=["row", "col", "cut"])

    cells = dem.where(F.col(z).isNotNull()).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(z).cast("double").alias("z"))
    of = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach - 1) / tile).cast("int"), F.floor((F.col(c) + reach + 1) / tile).cast("int")))
    cuts = spread(cells.withColumn("tr", of("row")).withColumn("tc", of("col")), "tr", "tc").groupBy("tr", "tc").applyInArrow(cut_ways, "row int, col int, cut double")
    least = cuts.groupBy("row", "col").agg(F.min("cut").alias("cut"))
    return cells.join(_cells(least), ["row", "col"], "left").select("row", "col", F.least("z", "cut").alias("z"))


def d8(dem: DataFrame, z: str = "z") -> DataFrame:
    """(row, col, to_row, to_col): the steepest way down, the first neighbour among equals; NULL where none is lower."""
    drop = (F.col("own") - F.col("there")) / F.col("n")
    best = _around(dem, z).withColumn("drop", drop).where("drop > 0").groupBy("row", "col").agg(F.max(F.struct("drop", (-F.col("k")).alias("k"), F.col("nr").alias("to_row"), F.col("nc").alias("to_col"))).alias("b"))
    return dem.select("row", "col").join(_cells(best.select("row", "col", "b.to_row", "b.to_col")), ["row", "col"], "left")


def accumulation(flow: DataFrame) -> DataFrame:
    """(row, col, accum_cells): cells that drain through each cell, itself included.

    What a cell has gathered so far is sent along a pointer that doubles in length every round.
    """
    state = cut(flow.select("row", "col", F.col("to_row").alias("tr"), F.col("to_col").alias("tc"), F.lit(1).cast("long").alias("acc")))
    while not state.where("tr is not null").isEmpty():
        sent = state.where("tr is not null").groupBy(F.col("tr").alias("row"), F.col("tc").alias("col")).agg(F.sum("acc").alias("got"))
        jump = state.select(F.col("row").alias("tr"), F.col("col").alias("tc"), F.col("tr").alias("fr"), F.col("tc").alias("fc"))
        state = cut(state.join(_cells(sent), ["row", "col"], "left").join(_cells(jump), ["tr", "tc"], "left").select("row", "col", F.col("fr").alias("tr"), F.col("fc").alias("tc"), (F.col("acc") + F.coalesce("got", F.lit(0))).alias("acc")))
    return state.select("row", "col", F.col("acc").alias("accum_cells"))


#: For each facet the direct and the diagonal neighbour, counter-clockwise from east, as (row, col) steps.
FACETS = (((0, 1), (-1, 1)), ((-1, 0), (-1, 1)), ((-1, 0), (-1, -1)), ((0, -1), (-1, -1)), ((0, -1), (1, -1)), ((1, 0), (1, -1)), ((1, 0), (1, 1)), ((0, 1), (1, 1)))


def d_infinity(dem: DataFrame, z: str = "z") -> DataFrame:
    """(row, col, k1, p1, k2, p2): receivers of the steepest facet's flow, as neighbour numbers, and their shares.

    A facet is the plane through a cell, a direct neighbour and the diagonal one beside it. Its flow is along the
    steepest way down within its eighth of a turn, shared by the angle's distance to both neighbours; the first of
    equal facets counts, where slopes are equal to nine digits: a root and a quotient of the same slope end in different
    bits. A cell without a falling facet has NULLs.
    """
    number = {step: k for k, step in enumerate(_AROUND)}
    near = _around(dem.where(F.col(z).isNotNull()), z).groupBy("row", "col", "own").agg(*[F.max(F.when(F.col("k") == k, F.col("there"))).alias(f"z{k}") for k in range(8)])
    facets = []
    for n, (direct, diagonal) in enumerate(FACETS):
        k1, k2 = number[direct], number[diagonal]
        s1, s2 = F.col("own") - F.col(f"z{k1}"), F.col(f"z{k1}") - F.col(f"z{k2}")
        angle = F.atan2(s2, s1)
        slope = F.when(angle < 0, s1).when(angle > math.pi / 4, (F.col("own") - F.col(f"z{k2}")) / 2**0.5).otherwise(F.sqrt(s1 * s1 + s2 * s2))
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), angle / (math.pi / 4)))
        facets.append(F.struct(F.round(slope, 9).alias("steep"), F.lit(-n).alias("n"), slope.alias("slope"), F.lit(k1).alias("k1"), (1 - share).alias("p1"), F.lit(k2).alias("k2"), share.alias("p2")))
    best = near.withColumn("f", F.array_max(F.filter(F.array(*facets), lambda f: f["slope"] > 0)))
    return best.select("row", "col", "f.k1", "f.p1", "f.k2", "f.p2")


def _passed_on(amount: np.ndarray, to: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What passes each cell: its amount and its givers'; ``to``: receivers, -1 for none or beyond. No cell feeds itself."""
    total, live = amount.copy(), to >= 0
    waits = np.bincount(to[live], minlength=len(amount))
    front = np.flatnonzero(waits == 0)
    while len(front):
        ends, parts = to[front], (share[front] * total[front, None])
        on = ends >= 0
        np.add.at(total, ends[on], parts[on])
        np.subtract.at(waits, ends[on], 1)
        met = np.unique(ends[on])
        front = met[waits[met] == 0]
    return total


def shared_accumulation(flow: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """(row, col, accum_cells: double): water of one unit a cell through each cell, itself included, from ``d_infinity``.

    A round passes water through tiles, in the order of their cells' flow, and hands on what leaves them; the next
    takes what came, and only where some came. Rounds grow with the tiles that the longest way crosses.
    """
    ship(flow.sparkSession)
    at = ["tr", "tc"]

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        here = (group["row"].to_numpy() - key[0].as_py() * tile) * tile + group["col"].to_numpy() - key[1].as_py() * tile
        k, p = np.full((tile * tile, 2), -1, dtype=np.int8), np.zeros((tile * tile, 2))
        for n in (1, 2):
            share = group[f"p{n}"].fill_null(0.0).to_numpy()
            k[here, n - 1] = np.where(share > 0, group[f"k{n}"].fill_null(-1).to_numpy(), -1)
            p[here, n - 1] = share
        return pa.table([pa.array([x.as_py()], pa.int32()) for x in key] + [pa.array([x.tobytes()], pa.binary()) for x in (here.astype(np.int32), k, p)], names=[*at, "cells", "k", "p"])

    placed = flow.withColumns({c: F.floor(F.col(of) / tile).cast("int") for c, of in (("tr", "row"), ("tc", "col"))})
    grid = cut(spread(placed, *at).groupBy(*at).applyInArrow(pack, "tr int, tc int, cells binary, k binary, p binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), dtype=kind)  # noqa: B023, E731
                tr, tc = batch.column("tr")[i].as_py(), batch.column("tc")[i].as_py()
                k, p = cell("k", np.int8).reshape(-1, 2), cell("p", np.float64).reshape(-1, 2)
                came = batch.column("came")[i].as_py()
                amount = np.zeros(tile * tile)
                if came is None:
                    amount[cell("cells", np.int32)] = 1.0
                else:
                    amount[[x["at"] for x in came]] = [x["amount"] for x in came]
                r, c = np.divmod(np.arange(tile * tile), tile)
                step = np.array([*_AROUND, (0, 0)])[k]
                tor, toc = r[:, None] + step[:, :, 0], c[:, None] + step[:, :, 1]
                inside = (k >= 0) & (tor >= 0) & (tor < tile) & (toc >= 0) & (toc < tile)
                total = _passed_on(amount, np.where(inside, tor * tile + toc, -1), p)
                wet = np.flatnonzero(total)
                out = (k >= 0) & ~inside & (total > 0)[:, None]
                leaving = (total[:, None] * p)[out]
                rows, cols = np.concatenate((r[wet], tor[out])) + tr * tile, np.concatenate((c[wet], toc[out])) + tc * tile
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([False, True], [len(wet), len(leaving)])), pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(np.concatenate((total[wet], leaving)))], ["leaves", "row", "col", "amount"])

    todo, rounds = grid.withColumn("came", F.lit(None).cast("array<struct<at:int,amount:double>>")), []
    while True:
        rounds.append(cut(spread(todo, *at).mapInArrow(run, "leaves boolean, row int, col int, amount double")))
        sent = rounds[-1].where("leaves")
        if sent.isEmpty():
            break
        met = sent.groupBy("row", "col").agg(F.sum("amount").alias("amount")).withColumns({c: F.floor(F.col(of) / tile).cast("int") for c, of in (("tr", "row"), ("tc", "col"))})
        came = met.groupBy(*at).agg(F.collect_list(F.struct(((F.col("row") - F.col("tr") * tile) * tile + F.col("col") - F.col("tc") * tile).cast("int").alias("at"), "amount")).alias("came"))
        todo = grid.join(_cells(came), at)  # a tile's rim at most
    every = reduce(DataFrame.unionByName, [x.where("not leaves") for x in rounds])
    return every.groupBy("row", "col").agg(F.sum("amount").alias("accum_cells"))


def channels(accum: DataFrame, threshold_ha: float, res: float) -> DataFrame:
    return accum.where(F.col("accum_cells") >= threshold_ha * 1e4 / (res * res)).select("row", "col")


def channel_links(accum: DataFrame, flow: DataFrame, threshold_ha: float, res: float) -> DataFrame:
    """(link, rank, row, col, to_row, to_col, step_m): channel cells in the order of their link, with the step that follows.

    A link begins at a head or at a junction and ends at the next junction or the channel's end; its number is that of its
    first cell. Cells look up their link by pointers to the cell above that double in length every round. The last
    cell of a link that ends without a junction has no step.
    """
    stream = channels(accum, threshold_ha, res)
    end = stream.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.lit(True).alias("on"))
    down = cut(stream.join(_cells(flow), ["row", "col"]).join(_cells(end), ["to_row", "to_col"], "left").select("row", "col", F.when(F.col("on"), F.col("to_row")).alias("to_row"), F.when(F.col("on"), F.col("to_col")).alias("to_col")))
    given = down.where("to_row is not null").groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("row").alias("r"), F.col("col").alias("c"))).alias("above"))
    own = F.struct(F.col("row").alias("r"), F.col("col").alias("c"))
    state = cut(down.join(_cells(given), ["row", "col"], "left").select("row", "col", F.when(F.col("n") == 1, F.col("above")).otherwise(own).alias("up"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("rank")))
    while True:
        ahead = state.select(F.struct(F.col("row").alias("r"), F.col("col").alias("c")).alias("up"), F.col("up").alias("far"), F.col("rank").alias("more"))
        after = cut(state.join(_cells(ahead), "up").select("row", "col", F.col("far").alias("up"), (F.col("rank") + F.col("more")).alias("rank"), (F.col("more") > 0).alias("moved")))
        drop(state)
        state = after
        if after.where("moved").isEmpty():
            break
    link = F.shiftleft(F.col("up.r").cast("long"), 32) + F.col("up.c")
    step = F.when((F.col("row") != F.col("to_row")) & (F.col("col") != F.col("to_col")), 2**0.5).otherwise(F.lit(1.0)) * res
    return state.join(_cells(down), ["row", "col"]).select(link.alias("link"), "rank", "row", "col", "to_row", "to_col", F.when(F.col("to_row").isNotNull(), step).alias("step_m"))


def channel_lines(links: DataFrame) -> DataFrame:
    """(link, length_m, line): a polyline for each link of two cells or more, its vertices (row, col) in order downstream."""
    steps = links.where("step_m is not null").groupBy("link").agg(F.sum("step_m").alias("length_m"), F.sort_array(F.collect_list(F.struct("rank", "row", "col", "to_row", "to_col"))).alias("s"))
    vertices = F.concat(F.transform("s", lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"))), F.array(F.struct(F.element_at("s", -1)["to_row"].alias("row"), F.element_at("s", -1)["to_col"].alias("col"))))
    return steps.select("link", "length_m", vertices.alias("line"))


def channel_report(accum: DataFrame, flow: DataFrame, thresholds_ha: list[float], res: float) -> DataFrame:
    """(threshold_ha, n_segments, length_m, longest_m) of the channels of each threshold."""
    out = []
    for t in thresholds_ha:
        length = channel_links(accum, flow, t, res).where("step_m is not null").groupBy("link").agg(F.sum("step_m").alias("m"))
        out.append(length.agg(F.count(F.lit(1)).alias("n_segments"), F.coalesce(F.sum("m"), F.lit(0.0)).alias("length_m"), F.coalesce(F.max("m"), F.lit(0.0)).alias("longest_m")).withColumn("threshold_ha", F.lit(float(t))))
    return reduce(DataFrame.unionByName, out).select("threshold_ha", "n_segments", "length_m", "longest_m")


def height_above_stream(dem: DataFrame, flow: DataFrame, streams: DataFrame, z: str = "z") -> DataFrame:
    """(row, col, dtw): height above the first stream cell downslope; NULL where the way ends without one."""
    mark = streams.select("row", "col", F.lit(True).alias("is_stream"))
    own = F.struct(F.col("row").alias("r"), F.col("col").alias("c"))
    start = flow.join(_cells(mark), ["row", "col"], "left").join(_cells(dem.select("row", "col", F.col(z).cast("double").alias("z"))), ["row", "col"])
    hit = F.coalesce("is_stream", F.lit(False))
    state = cut(start.select("row", "col", "z", F.when(hit, F.col("z")).alias("base"), F.when(~hit, F.col("to_row")).alias("tr"), F.when(~hit, F.col("to_col")).alias("tc")))
    while not state.where("base is null and tr is not null").isEmpty():
        ahead = state.select(F.col("row").alias("tr"), F.col("col").alias("tc"), F.col("base").alias("nb"), F.col("tr").alias("fr"), F.col("tc").alias("fc"))
        state = cut(state.join(_cells(ahead), ["tr", "tc"], "left").select("row", "col", "z", F.coalesce("base", "nb").alias("base"), F.when(F.coalesce("base", "nb").isNull(), F.col("fr")).alias("tr"), F.when(F.coalesce("base", "nb").isNull(), F.col("fc")).alias("tc")))
    return state.select("row", "col", (F.col("z") - F.col("base")).alias("dtw"))


def depth_to_water(dem: DataFrame, thresholds_ha: list[float], res: float, z: str = "z", breach_m: float = 2000.0, routing: str = "dinf") -> DataFrame:
    """(threshold_ha, row, col, dtw) for each channel threshold, from one breached and filled surface and one accumulation.

    Channels are of D-infinity flow, or with ``routing="d8"`` of D8; heights are above the first channel cell down the
    D8 way of the surface.
    """
    opened = cut(breached(dem, max(1, round(breach_m / res)), z)) if breach_m else dem.select("row", "col", F.col(z).alias("z"))
    surface = cut(filled(opened))
    flow = cut(d8(surface))
    accum = cut(accumulation(flow) if routing == "d8" else shared_accumulation(d_infinity(surface)))
    out = None
    for t in thresholds_ha:
        one = height_above_stream(surface, flow, channels(accum, t, res)).withColumn("threshold_ha", F.lit(float(t)))
        out = one if out is None else out.unionByName(one)
    return out
