"""Values that spread over a grid, settled tile by tile: filling of pits and least costs.

A round settles the tiles that were sent an edge, each on its own, and sends on those of their edges that have changed.
Rounds grow with the number of tiles that a way crosses, not with its cells. Ground is a table of its own, written once;
a round writes only the tiles that it settled. Fields over the same ground are layers of one array, a few at a time, so a
task holds one tile of ``LAYERS`` fields, and its passes over rows and columns are array operations on all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbergrid.operators.checkpoints import cut, ship
from timbergrid.operators.checkpoints import spread as dealt

TILE = 256
LAYERS = 16
#: Tables of settled tiles that are kept side by side before the latest of each tile are put into one.
TABLES = 8
AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
#: Value at the next cell from: value here, ground here, ground there, length of the step. It must not fall. For arrays.
Offer = Callable[[np.ndarray, np.ndarray, np.ndarray, float], np.ndarray]


def edge(d: int, tile: int) -> slice:
    return slice(0, 1) if d < 0 else slice(tile - 1, tile) if d > 0 else slice(0, tile)


def beyond(d: int, tile: int) -> slice:
    """Where an edge that came by a step ``d`` lies around the tile that it came to."""
    return slice(tile + 1, tile + 2) if d < 0 else slice(0, 1) if d > 0 else slice(1, tile + 1)


def spread(value: np.ndarray, ground: np.ndarray, offer: Offer) -> None:
    """Lower the inner cells of padded layers (layer, row, col) to what reaches them, pass by pass, until none falls."""
    side, here, wide = value.shape[1], slice(1, -1), 2**0.5
    sides = ((slice(0, -2), wide), (slice(1, -1), 1.0), (slice(2, None), wide))
    while True:
        before = value[:, 1:-1, 1:-1].copy()
        for lines, step in ((range(1, side - 1), -1), (range(side - 2, 0, -1), 1)):
            for r in lines:
                for at, length in sides:
                    np.minimum(value[:, r, here], offer(value[:, r + step, at], ground[r + step, at], ground[r, here], length), out=value[:, r, here])
            for c in lines:
                for at, length in sides:
                    np.minimum(value[:, here, c], offer(value[:, at, c + step], ground[at, c + step], ground[here, c], length), out=value[:, here, c])
        if np.array_equal(before, value[:, 1:-1, 1:-1]):
            return


def ground_tiles(ground: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """(keys, tr, tc, g): a row for each tile with its cells' ``g`` and those around it; NaN where there is none."""
    kinds = {f.name: f.dataType.simpleString() for f in ground.schema}
    at = [*keys, "tr", "tc"]

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        tr, tc = key[-2].as_py(), key[-1].as_py()
        out = np.full((tile + 2, tile + 2), np.nan)
        out[group["row"].to_numpy() - tr * tile + 1, group["col"].to_numpy() - tc * tile + 1] = group["g"].to_numpy()
        if np.isnan(out[1:-1, 1:-1]).all():  # what is around a tile without cells
            return pa.table([pa.array([], k.type) for k in key] + [pa.array([], pa.binary())], names=[*at, "g"])
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([out.tobytes()], pa.binary())], names=[*at, "g"])

    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col(c) + d) / tile).cast("int")))
    cells = ground.where(F.col("g").isNotNull()).select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("g").cast("double").alias("g"))
    placed = cells.withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col")))
    return dealt(placed, *at).groupBy(*at).applyInArrow(pack, "".join(f"{k} {kinds[k]}, " for k in keys) + "tr int, tc int, g binary")


def settled(ground: DataFrame, starts: DataFrame | None, keys: Sequence[str], offer: Offer, layer: str | None = None, tile: int = TILE) -> DataFrame:
    """(keys, layer, row, col, v): the lowest value that reaches each cell; unreached cells are left out.

    ``ground``: keys, row, col, g; a cell without g isn't there. ``starts``: keys, layer, row, col, v; a start off the
    ground is none. Without ``starts`` the cells that lack one of their eight neighbours start with their ground.
    ``layer`` is a column of whole numbers that tells fields over one ground apart.
    """
    ship(ground.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in ground.schema}
    reach = ground.agg(F.max("row").alias("r"), F.max("col").alias("c"), F.min("row").alias("r0"), F.min("col").alias("c0")).first()
    if reach["r"] is None:
        told = "".join(f"{k} {kinds[k]}, " for k in keys) + (f"{layer} long, " if layer else "")
        return ground.sparkSession.createDataFrame([], told + "row int, col int, v double")
    if min(reach["r0"], reach["c0"]) >= 0:
        tile = min(tile, max(reach["r"], reach["c"]) + 1)
    at = [*keys, "_g", "tr", "tc"]
    head = "".join(f"{k} {kinds[k]}, " for k in keys) + "_g int, tr int, tc int, "
    grounds = cut(ground_tiles(ground, keys, tile))
    if starts is None:
        first = grounds.select(*keys, F.lit(0).alias("_g"), "tr", "tc", F.array().cast("array<struct<layer:bigint,row:int,col:int,v:double>>").alias("start"))
    else:
        named = starts.select(*keys, (F.col(layer).cast("long") if layer else F.lit(0).cast("long")).alias("layer"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("v").cast("double").alias("v"))
        groups = 1
        if layer:
            most = named.groupBy(*keys).agg(F.countDistinct("layer").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
            groups = -(-most // LAYERS)
        placed = named.withColumns({"_g": F.pmod(F.xxhash64("layer"), F.lit(groups)).cast("int"), "tr": F.floor(F.col("row") / tile).cast("int"), "tc": F.floor(F.col("col") / tile).cast("int")})
        first = placed.groupBy(*at).agg(F.collect_list(F.struct("layer", "row", "col", "v")).alias("start"))
    none = F.lit(None)
    edges = "array<struct<dr:int,dc:int,layers:binary,v:binary>>"
    todo = first.withColumns({"edges": none.cast(edges), "layers": none.cast("binary"), "was": none.cast("binary")})

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of, out = [], []  # a batch for each tile: what is settled is many times what came
                cell = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                tr, tc = cell("tr"), cell("tc")
                g = np.frombuffer(cell("g")).reshape(tile + 2, tile + 2)
                known = ~np.isnan(g)
                ground = np.where(known, g, np.inf)
                start, came = cell("start"), cell("edges") or []
                held = np.frombuffer(cell("layers") or b"", dtype=np.int64)
                layers = np.unique(np.concatenate([held, *[np.frombuffer(e["layers"], dtype=np.int64) for e in came], np.array([s["layer"] for s in start or []], dtype=np.int64), np.zeros(int(start == []), dtype=np.int64)]))
                value = np.full((len(layers), tile + 2, tile + 2), np.inf)
                if len(held):
                    value[np.searchsorted(layers, held), 1:-1, 1:-1] = np.frombuffer(cell("was")).reshape(len(held), tile, tile)
                was = value[:, 1:-1, 1:-1].copy()
                for e in came:
                    rows, cols, own = beyond(e["dr"], tile), beyond(e["dc"], tile), np.frombuffer(e["layers"], dtype=np.int64)
                    value[np.searchsorted(layers, own), rows, cols] = np.frombuffer(e["v"]).reshape(len(own), rows.stop - rows.start, cols.stop - cols.start)
                if start == []:  # cells at the rim start with their ground
                    whole = np.ones((tile, tile), dtype=bool)
                    for dr, dc in AROUND:
                        whole &= known[1 + dr : 1 + dr + tile, 1 + dc : 1 + dc + tile]
                    value[0, 1:-1, 1:-1] = np.where(known[1:-1, 1:-1] & ~whole, g[1:-1, 1:-1], np.inf)
                for s in start or []:
                    r, c, k = s["row"] - tr * tile + 1, s["col"] - tc * tile + 1, np.searchsorted(layers, s["layer"])
                    if known[r, c]:
                        value[k, r, c] = min(value[k, r, c], s["v"])
                spread(value, ground, offer)
                now = value[:, 1:-1, 1:-1]
                of.append(i)
                out.append((tr, tc, 0, 0, layers.tobytes(), now.tobytes()))
                for dr, dc in AROUND:
                    part = (slice(None), edge(dr, tile), edge(dc, tile))
                    fell = (now[part] < was[part]).any(axis=(1, 2))
                    if fell.any():
                        of.append(i)
                        out.append((tr + dr, tc + dc, dr, dc, layers[fell].tobytes(), now[part][fell].tobytes()))
                own = [batch.column(k).take(pa.array(of, pa.int64())) for k in (*keys, "_g")]
                told = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(own + [pa.array(list(x), k) for x, k in zip(told, [*[pa.int32()] * 4, *[pa.binary()] * 2], strict=True)], [*at, "dr", "dc", "layers", "v"])

    tables: list[DataFrame] = []

    def latest(of: DataFrame | None = None) -> DataFrame:
        every = reduce(DataFrame.unionByName, [t.select(*at, "layers", "v", F.lit(n).alias("_n")) for n, t in enumerate(tables)])
        every = every if of is None else every.join(of, at, "left_semi")
        return every.groupBy(*at).agg(F.max_by(F.struct("layers", "v"), "_n").alias("t")).select(*at, "t.layers", "t.v")

    while True:
        met = todo.join(grounds.hint("merge"), [*keys, "tr", "tc"])  # grows with the grid: not through the driver
        met = met.select(*at, "start", "edges", "layers", "was", "g")
        found = cut(dealt(met, *at).mapInArrow(settle, head + "dr int, dc int, layers binary, v binary"))
        tables.append(found.where("dr = 0 and dc = 0"))
        if len(tables) > TABLES:
            tables = [cut(latest())]
        sent = found.where("dr <> 0 or dc <> 0")
        if sent.isEmpty():
            break
        todo = sent.groupBy(*at).agg(F.collect_list(F.struct("dr", "dc", "layers", "v")).alias("edges"))  # eight edges at most
        todo = todo.join(latest(sent.select(*at).distinct()).withColumnRenamed("v", "was").hint("merge"), at, "left").withColumn("start", none.cast("array<struct<layer:bigint,row:int,col:int,v:double>>"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                layers = np.frombuffer(batch.column("layers")[i].as_py(), dtype=np.int64)
                value = np.frombuffer(batch.column("v")[i].as_py()).reshape(len(layers), tile, tile)
                k, r, c = np.nonzero(np.isfinite(value))
                own = [batch.column(x).take(pa.array(np.full(len(k), i))) for x in keys]
                at_ = [pa.array(x.astype(np.int32)) for x in (r + batch.column("tr")[i].as_py() * tile, c + batch.column("tc")[i].as_py() * tile)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(layers[k]), *at_, pa.array(value[k, r, c])], [*keys, "_layer", "row", "col", "v"])

    cells = latest().select(*keys, "tr", "tc", "layers", "v").mapInArrow(unpack, "".join(f"{k} {kinds[k]}, " for k in keys) + "_layer long, row int, col int, v double")
    return cells.withColumnRenamed("_layer", layer) if layer else cells.drop("_layer")
