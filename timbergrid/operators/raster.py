"""Grid operators on cell tables (row, col, bands): distance, buffers, slope, resampling, erosion, map algebra."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbergrid.functions import rules as R
from timbergrid.operators.spatial import Grid, burned
from timbergrid.operators.stats import quantiles


def stream_cells(cells: DataFrame, band: str = "stream", nodata: float = -32768.0) -> DataFrame:
    v = F.col(band).cast("double")
    return cells.where(R.holds((v > 0) & ~F.isnan(v) & (v < float("inf")) & (v != nodata))).select("row", "col")


def distance_within(features: DataFrame, reach_cells: float, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """(row, col, d2): cells within a reach of a feature cell, with the least squared distance in cells.

    Done in two passes of one axis each: least distance along the column, then the least sum of squares along the row;
    a feature cell is copied to 2 * reach + 1 cells each time instead of to a disc of them.
    """
    r = math.floor(reach_cells)
    offsets = F.array(*[F.lit(d) for d in range(-r, r + 1)])
    down = features.select("row", "col").distinct().select("col", "row", F.explode(offsets).alias("d"))
    down = down.groupBy("col", (F.col("row") + F.col("d")).alias("row")).agg(F.min(F.col("d") * F.col("d")).alias("g"))
    across = down.select("row", "col", "g", F.explode(offsets).alias("d")).where(F.col("g") + F.col("d") * F.col("d") <= reach_cells * reach_cells)
    out = across.groupBy("row", (F.col("col") + F.col("d")).alias("col")).agg(F.min(F.col("g") + F.col("d") * F.col("d")).alias("d2"))
    if n_rows is not None:
        out = out.where(F.col("row").between(0, n_rows - 1))
    return out if n_cols is None else out.where(F.col("col").between(0, n_cols - 1))


def distance_everywhere(features: DataFrame, grid: Grid) -> DataFrame:
    """(row, col, d2) for every cell of the grid; NULL everywhere without features. Exact, whatever the distance.

    Column by column the nearest feature row, then row by row the lower envelope of the columns' parabolas.
    """
    here = features.select("row", "col").distinct().withColumn("f", F.col("row"))
    columns = features.select("col").distinct()  # a column without features bounds nothing
    dense = columns.select("col", F.explode(F.sequence(F.lit(0), F.lit(grid.n_rows - 1))).alias("row"))
    dense = dense.join(here, ["row", "col"], "left")
    up = Window.partitionBy("col").orderBy("row")
    above = F.last("f", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first("f", ignorenulls=True).over(up.rowsBetween(0, Window.unboundedFollowing))
    g = F.least(F.col("row") - above, below - F.col("row"))
    n_cols = grid.n_cols

    def envelope(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("col")
        at, height = group["col"].to_numpy(dtype=np.int64), group["g"].to_numpy(dtype=np.int64) ** 2
        hull: list[int] = []
        starts: list[float] = []
        for i in range(len(at)):
            s = -math.inf
            while hull:
                j = hull[-1]
                s = (height[i] + at[i] ** 2 - height[j] - at[j] ** 2) / (2 * (at[i] - at[j]))
                if s > starts[-1]:
                    break
                hull.pop()
                starts.pop()
            if not hull:
                s = -math.inf
            hull.append(i)
            starts.append(s)
        cols = np.arange(n_cols)
        owner = np.asarray(hull)[np.searchsorted(np.asarray(starts), cols, side="left") - 1]
        return pd.DataFrame({"row": key[0], "col": cols, "d2": (cols - at[owner]) ** 2 + height[owner]})

    rows = dense.select("row", "col", g.alias("g"))
    return rows.groupBy("row").applyInPandas(envelope, "row int, col int, d2 long")


def buffer_report(derived: DataFrame, mapped: DataFrame, grid: Grid, widths: Sequence[float]) -> DataFrame:
    """Per width: hectares within it of derived streams, of mapped ones, and of derived ones alone."""
    reach = max(widths) / grid.res
    by = lambda f, name: distance_within(f, reach, grid.n_rows, grid.n_cols).withColumnRenamed("d2", name)
    both = by(derived, "a").join(by(mapped, "b"), ["row", "col"], "full")
    each = both.withColumn("width", F.explode(F.array(*[F.lit(float(w)) for w in widths])))
    near = lambda c: R.holds(F.col(c) * (grid.res * grid.res) <= F.col("width") * F.col("width"))
    ha = lambda when: F.bround(F.count_if(when) * grid.cell_ha, 1)
    return each.groupBy("width").agg(ha(near("a")).alias("derived_ha"), ha(near("b")).alias("mapped_ha"), ha(near("a") & ~near("b")).alias("additional_ha"))


def slope_degrees(dem: DataFrame, res: float, z: str = "z") -> DataFrame:
    """(row, col, slope_deg): central differences, one-sided at edges; 0 where a neighbour's height is missing."""
    along, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")

    def gradient(w, at: str) -> Column:
        before, after = F.lag(z).over(w), F.lead(z).over(w)
        first, last = F.lag(at).over(w).isNull(), F.lead(at).over(w).isNull()
        return F.when(first & last, F.lit(0.0)).when(first, (after - F.col(z)) / res).when(last, (F.col(z) - before) / res).otherwise((after - before) / (2 * res))

    rows = dem.withColumn("gx", gradient(along, "col")).withColumn("gy", gradient(down, "row"))
    return rows.select("row", "col", F.coalesce(F.degrees(F.atan(F.hypot("gx", "gy"))), F.lit(0.0)).alias("slope_deg"))


def block_mean(cells: DataFrame, factor: int, value: str = "value") -> DataFrame:
    """Mean of the valid cells of blocks of factor x factor; a block without any is NULL."""
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return cells.groupBy(block("row"), block("col")).agg(F.avg(value).alias(value))


def resample(cells: DataFrame, res: float, target: float, value: str = "value") -> DataFrame:
    if target < res:
        raise ValueError("the target is finer than the source")
    if not math.isclose(target / res, round(target / res)):
        raise ValueError("the target isn't a multiple of the source")
    return block_mean(cells, round(target / res), value)


def coarsened(cost: DataFrame, factor: int, n_rows: int, n_cols: int, water: float = 1000.0, value: str = "cost", by: Sequence[str] = ()) -> DataFrame:
    """Block means of whole blocks; above half the water value a block is water, and no block is below 0.001."""
    whole = cost.where((F.col("row") < n_rows // factor * factor) & (F.col("col") < n_cols // factor * factor))
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    mean = whole.groupBy(*by, block("row"), block("col")).agg(F.avg(value).alias(value))
    return mean.withColumn(value, F.when(F.col(value) > water / 2, F.lit(water)).otherwise(F.greatest(F.col(value), F.lit(1e-3))))


def aligned(source: DataFrame, source_grid: Grid, target_grid: Grid, band: str, missing: float = 0.0) -> DataFrame:
    """(row, col, band) of the target grid: the source cell under each target centre; outside it is ``missing``.

    Only centres that fall on the source are generated from it; the rest of the target is filled.
    """
    rows = F.explode(F.sequence(F.lit(0), F.lit(target_grid.n_rows - 1)))
    target = source.sparkSession.range(1).select(rows.alias("row")).repartition("row").withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(target_grid.n_cols - 1))))
    x = F.lit(target_grid.x_min) + (F.col("col") + 0.5) * target_grid.res
    y = F.lit(target_grid.y_max) - (F.col("row") + 0.5) * target_grid.res
    told = source.select(F.col("row").alias("_sr"), F.col("col").alias("_sc"), band)
    met = target.withColumns({"_r": source_grid.row(y), "_c": source_grid.col(x)}).join(told, (F.col("_r") == F.col("_sr")) & (F.col("_c") == F.col("_sc")), "left")
    return met.select("row", "col", F.coalesce(band, F.lit(missing)).alias(band))


def soil_loss(cells: DataFrame, res: float, k_table: Mapping[int, float], c_table: Mapping[int, float], r_factor: float, k_default: float = 0.025, c_default: float = 0.01) -> DataFrame:
    """One wide cell table (accum_cells, slope_deg, soil, clc) to LS, K, C and A: no join."""
    c = F.col
    rows = cells.withColumns({"ls": R.ls_factor(c("accum_cells"), c("slope_deg"), res), "k": R.looked_up(c("soil"), k_table, k_default), "c": R.looked_up(c("clc"), c_table, c_default)})
    return rows.withColumn("a", R.soil_loss(c("ls"), c("k"), c("c"), r_factor))


def erosion_in_buffers(loss: DataFrame, streams: DataFrame, grid: Grid, widths: Sequence[float], pct: float = 0.9) -> DataFrame:
    """Per width: buffer hectares, those of high erosion, and their share. High: at or above the percentile of a > 0."""
    bound = quantiles(loss.where("a > 0"), "a", [pct]).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("bound"))  # one row
    near = distance_within(streams, max(widths) / grid.res, grid.n_rows, grid.n_cols)
    rows = loss.where("a is not null").join(near, ["row", "col"], "right").join(F.broadcast(bound))
    each = rows.withColumn("width", F.explode(F.array(*[F.lit(float(w)) for w in widths]))).where(F.col("d2") * (grid.res * grid.res) <= F.col("width") * F.col("width"))
    high = F.count_if(R.holds(F.col("a") >= F.col("bound")))
    n = F.count(F.lit(1))
    return each.groupBy("width").agg(F.bround(n * grid.cell_ha, 1).alias("buffer_ha"), F.bround(high * grid.cell_ha, 1).alias("high_ha"), F.bround(high / F.greatest(n, F.lit(1)), 3).alias("high_share"))


def resistance_surface(cells: DataFrame, settings: DataFrame | None = None, cfg=None) -> DataFrame:
    """Cells (row, col, clc, meanage, basalarea, proportionother) to ``cost`` under one setting."""
    cfg = cfg or R.Resistance()
    cover = R.land_cover_term(F.col("clc"), cfg)
    w = cfg.weights
    stand = lambda column, reference: R.stand_term(R.number(F.col(column)), reference, cover)
    terms = [(w["age"], stand("meanage", cfg.age_cap)), (w["structure"], stand("basalarea", cfg.basal_area_cap)), (w["species"], stand("proportionother", cfg.deciduous_share)), (w["landcover"], cover)]
    return cells.withColumn("cost", R.resistance(terms, F.col("clc"), cfg))


def clipped(cells: DataFrame, edges: DataFrame, grid: Grid) -> DataFrame:
    """The cells whose centre lies in one of the polygons, holes left out."""
    return cells.join(burned(edges, grid).select("row", "col").distinct(), ["row", "col"], "left_semi")


def stand_bands(edges: DataFrame, stands: DataFrame, grid: Grid, attributes: Sequence[str]) -> DataFrame:
    """(row, col, attributes): each attribute burned from the stands' polygons; over a cell the last stand with a value wins.

    ``edges``: id and rings; ``stands``: id and the attributes, numbers or texts; what is no number is no value.
    Polygons are burned once for all attributes, which meet in one grouping.
    """
    told = stands.select("id", *[R.number(F.col(a)).alias(a) for a in attributes])
    cells = burned(edges, grid).join(told, "id")
    return cells.groupBy("row", "col").agg(*[F.max_by(a, F.when(F.col(a).isNotNull(), F.col("id"))).alias(a) for a in attributes])


def stand_resistance(edges: DataFrame, stands: DataFrame, land_cover: DataFrame, cover_grid: Grid, grid: Grid, cfg=None) -> DataFrame:
    """(row, col, clc, cost) of every cell of a grid: land cover brought to it, stand attributes burned onto it.

    Cells off all stands, and attributes without a value, fall back to the land cover's term.
    """
    bands = stand_bands(edges, stands, grid, ["meanage", "basalarea", "proportionother"])
    cover = aligned(land_cover, cover_grid, grid, "clc")
    return resistance_surface(cover.join(bands, ["row", "col"], "left"), cfg=cfg).select("row", "col", "clc", "cost")


def valid_pixel_stats(cells: DataFrame, value: str = "value", nodata: Sequence[float] = (32766, 32767)) -> DataFrame:
    valid = cells.where(~F.col(value).isin(*[float(x) for x in nodata]))
    told = valid.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))
    return told.join(quantiles(valid, value, [0.5]).select(F.col("value").alias("median")), how="left").select("min", "median", "max", "n")  # one row each
