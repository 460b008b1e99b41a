"""Vector operators on edge tables: nearest joins, distance semi-joins, burning into grids, areas and centroids.

A feature is rows of (id, x1, y1, x2, y2): its ring or line segments; a point is a segment of no length. Joins are
equi-joins on square buckets with an exact test after, never inequality joins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbergrid.functions import geodesy
from timbergrid.operators.checkpoints import cut


@dataclass(frozen=True)
class Grid:
    """Rows count southwards from ``y_max``, columns eastwards from ``x_min``."""

    x_min: float
    y_max: float
    res: float
    n_rows: int
    n_cols: int

    def col(self, x: Column) -> Column:
        return F.floor((x - self.x_min) / self.res).cast("int")

    def row(self, y: Column) -> Column:
        return F.floor((self.y_max - y) / self.res).cast("int")

    def inside(self, row: Column, col: Column) -> Column:
        return row.between(0, self.n_rows - 1) & col.between(0, self.n_cols - 1)

    @property
    def cell_ha(self) -> float:
        return self.res * self.res / 1e4


def points(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(n) for c, n in ((x, "x1"), (y, "y1"), (x, "x2"), (y, "y2"))])


def _to_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> Column:
    """Squared distance of a point and a segment."""
    return F.expr(
        f"""pow({px} - {ax} - greatest(0D, least(1D, coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2), 0D), 0D))) * ({bx} - {ax}), 2)
          + pow({py} - {ay} - greatest(0D, least(1D, coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2), 0D), 0D))) * ({by} - {ay}), 2)"""
    )


def squared_distance() -> Column:
    """Of segments (x1, y1, x2, y2) and (u1, v1, u2, v2); 0 where they cross."""
    side = lambda ax, ay, bx, by, cx, cy: f"signum(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"
    cross = F.expr(f"{side('x1', 'y1', 'x2', 'y2', 'u1', 'v1')} * {side('x1', 'y1', 'x2', 'y2', 'u2', 'v2')} < 0 and {side('u1', 'v1', 'u2', 'v2', 'x1', 'y1')} * {side('u1', 'v1', 'u2', 'v2', 'x2', 'y2')} < 0")
    ends = [_to_segment("x1", "y1", "u1", "v1", "u2", "v2"), _to_segment("x2", "y2", "u1", "v1", "u2", "v2"), _to_segment("u1", "v1", "x1", "y1", "x2", "y2"), _to_segment("u2", "v2", "x1", "y1", "x2", "y2")]
    return F.when(cross, F.lit(0.0)).otherwise(F.least(*ends))


def _buckets(edges: DataFrame, size: float, reach: int) -> DataFrame:
    """A row for each bucket that an edge's box touches, ``reach`` buckets around."""
    at = lambda c: F.floor(F.col(c) / size)
    span = lambda a, b: F.sequence(F.least(at(a), at(b)) - reach, F.greatest(at(a), at(b)) + reach)
    return edges.withColumn("bx", F.explode(span("x1", "x2"))).withColumn("by", F.explode(span("y1", "y2")))


def within(left: DataFrame, right: DataFrame, distance: float) -> DataFrame:
    """(id, other, d2): for features within ``distance`` of each other, their squared distance."""
    a, b = _buckets(left, distance, 0), _buckets(right.select(F.col("id").alias("other"), F.col("x1").alias("u1"), F.col("y1").alias("v1"), F.col("x2").alias("u2"), F.col("y2").alias("v2")).withColumns({"x1": F.col("u1"), "y1": F.col("v1"), "x2": F.col("u2"), "y2": F.col("v2")}), distance, 1).drop("x1", "y1", "x2", "y2")
    met = a.join(b, ["bx", "by"]).withColumn("d2", squared_distance())
    return met.where(F.col("d2") <= distance * distance).groupBy("id", "other").agg(F.min("d2").alias("d2"))


def too_close(left: DataFrame, network: DataFrame, setback: float) -> DataFrame:
    """ids of left features with a network feature within the setback.

    The nearest one tells, so the work follows the left features, not the pairs within the setback. Which feature an edge
    is of doesn't matter, so each place's edge is one, however many features have it.
    """
    ends = ["x1", "y1", "x2", "y2"]
    each = network.select(*ends).distinct().select(F.struct(*ends).alias("id"), *ends)
    return nearest(left, each).where(F.col("d2") <= setback * setback).select("id")


def _boxes(edges: DataFrame, key: str) -> DataFrame:
    """(key, x_min, x_max, y_min, y_max, px, py): the box of every feature and one of its corners."""
    box = edges.groupBy(F.col("id").alias(key)).agg(F.min(F.least("x1", "x2")).alias("x_min"), F.max(F.greatest("x1", "x2")).alias("x_max"), F.min(F.least("y1", "y2")).alias("y_min"), F.max(F.greatest("y1", "y2")).alias("y_max"), F.min(F.struct("x1", "y1")).alias("p"))
    return box.select(key, "x_min", "x_max", "y_min", "y_max", F.col("p.x1").alias("px"), F.col("p.y1").alias("py"))


BOX = ("x_min", "x_max", "y_min", "y_max")


def _covered() -> list[Column]:
    return [F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max")]


def _apart(a: str, b: str) -> Column:
    """Squared distance of two boxes whose columns have these prefixes."""
    return F.expr("+".join(f"pow(greatest(0D, {a}{c}_min - {b}{c}_max, {b}{c}_min - {a}{c}_max), 2)" for c in "xy"))


def _farthest(a: str, b: str) -> Column:
    return F.expr("+".join(f"pow(greatest(abs({a}{c}_max - {b}{c}_min), abs({b}{c}_max - {a}{c}_min)), 2)" for c in "xy"))


def _near(bound: Column | str) -> Column:
    """A bound with room for what floating point may have lost."""
    return F.col(bound) * (1 + 1e-9) + 1e-9


def nearest(left: DataFrame, right: DataFrame, polygons: bool = False, levels: int | None = None) -> DataFrame:
    """(id, other, d2): the nearest right feature of every left one, the smallest id of equals; NULLs without any.

    Right features lie in a pyramid of buckets: a bucket has the box of the features that begin in it, a bucket of the next
    level those of four. Left features of one bucket go down the pyramid together; a bucket is left out that is farther
    than some other bucket's farthest corner. What is left at the bottom are few features for each left one: those whose
    boxes are nearer than the nearest known corner are measured edge by edge. So no left feature meets all right ones,
    however far away it is, and rounds grow with the logarithm of the right features' number.

    An edge with a NULL coordinate isn't there; a left feature without edges gets NULLs. With ``polygons`` both sides are
    closed rings, and one that holds the other is at distance 0. ``levels``: of the pyramid, else by the number of
    right features, four to a bucket of the lowest if they were even.
    """
    known = F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()
    ids, kind = left.select("id").distinct(), right.schema["id"].dataType
    left, right = left.where(known), right.where(known)
    boxes = cut(_boxes(right, "other"))
    whole = boxes.agg(*_covered(), F.count(F.lit(1)).alias("n")).first()
    if not whole["n"]:
        return ids.select("id", F.lit(None).cast(kind).alias("other"), F.lit(None).cast("double").alias("d2"))
    if levels is None:
        levels = max(1, math.ceil(math.log2(whole["n"]) / 2) - 1)
    size = max(whole["x_max"] - whole["x_min"], whole["y_max"] - whole["y_min"], 1e-9) / 2**levels
    at = lambda c, low: F.floor((F.col(c) - low) / size).cast("long")
    placed = boxes.withColumns({"bx": at("x_min", whole["x_min"]), "by": at("y_min", whole["y_min"])})
    lowest = placed.groupBy("bx", "by").agg(*_covered())
    up = lowest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumns({"bx": F.expr("shiftright(bx, level)"), "by": F.expr("shiftright(by, level)")})
    pyramid = cut(up.groupBy("level", "bx", "by").agg(*_covered()).select("level", "bx", "by", *[F.col(c).alias(f"r{c}") for c in BOX]))
    # Left features whose boxes span the same buckets walk together.
    features = _boxes(left, "id").withColumns({"k0": at("x_min", whole["x_min"]), "k1": at("x_max", whole["x_min"]), "k2": at("y_min", whole["y_min"]), "k3": at("y_max", whole["y_min"])})
    features = cut(features)
    group = ["k0", "k1", "k2", "k3"]
    walk = features.groupBy(*group).agg(*_covered())
    best = F.min("far").over(Window.partitionBy(*group))
    top = pyramid.where(F.col("level") == levels).drop("level")  # four buckets at most
    met = walk.join(F.broadcast(top))
    for level in range(levels, -1, -1):
        met = met.withColumns({"near": _apart("", "r"), "far": _farthest("", "r")}).withColumn("best", best).where(F.col("near") <= _near("best"))
        if level:
            above = cut(met.select(*group, *BOX, F.col("bx").alias("ux"), F.col("by").alias("uy")))
            below = pyramid.where(F.col("level") == level - 1).withColumns({"ux": F.shiftright("bx", 1), "uy": F.shiftright("by", 1)}).drop("level")
            met = above.join(below, ["ux", "uy"]).drop("ux", "uy")
    found = met.select(*group, "bx", "by")
    own = features.select("id", *group, *[F.col(c).alias(f"l{c}") for c in BOX], F.col("px").alias("lx"), F.col("py").alias("ly"))
    pairs = own.join(found, group).join(placed, ["bx", "by"])
    pairs = pairs.withColumns({"near": _apart("l", ""), "corner": F.expr("pow(lx - px, 2) + pow(ly - py, 2)")})
    pairs = pairs.withColumn("best", F.min("corner").over(Window.partitionBy("id"))).where(F.col("near") <= _near("best"))
    pairs = cut(pairs.select("id", "other", "near", "lx", "ly", "px", "py"))
    edges = lambda d, key: d.select(F.col("id").alias(key), F.col("x1").alias("u1"), F.col("y1").alias("v1"), F.col("x2").alias("u2"), F.col("y2").alias("v2"))
    ends = edges(right, "other")
    told = pairs.select("id", "other").join(left, "id").join(ends, "other").groupBy("id", "other").agg(F.min(squared_distance()).alias("d2"))
    if polygons:
        # A feature that crosses no edge of a polygon is in it if one of its corners is.
        boxed = pairs.where("near = 0")
        crossed = lambda x, y: F.count_if(F.expr(f"(v1 > {y}) <> (v2 > {y}) and {x} < u1 + ({y} - v1) * (u2 - u1) / (v2 - v1)")) % 2 == 1
        in_right = boxed.join(ends, "other").groupBy("id", "other").agg(crossed("lx", "ly").alias("held"))
        in_left = boxed.join(edges(left, "id"), "id").groupBy("id", "other").agg(crossed("px", "py").alias("held"))
        held = in_right.unionByName(in_left).where("held").select("id", "other", F.lit(0.0).alias("d2"))
        told = told.unionByName(held)
    nearest_ = told.groupBy("id").agg(F.min(F.struct("d2", "other")).alias("b")).select("id", "b.other", "b.d2")
    return ids.join(nearest_, "id", "left")


def burned(edges: DataFrame, grid: Grid) -> DataFrame:
    """(id, row, col): cells whose centre lies in the polygon, by scan lines.

    An edge gives its crossing with each row's centre line; sorted crossings of a polygon and row pair up to intervals
    of columns. So the work follows the perimeter and the result, not polygons times cells.
    """
    centre = lambda row: F.lit(grid.y_max) - (row + 0.5) * grid.res
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(F.floor((grid.y_max - high) / grid.res - 0.5) + 1, F.lit(0)).cast("int")
    last = F.least(F.floor((grid.y_max - low) / grid.res - 0.5), F.lit(grid.n_rows - 1)).cast("int")
    rows = edges.where("y1 <> y2").withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("row", F.explode(F.sequence("_first", "_last")))
    x = F.col("x1") + (centre(F.col("row")) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    lines = rows.select("id", "row", x.alias("x")).groupBy("id", "row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get(F.col("xs"), 2 * i).alias("a"), F.get(F.col("xs"), 2 * i + 1).alias("b")))
    spans = lines.where(F.size("xs") >= 2).select("id", "row", F.explode(pairs).alias("p"))
    begin = F.greatest(F.ceil((F.col("p.a") - grid.x_min) / grid.res - 0.5), F.lit(0)).cast("int")
    end = F.least(F.ceil((F.col("p.b") - grid.x_min) / grid.res - 0.5) - 1, F.lit(grid.n_cols - 1)).cast("int")
    return spans.withColumns({"_a": begin, "_b": end}).where("_a <= _b").select("id", "row", F.explode(F.sequence("_a", "_b")).alias("col"))


def coverage(edges: DataFrame, grid: Grid) -> DataFrame:
    return burned(edges, grid).select("row", "col").distinct()


def burn_last(edges: DataFrame, grid: Grid, values: DataFrame) -> DataFrame:
    """(row, col, value): of polygons over a cell the one with the largest id that has a value wins; ``values``: id, value."""
    cells = burned(edges, grid).join(values.where("value is not null"), "id")
    return cells.groupBy("row", "col").agg(F.max_by("value", "id").alias("value"))


def labels(edges: DataFrame, grid: Grid) -> DataFrame:
    return burned(edges, grid).groupBy("row", "col").agg(F.max("id").alias("label"))


def touched(lines: DataFrame, grid: Grid) -> DataFrame:
    """(row, col): every cell that a segment passes through, row by row of the grid."""
    y = lambda c: (grid.y_max - F.col(c)) / grid.res
    x = lambda c: (F.col(c) - grid.x_min) / grid.res
    s = lines.select(x("x1").alias("ax"), y("y1").alias("ay"), x("x2").alias("bx"), y("y2").alias("by"))
    s = s.select(*[F.when(F.col("ay") <= F.col("by"), F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("ax", "bx", "ax"), ("ay", "by", "ay"), ("bx", "ax", "bx"), ("by", "ay", "by"))])
    low, high = F.greatest(F.floor("ay"), F.lit(0)).cast("int"), F.least(F.floor("by"), F.lit(grid.n_rows - 1)).cast("int")
    rows = s.withColumns({"_a": low, "_b": high}).where("_a <= _b").withColumn("row", F.explode(F.sequence("_a", "_b")))
    at = lambda yy: F.when(F.col("ay") == F.col("by"), F.col("ax")).otherwise(F.col("ax") + (yy - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    enter, leave = at(F.greatest(F.col("row").cast("double"), F.col("ay"))), F.when(F.col("ay") == F.col("by"), F.col("bx")).otherwise(at(F.least(F.col("row") + 1.0, F.col("by"))))
    rows = rows.withColumns({"_c": F.greatest(F.floor(F.least(enter, leave)), F.lit(0)).cast("int"), "_d": F.least(F.floor(F.greatest(enter, leave)), F.lit(grid.n_cols - 1)).cast("int")})
    return rows.where("_c <= _d").select("row", F.explode(F.sequence("_c", "_d")).alias("col")).distinct()


def measures(edges: DataFrame) -> DataFrame:
    """(id, area, cx, cy): shoelace sums of closed rings; holes run the other way round."""
    cross = F.expr("x1 * y2 - x2 * y1")
    sums = edges.groupBy("id").agg(F.sum(cross).alias("s"), F.sum(F.expr("(x1 + x2)") * cross).alias("sx"), F.sum(F.expr("(y1 + y2)") * cross).alias("sy"))
    return sums.select("id", (F.abs("s") / 2).alias("area"), F.try_divide("sx", 3 * F.col("s")).alias("cx"), F.try_divide("sy", 3 * F.col("s")).alias("cy"))


def sampled(pts: DataFrame, cells: DataFrame, grid: Grid, bands: list[str], scale: float = 1.0, nodata: float | None = None, index_mode: str = "floor") -> DataFrame:
    """Points (x, y) with the bands of their cell; outside the grid and at nodata they are NULL.

    ``index_mode="round"`` rounds the fractional index half-even, which moves samples by half a cell.
    """
    if index_mode == "round":
        row, col = F.bround((grid.y_max - F.col("y")) / grid.res, 0).cast("int"), F.bround((F.col("x") - grid.x_min) / grid.res, 0).cast("int")
    else:
        row, col = grid.row(F.col("y")), grid.col(F.col("x"))
    told = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), *[(F.when(F.col(b) != nodata, F.col(b)) if nodata is not None else F.col(b)).alias(b) for b in bands])
    met = pts.withColumns({"_row": row, "_col": col}).join(told, (F.col("_row") == F.col("_r")) & (F.col("_col") == F.col("_c")), "left")
    return met.withColumns({b: F.col(b) * scale for b in bands}).drop("_row", "_col", "_r", "_c")


def inside_area(df: DataFrame, x_min: float, y_min: float, x_max: float, y_max: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.where(F.col(x).between(x_min, x_max) & F.col(y).between(y_min, y_max))


def sheets_for_box(sheets: DataFrame, x_min: float, y_min: float, x_max: float, y_max: float) -> DataFrame:
    """Codes of the map sheets that meet a box, sorted; ``sheets``: code and its box."""
    meets = (F.col("x_max") >= x_min) & (F.col("x_min") <= x_max) & (F.col("y_max") >= y_min) & (F.col("y_min") <= y_max)
    return sheets.where(meets).select("code").distinct().orderBy("code")


def stations_near(stations: DataFrame, west: float, south: float, east: float, north: float, most_km: float = 40.0) -> DataFrame:
    """Stations within a distance, on the ellipsoid, of a box of degrees, nearest first."""
    lon, lat = F.greatest(F.lit(west), F.least(F.lit(east), F.col("lon"))), F.greatest(F.lit(south), F.least(F.lit(north), F.col("lat")))
    rows = stations.dropDuplicates(["fmisid"]).withColumn("km", geodesy.distance_m(F.col("lon"), F.col("lat"), lon, lat) / 1000)
    return rows.where(F.col("km") <= most_km).orderBy("km", "fmisid")


def box_degrees(areas: DataFrame) -> DataFrame:
    """``areas`` (x_min, y_min, x_max, y_max in metres) with west, south, east, north: the degrees of two opposite corners."""
    corner = lambda n: geodesy.from_plane(F.col(f"x_{n}"), F.col(f"y_{n}"))
    (lon0, lat0), (lon1, lat1) = corner("min"), corner("max")
    return areas.withColumns({"west": F.least(lon0, lon1), "south": F.least(lat0, lat1), "east": F.greatest(lon0, lon1), "north": F.greatest(lat0, lat1)})


def first_of_tiles(cells: DataFrame) -> DataFrame:
    """A mosaic: of overlapping tiles the first wins; ``cells``: tile_seq, row, col, value."""
    return cells.groupBy("row", "col").agg(F.min_by("value", "tile_seq").alias("value"))
