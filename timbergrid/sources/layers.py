"""Reading the analyses' inputs: checked schemas, box and key filters that reach the scan, paged services, tile plans."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from timbergrid.plans.config import Area

#: Columns of each layer.
SCHEMAS = {
    "stand": "stand_row long, standid string, area double, soiltype string, fertilityclass string, drainagestate string, proportionpine double, proportionspruce double, meanage double, basalarea double, x double, y double",
    "forestusedeclaration": "DECLARATIONARRIVALDATE string, SOILTYPE string, x double, y double",
    "habitat": "habitat_id long, habitattype string, x double, y double",
    "weather": "station long, date date, param string, value string",
}
MSNFI_NODATA = (32766, 32767)
DTW_THRESHOLDS_HA = (0.5, 1.0, 2.0, 4.0, 10.0)


def layer(spark: SparkSession, root: str, key: str, area: Area | None = None) -> DataFrame:
    """A Parquet layer under its own schema; the box is a plain comparison, so it is pushed to the scan."""
    if key not in SCHEMAS:
        raise KeyError(key)
    rows = spark.read.schema(SCHEMAS[key]).parquet(f"{root}/{key}")
    if area is None or "x double" not in SCHEMAS[key]:
        return rows
    return rows.where(F.col("x").between(area.x_min, area.x_max) & F.col("y").between(area.y_min, area.y_max))


#: Themes of the topographic database, and the work code of environmental support.
THEMES = {"streams": "virtavesikapea", "rivers": "virtavesialue"}
SUPPORT_WORK = 641


def features(spark: SparkSession, path: str, area: Area | None = None) -> DataFrame:
    """Edges of ``sinks.write_features`` whose box meets an area; the comparisons reach the scan, which skips row groups."""
    rows = spark.read.parquet(path)
    if area is not None:
        rows = rows.where((F.col("x_max") >= area.x_min) & (F.col("x_min") <= area.x_max) & (F.col("y_max") >= area.y_min) & (F.col("y_min") <= area.y_max))
    return rows.drop("x_min", "x_max", "y_min", "y_max")


def topographic(spark: SparkSession, root: str, theme: str, area: Area | None = None) -> DataFrame:
    """Edges of a theme of the topographic database; an unknown theme is an error, not an empty table."""
    if theme not in THEMES:
        raise KeyError(f"{theme!r} is none of {sorted(THEMES)}")
    return features(spark, f"{root}/{THEMES[theme]}", area)


def environmental_support(spark: SparkSession, path: str, area: Area | None = None) -> DataFrame:
    """Edges of stands under environmental support: those of its work code, of any kind of management."""
    return features(spark, path, area).where((F.col("workcode") == SUPPORT_WORK) & F.col("environmentmanagementtype").isNotNull())


def catchment(spark: SparkSession, path: str, identifier: str, level: str = "taso4") -> DataFrame:
    fields = {"taso4": "taso4_id", "taso5": "taso5_id"}
    rows = spark.read.parquet(path).where(F.col(fields[level]) == identifier)
    if rows.isEmpty():
        raise RuntimeError(f"no catchment {identifier} on level {level}")
    return rows


def protected_areas(layers: Mapping[str, DataFrame | None]) -> DataFrame:
    """All layers together with their name in ``pa_source``; missing ones are skipped, and without any there are no rows."""
    found = [d.withColumn("pa_source", F.lit(name)) for name, d in layers.items() if d is not None]
    return reduce(DataFrame.unionByName, found) if found else SparkSession.active().createDataFrame([], "x double, y double, pa_source string")


def nodes(protected: DataFrame, habitats: DataFrame, support: DataFrame, stands: DataFrame, old_age: float = 120) -> DataFrame:
    """(node_type, x, y) of protected areas by source, habitats, supported stands and stands old enough."""
    at = lambda d, kind: d.select(kind.alias("node_type"), "x", "y")
    old = stands.where(F.col("meanage") >= old_age)
    parts = [at(protected, F.concat(F.lit("pa_"), "pa_source")), at(habitats, F.lit("habitat_s10")), at(support, F.lit("ymparistotuki")), at(old, F.lit("old_stand"))]
    return reduce(DataFrame.unionByName, parts)


def tile_plan(spark: SparkSession, area: Area, tile_m: float) -> DataFrame:
    """(tile_seq, x_min, y_min, x_max, y_max): tiles over an area, clipped at its edge."""
    n_x, n_y = math.ceil((area.x_max - area.x_min) / tile_m), math.ceil((area.y_max - area.y_min) / tile_m)
    seq = F.col("id")
    x, y = F.lit(area.x_min) + (seq % n_x) * tile_m, F.lit(area.y_min) + F.floor(seq / n_x) * tile_m
    return spark.range(n_x * n_y).select(seq.alias("tile_seq"), x.alias("x_min"), y.alias("y_min"), F.least(x + tile_m, F.lit(area.x_max)).alias("x_max"), F.least(y + tile_m, F.lit(area.y_max)).alias("y_max"))


def tiles_to_cells(tiles: DataFrame, tile_rows: int, tile_cols: int) -> DataFrame:
    """Tile rows (tile_r, tile_c, data: array, valid: array) to valid cells (row, col, value)."""
    each = tiles.select("tile_r", "tile_c", F.posexplode(F.arrays_zip("data", "valid")).alias("k", "v")).where("v.valid")
    return each.select((F.col("tile_r") * tile_rows + F.floor(F.col("k") / tile_cols)).cast("int").alias("row"), (F.col("tile_c") * tile_cols + F.col("k") % tile_cols).cast("int").alias("col"), F.col("v.data").alias("value"))


def with_nodata_kind(cells: DataFrame, value: str = "value") -> DataFrame:
    """Both codes stay in ``value``; ``nodata_kind`` tells them apart, NULL for data."""
    return cells.withColumn("nodata_kind", F.when(F.col(value).isin(*MSNFI_NODATA), F.col(value).cast("int")))


def dtw_metres(cells: DataFrame, value: str = "value") -> DataFrame:
    return cells.where(F.col(value) != 32767).withColumn(value, F.col(value) * 0.01)


def check_dtw_request(threshold_ha: float, year: int) -> None:
    if threshold_ha not in DTW_THRESHOLDS_HA:
        raise KeyError(threshold_ha)
    if year != 2023:
        raise NotImplementedError(f"year {year}")


def check_dem_request(area: Area, resolution_m: float, most_km2: float = 100.0) -> None:
    if resolution_m != 2:
        raise NotImplementedError(f"{resolution_m} m")
    if area.km2 > most_km2:
        raise ValueError(f"{area.km2:.1f} km2 is more than {most_km2:g}")


@dataclass
class Page(InputPartition):
    tile: int
    box: tuple[float, float, float, float]


class FeaturePages(DataSource):
    """A paged feature service as a batch source: one partition for each tile of the box, pages within it.

    Options: ``fetch`` ("module:function" that takes url, box, start, count and gives GeoJSON-like features), ``url``,
    ``box`` (four numbers, comma-separated), ``tile`` (metres), ``page`` (features), ``tries``. A tile keeps the features
    whose point lies in it, edges to the lower tile left out, so none comes twice.
    """

    @classmethod
    def name(cls) -> str:
        return "feature_pages"

    def schema(self) -> str:
        return self.options.get("schema", "id long, x double, y double, properties string")

    def reader(self, schema) -> FeatureReader:
        return FeatureReader(dict(self.options))


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.page, self.tries = int(options.get("page", 10_000)), int(options.get("tries", 3))

    def partitions(self) -> Sequence[Page]:
        x0, y0, x1, y1 = map(float, self.options["box"].split(","))
        tile = float(self.options.get("tile", 10_000))
        boxes = [(x, y) for y in _steps(y0, y1, tile) for x in _steps(x0, x1, tile)]
        return [Page(i, (x, y, min(x + tile, x1), min(y + tile, y1))) for i, (x, y) in enumerate(boxes)]

    def _fetch(self) -> Callable:
        import importlib

        module, _, function = self.options["fetch"].partition(":")
        return getattr(importlib.import_module(module), function)

    def read(self, partition: Page) -> Iterator[tuple]:
        x0, y0, x1, y1 = partition.box
        outer = tuple(map(float, self.options["box"].split(",")))
        fetch, start = self._fetch(), 0
        while True:
            for attempt in range(1, self.tries + 1):
                try:
                    found = fetch(self.options.get("url", ""), partition.box, start, self.page)
                    break
                except OSError:
                    if attempt == self.tries:
                        raise
                    time.sleep(2 * attempt)
            for f in found:
                x, y = f["x"], f["y"]
                if x0 <= x and y0 <= y and (x < x1 or x == x1 == outer[2]) and (y < y1 or y == y1 == outer[3]):
                    yield f["id"], float(x), float(y), json.dumps(f.get("properties", {}), sort_keys=True)
            if len(found) < self.page:
                return
            start += self.page


def _steps(low: float, high: float, step: float) -> list[float]:
    return [low + k * step for k in range(math.ceil((high - low) / step))]
