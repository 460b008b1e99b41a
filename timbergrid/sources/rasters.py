"""Rasters in tiles: a source that opens only the tiles of a window, and a store that is written whole or not at all.

Tiles are arrays of one band. A sheet list tells which cells each covers; comparisons of row, col and sheet in a query
narrow it before anything is opened, as does the ``window`` option. Spark asks for ``spark.sql.python.filterPushdown.enabled``
where a source takes filters; ``read_sheets`` turns it on, which other sources don't notice.
"""

from __future__ import annotations

import hashlib
import io
import json
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from importlib import import_module
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from timbergrid.operators.checkpoints import ship


@dataclass
class Sheet(InputPartition):
    """A tile: its code, and the cells that it covers (from row and col on). Without a code there is nothing to read."""

    code: str | None
    row: int
    col: int
    rows: int
    cols: int


class RasterTiles(DataSource):
    """Cells (sheet, row, col, value) of a tiled raster; NaN cells aren't there.

    Options: ``sheets`` (JSON list of code, row, col, rows, cols), ``fetch`` ("module:function" that takes url and code and
    gives an array of the sheet, or None where the service has no such sheet), ``url``, ``window`` (least and largest row
    and col, comma-separated), ``tries``.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_tiles"

    def schema(self) -> str:
        return "sheet string, row int, col int, value double"

    def reader(self, schema) -> TileReader:
        return TileReader(dict(self.options))


class TileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.tries = options, int(options.get("tries", 3))
        r0, r1, c0, c1 = map(int, options["window"].split(",")) if options.get("window") else (-(2**31), 2**31, -(2**31), 2**31)
        self.least, self.most, self.codes = {"row": r0, "col": c0}, {"row": r1, "col": c1}, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrow the window and the sheets; all filters stay with Spark, as tiles hold other cells too."""
        for f in filters:
            at = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if at == "sheet" and isinstance(f, EqualTo | In):
                told = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.codes = told if self.codes is None else self.codes & told
            elif at in self.least:
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.least[at] = max(self.least[at], f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.most[at] = min(self.most[at], f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> Sequence[Sheet]:
        sheets = [Sheet(*s) for s in json.loads(self.options["sheets"])]
        met = lambda first, n, at: first <= self.most[at] and first + n - 1 >= self.least[at]
        kept = [s for s in sheets if (self.codes is None or s.code in self.codes) and met(s.row, s.rows, "row") and met(s.col, s.cols, "col")]
        return kept or [Sheet(None, 0, 0, 0, 0)]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        if partition.code is None:
            return
        module, _, function = self.options["fetch"].partition(":")
        fetch, data = getattr(import_module(module), function), None
        for attempt in range(1, self.tries + 1):
            try:
                data = fetch(self.options.get("url", ""), partition.code)
                break
            except OSError:
                if attempt == self.tries:
                    raise
                time.sleep(2 * attempt)
        if data is None:
            return
        part = np.asarray(data, dtype=np.float64)[: partition.rows, : partition.cols]
        r, c = np.nonzero(~np.isnan(part))
        rows, cols = r + partition.row, c + partition.col
        inside = (rows >= self.least["row"]) & (rows <= self.most["row"]) & (cols >= self.least["col"]) & (cols <= self.most["col"])
        rows, cols, values = rows[inside], cols[inside], part[r[inside], c[inside]]
        yield pa.RecordBatch.from_arrays([pa.array([partition.code] * len(rows), pa.string()), pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(values)], ["sheet", "row", "col", "value"])


def read_sheets(spark: SparkSession, sheets: DataFrame, fetch: str, url: str = "", window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Cells of the sheets (code, row, col, rows, cols: a list for the driver, one row a sheet) that the window meets."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterTiles)
    listed = [[s.code, s.row, s.col, s.rows, s.cols] for s in sheets.select("code", "row", "col", "rows", "cols").orderBy("code").collect()]
    options = {"sheets": json.dumps(listed), "fetch": fetch, "url": url} | ({"window": ",".join(map(str, window))} if window else {})
    return spark.read.format("raster_tiles").options(**options).load()


def _files(path: str) -> tuple[Any, str]:
    """The file system of a path and the path there: a local one, or any that its scheme names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path.removeprefix('file:')}")


class TileStore(DataSource):
    """A sink for tiles (level, tile_r, tile_c, data: array<double> in rows): one file a tile, and one record of all.

    Options: ``path``, ``tile`` (cells along a side), ``record`` (JSON, kept as it is). Tasks write to a folder beside the
    path. When all have, the record goes there too and the folder takes the path's name; a job that fails leaves nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "tile_store"

    def schema(self) -> str:
        return "level int, tile_r int, tile_c int, data array<double>"

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    tiles: list[tuple[int, int, int, str]]


class TileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.tile, self.record = options["path"].rstrip("/"), int(options["tile"]), options.get("record", "{}")
        self.staging = f"{self.path}.part-{uuid.uuid4().hex}"
        files, at = _files(self.path)
        if files.get_file_info(at).type.name != "NotFound":
            raise FileExistsError(self.path)
        files.create_dir(_files(self.staging)[1], recursive=True)

    def write(self, iterator: Iterator) -> Written:
        files, at = _files(self.staging)
        done = []
        for row in iterator:
            out = io.BytesIO()
            np.save(out, np.array([np.nan if x is None else x for x in row.data]).reshape(self.tile, self.tile))
            # Not with the folder above it: once that is gone, the job has failed, and a task that still runs fails too.
            files.create_dir(f"{at}/{row.level}", recursive=False)
            # A task that runs twice writes the same bytes under the same name.
            with files.open_output_stream(f"{at}/{row.level}/{row.tile_r}_{row.tile_c}.npy") as f:
                f.write(out.getvalue())
            done.append((row.level, row.tile_r, row.tile_c, hashlib.sha256(out.getvalue()).hexdigest()))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = _files(self.staging)
        tiles = sorted({t for m in messages if m is not None for t in m.tiles})
        with files.open_output_stream(f"{at}/record.json") as f:
            f.write(json.dumps({"tile": self.tile, "tiles": tiles, "record": json.loads(self.record)}, sort_keys=True).encode())
        files.move(at, _files(self.path)[1])

    def abort(self, messages: list[Written | None]) -> None:
        files, at = _files(self.staging)
        for _ in range(20):  # a task may be writing just now
            try:
                if files.get_file_info(at).type.name == "NotFound":
                    return
                files.delete_dir(at)
            except OSError:
                pass
            time.sleep(0.1)


def pyramid(cells: DataFrame, tile: int, levels: int, value: str = "value") -> DataFrame:
    """(level, tile_r, tile_c, data): tiles of the cells, and of their means in blocks of 2, 4 and so on cells a side."""
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    down = lambda c: F.expr(f"shiftright({c}, level)")
    each = cells.where(F.col(value).isNotNull()).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("v"), level.alias("level"))
    means = each.groupBy("level", down("row").alias("r"), down("col").alias("c")).agg(F.avg("v").alias("v"))
    block = lambda c: F.floor(F.col(c) / tile).cast("int")
    k = F.pmod(F.col("r"), F.lit(tile)) * tile + F.pmod(F.col("c"), F.lit(tile))
    held = means.groupBy("level", block("r").alias("tile_r"), block("c").alias("tile_c")).agg(F.map_from_entries(F.collect_list(F.struct(k, "v"))).alias("m"))  # one tile
    return held.select("level", "tile_r", "tile_c", F.transform(F.sequence(F.lit(0), F.lit(tile * tile - 1)), lambda i: F.try_element_at("m", i)).alias("data"))


def write_store(cells: DataFrame, path: str, tile: int = 256, levels: int = 1, record: dict[str, Any] | None = None, value: str = "value") -> None:
    """Tiles, overviews and the record of where they come from, all under ``path`` or nothing."""
    spark = cells.sparkSession
    ship(spark)
    spark.dataSource.register(TileStore)
    told = json.dumps(record or {}, default=str)
    pyramid(cells, tile, levels, value).write.format("tile_store").options(path=path, tile=str(tile), record=told).mode("append").save()


def stored_tile(url: str, code: str) -> np.ndarray:
    files, at = _files(url)
    with files.open_input_file(f"{at}/{code}.npy") as f:
        return np.load(io.BytesIO(f.read()))


def read_record(path: str) -> dict[str, Any]:
    files, at = _files(path)
    with files.open_input_file(f"{at}/record.json") as f:
        return json.loads(f.read())


def read_store(spark: SparkSession, path: str, level: int = 0, window: tuple[int, int, int, int] | None = None, fetch: str = "timbergrid.sources.rasters:stored_tile") -> DataFrame:
    """(sheet, row, col, value) of a level of a store; tiles outside the window are never opened."""
    kept = read_record(path)
    n = kept["tile"]
    sheets = [(f"{r}_{c}", r * n, c * n, n, n) for x, r, c, _ in kept["tiles"] if x == level]
    return read_sheets(spark, spark.createDataFrame(sheets, "code string, row int, col int, rows int, cols int"), fetch, f"{path}/{level}", window)
