"""Writing results: Parquet tables with a metadata row beside them, one folder a run."""

from __future__ import annotations

import platform
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from typing import Any

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbergrid.plans.config import Area, config_digest


def run_id(digest: str, now: datetime | None = None) -> str:
    return f"{now or datetime.now(UTC):%Y%m%d_%H%M%S}_{digest[:7]}"


def run_metadata(spark: SparkSession, config: Mapping[str, Any], area: Area, sources: Sequence[str] = (), now: datetime | None = None) -> DataFrame:
    digest = config_digest(config)
    now = now or datetime.now(UTC)
    row = (run_id(digest, now), digest, now.isoformat(), platform.python_version(), pyspark.__version__, [area.x_min, area.y_min, area.x_max, area.y_max], attribution(sources))
    return spark.createDataFrame([row], "run_id string, config_sha256 string, written_at string, python string, spark string, bbox array<double>, attribution string")


def attribution(sources: Sequence[str]) -> str:
    return " | ".join(dict.fromkeys(s for s in sources if s))


def write_run(tables: Mapping[str, DataFrame], metadata: DataFrame, root: str) -> str:
    """All tables of a run under ``root/run_id``; a run that exists is never overwritten."""
    at = f"{root}/{metadata.first()['run_id']}"
    metadata.write.mode("errorifexists").json(f"{at}/metadata")
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{at}/{name}")
    return at


def write_tiles(cells: DataFrame, path: str, tile: int, value: str = "value") -> None:
    """Cells as tiles of tile x tile values, partitioned by tile row, so that a window reads the tiles it meets."""
    block = lambda c: F.floor(F.col(c) / tile).cast("int")
    k = ((F.col("row") % tile) * tile + F.col("col") % tile).cast("int")
    held = cells.groupBy(block("row").alias("tile_r"), block("col").alias("tile_c")).agg(F.map_from_entries(F.collect_list(F.struct(k, F.col(value)))).alias("m"))
    at = F.sequence(F.lit(0), F.lit(tile * tile - 1))
    out = held.select("tile_r", "tile_c", F.transform(at, lambda i: F.try_element_at("m", i)).alias("data"), F.transform(at, lambda i: F.map_contains_key("m", i)).alias("valid"))
    out.write.mode("errorifexists").partitionBy("tile_r").parquet(path)


def write_features(edges: DataFrame, path: str, bucket_m: float = 2000.0, files: int = 8) -> None:
    """Edge tables (id, x1, y1, x2, y2 and more) laid out by place, each edge with its box, for ``layers.features``.

    Files are ranges of buckets in the order of interleaved column and row numbers, so a box meets few row groups.
    """
    box = {"x_min": F.least("x1", "x2"), "x_max": F.greatest("x1", "x2"), "y_min": F.least("y1", "y2"), "y_max": F.greatest("y1", "y2")}
    at = lambda c: F.floor(F.col(c) / bucket_m).cast("long")
    bit = lambda n, k: F.shiftleft(F.shiftright(n, k).bitwiseAND(F.lit(1)), 2 * k)
    code = sum((bit(at("x_min"), k) + F.shiftleft(bit(at("y_min"), k), 1) for k in range(1, 20)), bit(at("x_min"), 0) + F.shiftleft(bit(at("y_min"), 0), 1))
    placed = edges.withColumns(box).withColumn("_place", code)
    placed.repartitionByRange(files, "_place").sortWithinPartitions("_place", "id").drop("_place").write.mode("errorifexists").parquet(path)
