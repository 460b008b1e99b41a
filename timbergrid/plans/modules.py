"""The two reports that a user runs, planning of harvests and habitat networks, as long tables; and the site plan's streams.

A report is (section, item, metric, value): one plan that joins no sections, so it can be written and read by section.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbergrid.operators import raster, spatial
from timbergrid.operators.checkpoints import cut

THRESHOLDS_HA = (0.5, 2.0, 10.0)
BUFFER = ("derived_ha", "mapped_ha", "additional_ha")
ERODED = ("buffer_ha", "high_ha", "high_share")
CCF = ("n_ccf", "total_ha", "peat_ha", "drained_ha", "ccf_ha", "ccf_strict_ha", "ccf_of_drained_pct", "ccf_of_total_pct")
CONFLICT = ("ccf_ha", "conflict_ha", "n_conflict", "conflict_share")
DEADWOOD = ("area_ha", "deadwood_m3", "standing_m3")
PROXIMITY = ("n_stands", "area_ha", "type_1_ha", "type_3_ha")
DECADES = ("mean_days", "winters")
WINTERS = ("days", "frozen_days", "n_rows")
ENDS = ("first_decade_mean", "last_decade_mean")
#: The trend's p stays in the trend's own table.
TREND = ("n", "s", "tau", "slope")
BENCHMARK = ("n", "spearman", "pearson_log", "median_ratio")
CLASSES = ("n", "median_dtw", "workable_share", "spearman")


def stream_distance(stands: DataFrame, streams: DataFrame, grid: spatial.Grid) -> DataFrame:
    """(stand_row, nearest_derived_stream_m): distance of a stand's cell from the nearest stream cell.

    ``stands``: stand_row, x, y; ``streams``: row, col. Sampling rounds the index; outside the grid it is NULL.
    """
    cells = raster.distance_everywhere(streams, grid).select("row", "col", (F.sqrt("d2") * grid.res).alias("nearest_derived_stream_m"))
    return spatial.sampled(stands.select("stand_row", "x", "y"), cells, grid, ["nearest_derived_stream_m"], index_mode="round").select("stand_row", "nearest_derived_stream_m")


def section(df: DataFrame, name: str, metrics: Sequence[str], item: Column | None = None) -> DataFrame:
    """(section, item, metric, value): every metric of every row of a small report."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    told = df.select(F.lit(name).alias("section"), (F.lit("") if item is None else item.cast("string")).alias("item"), F.explode(each).alias("u"))
    return told.select("section", "item", "u.metric", "u.value")


def planning_report(
    buffers: Mapping[float, DataFrame], eroded: Mapping[float, DataFrame], ccf: DataFrame, conflict: DataFrame, dead: DataFrame,
    proximity: DataFrame, decades: DataFrame, winters: DataFrame, trend: DataFrame, benchmark: DataFrame, classes: DataFrame,
) -> DataFrame:
    """The planning module's whole report: buffers and erosion by channel threshold, areas, felling window, benchmarks."""
    width = F.col("width").cast("int")
    parts = [section(d, f"buffers_{t:g}ha", BUFFER, width) for t, d in buffers.items()]
    parts += [section(d, f"erosion_{t:g}ha", ERODED, width) for t, d in eroded.items()]
    parts += [section(ccf, "ccf_peatland", CCF), section(conflict, "ccf_rootrot_conflict", CONFLICT), section(dead, "deadwood", DEADWOOD)]
    parts += [section(proximity, "habitat_proximity", PROXIMITY, width), section(decades, "felling_window", DECADES, F.concat_ws(" ", "station", "decade"))]
    ends = decades.groupBy("station").agg(F.min_by("mean_days", "decade").alias("first_decade_mean"), F.max_by("mean_days", "decade").alias("last_decade_mean"))
    parts += [section(winters, "felling_winters", WINTERS, F.concat_ws(" ", "station", "winter")), section(ends, "felling_ends", ENDS, F.col("station")), section(trend, "felling_trend", TREND, F.col("station"))]
    parts += [section(benchmark, "erosion_benchmark", BENCHMARK, F.col("label")), section(classes, "workability_classes", CLASSES, F.col("klass"))]
    return reduce(DataFrame.unionByName, parts)


def network_report(nodes: DataFrame, base: Mapping[str, DataFrame], swept: Mapping[str, DataFrame], stand_area: DataFrame, top: int = 10) -> DataFrame:
    """The network module's report from a base run and a sweep, each as ``network.sweep`` gives them.

    ``nodes``: node_type; ``stand_area``: label, area_ha. Nodes by type, patches, probability of connectivity, the
    ``top`` patches' dPC, stands with a score, and of the sweep its runs, PC's range and the robust stands.
    """
    found = cut(base["connectivity"])
    whole = found.agg(F.count(F.lit(1)).alias("n_patches"), F.bround(F.max("pc"), 6).alias("probability_of_connectivity"))
    best = found.orderBy(F.desc_nulls_last("dpc"), "patch_id").limit(top).select("patch_id", F.bround("dpc", 2).alias("dpc_pct"))
    scored = base["scores"].agg(F.count_if(F.col("score") > 0).alias("n_stands_scored"))
    pc = swept["connectivity"].groupBy("run").agg(F.max("pc").alias("pc")).agg(F.count(F.lit(1)).alias("n_runs"), F.bround(F.min("pc"), 4).alias("pc_min"), F.bround(F.max("pc"), 4).alias("pc_max"))
    robust = swept["robust"].where("robust").join(stand_area, "label", "left").agg(F.count(F.lit(1)).alias("n_robust_stands"), F.bround(F.coalesce(F.sum("area_ha"), F.lit(0.0)), 1).alias("robust_stand_area_ha"))
    parts = [
        section(nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n_nodes")), "nodes", ("n_nodes",), F.col("node_type")),
        section(whole, "network", ("n_patches", "probability_of_connectivity")),
        section(best, "top_patches", ("dpc_pct",), F.col("patch_id")),
        section(scored, "network", ("n_stands_scored",)),
        section(pc, "sweep", ("n_runs", "pc_min", "pc_max")),
        section(robust, "sweep", ("n_robust_stands", "robust_stand_area_ha")),
    ]
    return reduce(DataFrame.unionByName, parts)
