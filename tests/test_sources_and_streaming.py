from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from timbergrid.plans import modules
from timbergrid.plans.config import Area
from timbergrid.sources import layers, sinks
from timbergrid.streaming.weather import daily_values

BOX = Area("box", 0.0, 0.0, 25.0, 20.0)


def service(url, box, start, count):
    """Features on whole coordinates of a closed box, in pages; the server tells points on edges to both tiles."""
    x0, y0, x1, y1 = map(int, box)
    found = [{"id": 100 * x + y, "x": x, "y": y, "properties": {"b": y, "a": x}} for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
    return found[start : start + count]


def failing(url, box, start, count):
    raise OSError("no answer")


def test_paged_source_gives_each_feature_once(spark):
    spark.dataSource.register(layers.FeaturePages)
    read = spark.read.format("feature_pages").options(fetch="tests.test_sources_and_streaming:service", box="0,0,25,20", tile="10", page="7")
    rows = read.load().collect()
    assert sorted((r.x, r.y) for r in rows) == [(float(x), float(y)) for x in range(26) for y in range(21)]
    assert json.loads(rows[0].properties)["a"] == rows[0].x
    with pytest.raises(Exception, match="no answer"):
        spark.read.format("feature_pages").options(fetch="tests.test_sources_and_streaming:failing", box="0,0,5,5", tries="1").load().collect()


def test_layers_are_checked_and_boxed(spark, tmp_path):
    at = "habitat_id long, habitattype string, x double, y double"
    spark.createDataFrame([(1, "1", 0.0, 20.0), (2, "3", 25.1, 5.0), (3, None, None, 1.0)], at).write.parquet(f"{tmp_path}/habitat")
    assert [r.habitat_id for r in layers.layer(spark, str(tmp_path), "habitat", BOX).collect()] == [1]
    assert layers.layer(spark, str(tmp_path), "habitat").count() == 3
    with pytest.raises(KeyError):
        layers.layer(spark, str(tmp_path), "unknown")
    spark.createDataFrame([("a", "b")], "taso4_id string, taso5_id string").write.parquet(f"{tmp_path}/catchments")
    assert layers.catchment(spark, f"{tmp_path}/catchments", "b", "taso5").count() == 1
    with pytest.raises(RuntimeError):
        layers.catchment(spark, f"{tmp_path}/catchments", "b")


def test_nodes_of_all_sources(spark):
    pts = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    protected = layers.protected_areas({"state": pts, "private": None, "natura": pts})
    old = spark.createDataFrame([(120.0, 0.0, 0.0), (119.0, 1.0, 1.0), (None, 2.0, 2.0)], "meanage double, x double, y double")
    got = layers.nodes(protected, pts, pts, old).groupBy("node_type").count().collect()
    assert {r.node_type: r["count"] for r in got} == {"pa_state": 1, "pa_natura": 1, "habitat_s10": 1, "ymparistotuki": 1, "old_stand": 1}


def test_tiles_and_requests(spark):
    plan = {r.tile_seq: (r.x_min, r.y_min, r.x_max, r.y_max) for r in layers.tile_plan(spark, BOX, 10.0).collect()}
    assert len(plan) == 6 and plan[0] == (0.0, 0.0, 10.0, 10.0) and plan[5] == (20.0, 10.0, 25.0, 20.0)
    values = spark.createDataFrame([(0, 0, 150), (0, 1, 32767), (0, 2, 32766)], "row int, col int, value int")
    assert {r.col: r.nodata_kind for r in layers.with_nodata_kind(values).collect()} == {0: None, 1: 32767, 2: 32766}
    assert {r.col: r.value for r in layers.dtw_metres(values).collect()}[0] == 1.5
    layers.check_dtw_request(2.0, 2023)
    layers.check_dem_request(BOX, 2)
    for wrong, error in ((lambda: layers.check_dtw_request(3.0, 2023), KeyError), (lambda: layers.check_dtw_request(2.0, 2024), NotImplementedError), (lambda: layers.check_dem_request(BOX, 10), NotImplementedError), (lambda: layers.check_dem_request(Area("a", 0, 0, 2e4, 1e4), 2), ValueError)):
        with pytest.raises(error):
            wrong()


def test_tiles_written_and_read_back(spark, tmp_path):
    cells = [(r, c, float(10 * r + c)) for r in range(7) for c in range(5) if (r + c) % 3]
    sinks.write_tiles(spark.createDataFrame(cells, "row int, col int, value double"), f"{tmp_path}/tiles", 4)
    back = layers.tiles_to_cells(spark.read.parquet(f"{tmp_path}/tiles"), 4, 4).collect()
    assert sorted((r.row, r.col, r.value) for r in back) == cells


def test_run_folder_is_never_overwritten(spark, tmp_path):
    now = dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=dt.UTC)
    meta = sinks.run_metadata(spark, {"a": 1}, BOX, ["x", "", "y", "x"], now)
    row = meta.first()
    assert row.run_id.startswith("20240506_070809_") and row.attribution == "x | y" and row.bbox == [0.0, 0.0, 25.0, 20.0]
    at = sinks.write_run({"numbers": spark.range(3)}, meta, str(tmp_path))
    assert spark.read.parquet(f"{at}/numbers").count() == 3 and spark.read.json(f"{at}/metadata").first().config_sha256 == row.config_sha256
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_run({"numbers": spark.range(4)}, meta, str(tmp_path))


def test_stream_drops_what_comes_after_the_watermark(spark, tmp_path):
    schema = "station int, ts timestamp, value double"

    def put(k, rows):
        spark.createDataFrame([(s, dt.datetime.fromisoformat(t), v) for s, t, v in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run():
        told = daily_values(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
        writer = told.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out")
        writer.trigger(availableNow=True).start().awaitTermination(120)

    put(1, [(1, "2024-01-01T01:00:00", 2.0), (1, "2024-01-01T23:00:00", 4.0), (1, "2024-01-02T12:00:00", 9.0)])
    run()
    put(2, [(1, "2024-01-01T02:00:00", 6.0), (1, "2024-01-09T00:00:00", 1.0)])  # late, but within two days of the last
    run()
    put(3, [(1, "2024-01-01T03:00:00", 99.0), (1, "2024-01-20T00:00:00", 1.0)])  # too late
    run()
    got = {str(r.date): (r.n, r.mean_value, r.least, r.most) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["2024-01-01"] == (3, 4.0, 2.0, 6.0) and got["2024-01-02"] == (1, 9.0, 9.0, 9.0) and got["2024-01-09"][0] == 1


def test_stream_distance_and_sections(spark):
    from timbergrid.operators.spatial import Grid

    stands = spark.createDataFrame([(1, 0.0, 30.0), (2, 20.0, 10.0), (3, 99.0, 0.0), (4, 14.0, 30.0)], "stand_row int, x double, y double")
    streams = spark.createDataFrame([(0, 1)], "row int, col int")
    got = {r.stand_row: r.nearest_derived_stream_m for r in modules.stream_distance(stands, streams, Grid(0.0, 30.0, 10.0, 3, 3)).collect()}
    assert got == {1: 10.0, 2: pytest.approx(10 * 5**0.5), 3: None, 4: 0.0}
    none = modules.stream_distance(stands, streams.limit(0), Grid(0.0, 30.0, 10.0, 3, 3)).collect()
    assert [r.nearest_derived_stream_m for r in none] == [None] * 4
    told = modules.section(spark.createDataFrame([(10.0, 1.5, None)], "width double, a double, b long"), "s", ("a", "b"), F.col("width").cast("int")).collect()
    assert [tuple(r) for r in told] == [("s", "10", "a", 1.5), ("s", "10", "b", None)]


def test_features_by_place(spark, tmp_path, capsys):
    edges = [(k, 641 if k % 2 else 612, "a" if k % 3 else None, 500.0 * (k % 40), 700.0 * (k // 40), 500.0 * (k % 40) + 90.0, 700.0 * (k // 40) - 40.0) for k in range(1600)]
    frame = spark.createDataFrame(edges, "id long, workcode int, environmentmanagementtype string, x1 double, y1 double, x2 double, y2 double")
    sinks.write_features(frame, f"{tmp_path}/virtavesikapea", bucket_m=1000.0)
    area = Area("a", 2050.0, 1000.0, 6000.0, 5000.0)
    got = layers.topographic(spark, str(tmp_path), "streams", area)
    want = {e[0] for e in edges if e[5] >= area.x_min and e[3] <= area.x_max and e[4] >= area.y_min and e[6] <= area.y_max}
    assert {r.id for r in got.collect()} == want and 0 < len(want) < 100
    got.explain("formatted")
    assert got.columns == frame.columns and "GreaterThanOrEqual(x_max,2050.0)" in capsys.readouterr().out
    # Every file's edges lie together: the area meets few of them.
    whole = spark.read.parquet(f"{tmp_path}/virtavesikapea")
    boxes = whole.groupBy(F.input_file_name()).agg(F.min("x_min").alias("x0"), F.max("x_max").alias("x1"), F.min("y_min").alias("y0"), F.max("y_max").alias("y1")).collect()
    met = [b for b in boxes if b.x1 >= area.x_min and b.x0 <= area.x_max and b.y1 >= area.y_min and b.y0 <= area.y_max]
    assert len(boxes) == 8 and len(met) <= 3
    with pytest.raises(KeyError):
        layers.topographic(spark, str(tmp_path), "lakes")
    support = layers.environmental_support(spark, f"{tmp_path}/virtavesikapea")
    assert {r.id for r in support.collect()} == {e[0] for e in edges if e[1] == 641 and e[2]}


def test_clipped_to_a_polygon_with_a_hole(spark):
    from timbergrid.operators import raster
    from timbergrid.operators.spatial import Grid

    ring = lambda a, b: [(1, a, a, b, a), (1, b, a, b, b), (1, b, b, a, b), (1, a, b, a, a)]
    edges = spark.createDataFrame([(i, *map(float, e)) for i, *e in ring(0, 40) + ring(10, 20)], "id int, x1 double, y1 double, x2 double, y2 double")
    cells = spark.createDataFrame([(r, c, 1.0) for r in range(6) for c in range(6)], "row int, col int, value double")
    got = raster.clipped(cells, edges, Grid(0.0, 60.0, 10.0, 6, 6)).collect()
    assert {(r.row, r.col) for r in got} == {(r, c) for r in range(2, 6) for c in range(4)} - {(4, 1)}
