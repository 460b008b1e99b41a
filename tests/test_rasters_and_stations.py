from __future__ import annotations

import datetime as dt
import os
import pathlib
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbergrid.sources import rasters, stations

HERE = "tests.test_rasters_and_stations"


def opened(url, code):
    """A service of 6 x 4 sheets of 10 x 10 cells, one of them missing; it leaves a mark for every sheet it is asked for."""
    pathlib.Path(url, f"{code}.{uuid.uuid4().hex}").touch()
    r, c = map(int, code.split("_"))
    return None if (r, c) == (5, 3) else np.arange(100.0).reshape(10, 10) + 1000 * r + 100 * c


def unreachable(url, code):
    raise OSError("no answer")


def marks(path):
    return sorted(f.split(".")[0] for f in os.listdir(path))


@pytest.fixture()
def sheets(spark):
    return spark.createDataFrame([(f"{r}_{c}", 10 * r, 10 * c, 10, 10) for r in range(6) for c in range(4)], "code string, row int, col int, rows int, cols int")


def test_tiles_outside_a_window_are_never_opened(spark, sheets, tmp_path):
    read = lambda at, **more: rasters.read_sheets(spark, sheets, f"{HERE}:opened", str(at), **more)
    for name in "abcdef":
        (tmp_path / name).mkdir()
    got = read(tmp_path / "a", window=(8, 21, 5, 9))
    assert sorted((r.row, r.col, r.value) for r in got.collect()) == [(r, c, 1000.0 * (r // 10) + 10 * (r % 10) + c) for r in range(8, 22) for c in range(5, 10)]
    assert marks(tmp_path / "a") == ["0_0", "1_0", "2_0"]
    assert read(tmp_path / "b", window=(70, 80, 0, 9)).count() == 0 and marks(tmp_path / "b") == []
    assert read(tmp_path / "c").count() == 23 * 100 and len(marks(tmp_path / "c")) == 24  # the missing sheet has no cells
    pushed = read(tmp_path / "d").where((F.col("row") >= 30) & (F.col("row") < 40) & (F.col("col") > 19) & (F.col("value") > 0))
    assert pushed.count() == 200 and marks(tmp_path / "d") == ["3_2", "3_3"]
    # The sheets that some areas meet, and those alone.
    areas = spark.createDataFrame([(12, 14, 0, 3), (55, 58, 31, 35)], "r0 int, r1 int, c0 int, c1 int")
    met = sheets.join(areas, (F.col("row") <= F.col("r1")) & (F.col("row") + F.col("rows") > F.col("r0")) & (F.col("col") <= F.col("c1")) & (F.col("col") + F.col("cols") > F.col("c0")), "left_semi")
    assert rasters.read_sheets(spark, met, f"{HERE}:opened", str(tmp_path / "e")).count() == 100 and marks(tmp_path / "e") == ["1_0", "5_3"]
    assert read(tmp_path / "f").where(F.col("sheet").isin("0_1", "4_2")).count() == 200 and marks(tmp_path / "f") == ["0_1", "4_2"]
    with pytest.raises(Exception, match="no answer"):
        spark.read.format("raster_tiles").options(sheets='[["a", 0, 0, 1, 1]]', fetch=f"{HERE}:unreachable", tries="1").load().collect()


def test_store_with_overviews_is_written_whole(spark, tmp_path):
    cells = [(r, c, float(7 * r + c)) for r in range(11) for c in range(9) if (r * c) % 5]
    frame = spark.createDataFrame(cells, "row int, col int, value double").repartition(3)
    at = str(tmp_path / "store")
    rasters.write_store(frame, at, tile=4, levels=3, record={"source": "test", "sheets": ["a"]})
    assert os.listdir(tmp_path) == ["store"]
    kept = rasters.read_record(at)
    assert kept["record"] == {"source": "test", "sheets": ["a"]} and len(kept["tiles"]) == 9 + 4 + 1
    back = rasters.read_store(spark, at)
    assert sorted((r.row, r.col, r.value) for r in back.collect()) == cells
    for level in (1, 2):
        want: dict = {}
        for r, c, v in cells:
            want.setdefault((r >> level, c >> level), []).append(v)
        got = {(r.row, r.col): r.value for r in rasters.read_store(spark, at, level).collect()}
        assert got == pytest.approx({k: sum(v) / len(v) for k, v in want.items()})
    part = rasters.read_store(spark, at, window=(4, 7, 0, 3))
    assert {r.sheet for r in part.collect()} == {"1_0"}
    with pytest.raises(Exception, match="FileExistsError"):
        rasters.write_store(frame, at, tile=4)
    assert sorted(map(tuple, rasters.read_store(spark, at).select("row", "col", "value").collect())) == cells


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(rasters.TileStore)
    # The tile that is too short fails after others have been written.
    rows = spark.createDataFrame([(0, k, 0, [1.0] * 16) for k in range(6)] + [(0, 9, 0, [1.0])], "level int, tile_r int, tile_c int, data array<double>").repartition(4)
    with pytest.raises(Exception, match="reshape"):
        rows.write.format("tile_store").options(path=str(tmp_path / "store"), tile="4").mode("append").save()
    assert os.listdir(tmp_path) == []


def yearly(url, station, first, last, params):
    pathlib.Path(url, f"{station}_{first}_{last}.{uuid.uuid4().hex}").touch()
    days = [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]
    return [(d.isoformat(), p, float("nan") if d.day == 2 else station + d.day / 100) for d in days for p in (*params, "other")]


def test_weather_is_paged_by_year(spark, tmp_path):
    spark.dataSource.register(stations.DailyWeather)
    (tmp_path / "calls").mkdir()
    told = {"fetch": f"{HERE}:yearly", "url": str(tmp_path / "calls"), "stations": "5,7", "params": "rrday,tmin", "start": "2019-12-30"}
    got = spark.read.format("daily_weather").options(**told, end="2021-01-02").load()
    rows = got.collect()
    assert len(rows) == 2 * 2 * (2 + 366 + 2) and {r.param for r in rows} == {"rrday", "tmin"}
    assert {r.value for r in rows if r.date == dt.date(2020, 3, 2)} == {None} and {r.value for r in rows if r.date == dt.date(2020, 3, 4) and r.station == 5} == {5.04}
    assert marks(tmp_path / "calls") == [f"{s}_{a}" for s in (5, 7) for a in ("2019-12-30_2019-12-31", "2020-01-01_2020-12-31", "2021-01-01_2021-01-02")]
    assert spark.read.format("daily_weather").options(**told, end="2019-01-01").load().count() == 0


def test_a_restarted_stream_fetches_no_year_twice(spark, tmp_path):
    spark.dataSource.register(stations.DailyWeather)
    (tmp_path / "calls").mkdir()

    def run(end):
        told = {"fetch": f"{HERE}:yearly", "url": str(tmp_path / "calls"), "stations": "5,7", "params": "tmin", "start": "2020-12-31", "end": end}
        writer = spark.readStream.format("daily_weather").options(**told).load().writeStream.format("parquet")
        query = writer.option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run("2021-12-31")
    first = marks(tmp_path / "calls")
    run("2021-12-31")
    assert marks(tmp_path / "calls") == first
    run("2023-01-05")
    assert len(set(marks(tmp_path / "calls"))) == len(marks(tmp_path / "calls")) == 2 * 4
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() == rows.distinct().count() == 2 * (1 + 365 + 365 + 5)
