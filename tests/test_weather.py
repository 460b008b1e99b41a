from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from timbergrid.operators import stands, weather

SCHEMA = "station int, date date, rrday double, tday double, tmin double, snow double"
D = dt.date


def daily(spark, start, rows, station=1):
    return spark.createDataFrame([(station, start + dt.timedelta(days=i), *r) for i, r in enumerate(rows)], SCHEMA)


def test_wetness_matches_pandas(spark):
    rng = random.Random(3)
    rows = [(rng.choice([-1.0, 0.5, 2.0, None]), 1.0, 0.0, rng.choice([-1.0, 3.0, 5.0])) for _ in range(90)]
    got = weather.wetness_percentile(daily(spark, D(2001, 1, 1), rows)).orderBy("date").toPandas()
    rain, snow = (pd.Series([r[i] for r in rows], dtype=float).where(lambda s: s.isna() | (s >= 0), 0) for i in (0, 3))
    score = sum(rain.rolling(w, min_periods=1).sum() * k for w, k in ((7, 3), (14, 2), (30, 1))) / 6 + 2 * (-snow.diff()).clip(lower=0).fillna(0)
    assert got["wetness"].tolist() == pytest.approx(score.round(6).rank(pct=True).tolist(), nan_ok=True)


def test_frost_looks_back_by_days_not_rows(spark):
    frame = spark.createDataFrame([(1, d, 0.0, 0.0, t, 0.0) for d, t in ((D(2020, 4, 10), -12.0), (D(2020, 4, 30), 0.0), (D(2020, 5, 1), 0.0))], SCHEMA)
    assert [r.had_frost for r in weather.frost_look_back(frame).orderBy("date").collect()] == [True, True, False]
    fellings = spark.createDataFrame([(1, 1, D(2020, 4, 20)), (2, 1, D(2020, 5, 5)), (3, 1, D(2020, 4, 1)), (4, 2, D(2020, 4, 20))], "id int, station int, date date")
    assert {r.id: r.cold_spell_exempt for r in weather.cold_spell_exempt(fellings, frame).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_frozen_runs_break_at_nulls_but_not_at_gaps(spark):
    tmin = [-3.0, -3.0, None, -3.0, -2.0, -2.0, -1.0]
    frame = daily(spark, D(2020, 1, 1), [(0.0, 0.0, t, 0.0) for t in tmin]).where(F.col("date") != D(2020, 1, 5))
    more = spark.createDataFrame([(1, D(2020, 1, 5), 0.0, 0.0, -2.0, 0.0)], SCHEMA)
    got = [r.frozen for r in weather.frozen_ground(frame.unionByName(more)).orderBy("date").collect()]
    assert got == [False, False, False, True, True, True, False]


def test_spore_season(spark):
    warm = {*range(60, 62), *range(90, 100), *range(250, 263)}
    frame = daily(spark, D(2021, 1, 1), [(0.0, 6.0 if i in warm else 0.0, 0.0, 0.0) for i in range(365)])
    cold = daily(spark, D(2022, 1, 1), [(0.0, 0.0, 0.0, 0.0)] * 20)
    got = {r.year: (r.season_start, r.season_end) for r in weather.spore_season(frame.unionByName(cold)).collect()}
    assert got == {2021: (D(2021, 1, 1) + dt.timedelta(90), D(2021, 1, 1) + dt.timedelta(262)), 2022: (None, None)}


def test_conflict_free_winters(spark):
    days = pd.date_range("2000-07-01", "2003-06-30")
    rows = [(0.0, 0.0, -5.0 if (d.month == 1 and d.day <= 20) or (d.month == 10 and d.day <= 9) else 5.0, 0.0) for d in days]
    frame = daily(spark, D(2000, 7, 1), rows)
    assert {(r.winter, r.days) for r in weather.conflict_free_days(frame).collect()} == {(2000, 20), (2001, 20), (2002, 20)}
    assert [(r.decade, r.mean_days) for r in weather.conflict_free_decades(frame).collect()] == [(2000, 20.0)]


def test_trend(spark):
    rows = [("up", y, float(y)) for y in range(10)] + [("short", 1, 1.0)] + [("tied", y, v) for y, v in enumerate([1.0, 2.0, 2.0, 3.0, 1.0])]
    got = {r.station: r for r in weather.trend(spark.createDataFrame(rows, "station string, t int, v double"), "t", "v").collect()}
    assert (got["up"].tau, got["up"].slope) == pytest.approx((1.0, 1.0)) and got["up"].p == pytest.approx(2 / 3628800)
    assert got["short"].tau is None and got["short"].p is None
    assert got["tied"].tau == pytest.approx(2 / (10 * 8) ** 0.5)


def test_pivot_averages_and_skips_nan(spark):
    rows = [(1, D(2020, 1, 1), "tmin", "2"), (1, D(2020, 1, 1), "tmin", "4"), (1, D(2020, 1, 1), "snow", "NaN"), (1, D(2020, 1, 1), "snow", "x")]
    got = weather.wide(spark.createDataFrame(rows, "station int, date date, param string, value string"), ["tmin", "snow"]).collect()
    assert [(r.tmin, r.snow) for r in got] == [(3.0, None)]


def test_empty_days(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert weather.frozen_ground(empty).count() == weather.wetness_percentile(empty).count() == 0


def test_area_summary(spark):
    rows = [("60", 1, 7, 0.6, 88.25), ("60", 3, 8, 0.6, 11.75), ("65", 3, 9, 0.1, 50.0), ("60", 3, 1, 0.9, 20.0), ("10", 1, 7, 0.9, 30.0)]
    frame = spark.createDataFrame(rows, "soiltype string, fertilityclass int, drainagestate int, proportionspruce double, area double").withColumn("proportionpine", F.lit(0.0))
    got = stands.ccf_area_summary(frame).first()
    assert (got.total_ha, got.peat_ha, got.drained_ha, got.ccf_ha, got.ccf_strict_ha, got.ccf_of_drained_pct, got.n_ccf) == (200.0, 170.0, 150.0, 100.0, 88.2, 66.67, 2)
    assert stands.ccf_area_summary(frame.limit(0)).first().ccf_of_total_pct is None


def test_frost_of_the_day_before_within_and_after_the_record(spark):
    days = [(1, dt.date(2020, 1, d), float(t)) for d, t in ((3, -12), (4, 0), (8, 0), (30, 0))] + [(2, dt.date(2020, 1, 5), -20.0)]
    daily = spark.createDataFrame(days, "station int, date date, tmin double")
    fellings = [(1, dt.date(2020, 1, 2)), (1, dt.date(2020, 1, 3)), (1, dt.date(2020, 1, 6)), (1, dt.date(2020, 1, 30)), (1, dt.date(2021, 1, 1)), (2, dt.date(2020, 3, 1)), (3, dt.date(2020, 1, 3)), (1, None)]
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(fellings)], "n int, station int, date date")
    got = weather.cold_spell_exempt(frame, daily)
    assert got.columns == ["n", "station", "date", "cold_spell_exempt"]
    by_row = {r.n: r.cold_spell_exempt for r in got.collect()}
    frost = weather.frost_look_back(daily)
    old = weather.as_of(frame, frost, "date", ["had_frost"]).collect()
    assert by_row == {r.n: bool(r.had_frost) for r in old if r.date} | {7: False}
    assert [by_row[i] for i in range(7)] == [False, True, True, False, False, True, False]


def test_days_that_a_record_has_twice(spark):
    """A left row stays one row: of several values of its day the largest counts."""
    days = [(1, dt.date(2020, 5, 1), False), (1, dt.date(2020, 5, 1), True), (1, dt.date(2020, 5, 1), True), (1, dt.date(2020, 5, 3), False), (1, dt.date(2020, 5, 3), None)]
    daily = spark.createDataFrame(days, "station int, date date, had_frost boolean")
    asked = spark.createDataFrame([(7, 1, dt.date(2020, 5, 2)), (8, 1, dt.date(2020, 5, 9)), (9, 1, dt.date(2020, 4, 1))], "id int, station int, date date")
    got = sorted((r.id, r.had_frost) for r in weather.as_of_day(asked, daily, "date", "had_frost").collect())
    assert got == [(7, True), (8, False), (9, None)]


def test_obligation_and_workability_keep_their_rows(spark):
    start = dt.date(2020, 1, 1)
    record = [(1, start + dt.timedelta(k), float(k % 9), 1.0, -5.0 if k < 20 else 4.0, 0.0) for k in range(60)]
    twice = spark.createDataFrame(record + record[10:14] + [(1, record[30][1], 50.0, 1.0, -20.0, 0.0)], "station int, date date, rrday double, tday double, tmin double, snow double")
    asked = spark.createDataFrame([(k, 1, record[k][1], "60", 0.1, 0.7, 1.0, 2.0) for k in (11, 12, 30, 31, 59)], "decl_id int, station int, date date, soiltype string, proportionpine double, proportionspruce double, b1 double, b2 double")
    assert sorted(r.decl_id for r in stands.obligation(asked, twice).collect()) == [11, 12, 30, 31, 59]
    rows = {r.decl_id: r for r in stands.workability(asked, twice, {1.0: "b1", 4.0: "b2"}).collect()}
    assert len(rows) == 5 and rows[30].wetness > rows[31].wetness
