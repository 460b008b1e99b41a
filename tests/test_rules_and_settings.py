from __future__ import annotations

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from timbergrid.functions import rules as R
from timbergrid.plans.config import Area, Resistance, Sweep, every_problem, perturbed, problems, read_config


def told(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_peat_codes(spark):
    codes = [("10",), ("50",), ("59",), ("60",), ("65",), (None,), ("60d",), (" 60 ",)]
    assert told(spark, codes, "s string", R.is_peat(F.col("s"))) == [False, False, False, True, True, False, False, True]


def test_ccf_truth_table(spark):
    rows = [("60", 3, 7, 0.5), ("59", 3, 7, 0.5), ("60", 4, 7, 0.5), ("60", 3, 6, 0.5), ("60", 3, 7, 0.49), ("65", 1, 9, 1.0), (None, 3, 7, 0.5), ("60", 3, 7, None)]
    column = R.ccf_prescribed(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert told(spark, rows, "a string, b int, c int, d double", column) == [True, False, False, False, False, True, False, False]


def test_species_rule_bounds_and_nulls(spark):
    rows = [(True, 0.9, 0.49), (True, 0.0, 0.5), (False, 0.25, 0.25), (False, None, 0.4), (False, None, None)]
    column = R.species_rule(F.col("p"), F.col("a"), F.col("b"))
    assert told(spark, rows, "p boolean, a double, b double", column) == [False, True, True, False, False]


def test_season_bounds(spark):
    days = [(dt.date(2020, 4, 30),), (dt.date(2020, 5, 1),), (dt.date(2020, 11, 30),), (dt.date(2020, 12, 1),), (None,)]
    assert told(spark, days, "d date", R.in_period(F.col("d"))) == [False, True, True, False, False]


def test_threshold_is_monotone_between_its_ends(spark):
    pct = [(1.0,), (0.875,), (0.75,), (0.5,), (0.25,), (0.0,), (None,)]
    out = told(spark, pct, "p double", R.threshold_ha(F.col("p")))
    assert out[0] == 0.5 and out[5] == pytest.approx(10.0) and out[6] is None
    assert out[1] == pytest.approx(math.sqrt(0.5)) and out[2:5] == pytest.approx([1, 2, 4])


def test_blend_between_bands(spark):
    rows = [(0.5, 1.0, 4.0), (1.0, 1.0, 4.0), (100.0, 1.0, 9.0), (0.1, 1.0, 4.0), (math.sqrt(0.5), 1.0, 4.0), (None, 1.0, 4.0)]
    out = told(spark, rows, "t double, a double, b double", R.at_threshold(F.col("t"), {0.5: F.col("a"), 1.0: F.col("b")}))
    assert out[:4] == [1.0, 4.0, 9.0, 1.0] and out[4] == pytest.approx(2.5) and out[5] is None


def test_workable(spark):
    rows = [(1.0, False), (1.01, False), (0.2, True), (None, False), (None, None)]
    assert told(spark, rows, "d double, f boolean", R.workable(F.col("d"), F.col("f"))) == [False, True, True, False, False]


def test_ls_factor(spark):
    rows = [(50.0, 5.0), (50.0, 0.0), (None, 5.0)]
    out = told(spark, rows, "a double, s double", R.ls_factor(F.col("a"), F.col("s"), 10.0))
    assert out[0] == pytest.approx((100 / 22.13) ** 0.4 * (math.sin(math.radians(5)) / 0.0896) ** 1.3) and out[1:] == [0.0, 0.0]


def test_look_up_table(spark):
    out = told(spark, [("12",), ("19.6",), ("999",), (None,), ("x",)], "c string", R.looked_up(F.col("c"), {12: 0.013, 20: 0.043}, 0.025))
    assert out == [0.013, 0.043, 0.025, 0.025, 0.025]


def test_cells_for_distance():
    assert [R.cells_for_distance(d, 16) for d in (1, 24, 40, 100)] == [1, 2, 2, 6]


def test_declared_day_keeps_its_offset(spark):
    assert told(spark, [("2009-01-08T00:00:00+02:00",)], "s string", R.day_of_stamp(F.col("s"))) == [dt.date(2009, 1, 8)]


def test_water_and_missing_stand(spark):
    cover = R.land_cover_term(F.col("c"))
    column = R.resistance([(0.5, cover), (0.5, R.stand_term(F.col("v"), 120.0, cover))], F.col("c"))
    assert told(spark, [(42, 1.0), (17, None), (24, 240.0)], "c int, v double", column) == pytest.approx([1000.0, 1 + 0.8 * 99, 1 + 0.05 * 99])


def test_fixed_values_of_resistance_and_labels(spark):
    r, s = Resistance(), Sweep()
    assert sorted(c for codes in r.classes.values() for c in codes) == list(range(1, 50))
    assert (r.weights, r.dispersal, r.basal_area_cap, r.deciduous_share, r.corridor_slack) == ({"age": 0.3, "structure": 0.25, "species": 0.2, "landcover": 0.25}, 8000.0, 25.0, 0.5, 0.15)
    assert (s.seed, s.weight_by, s.land_cover_by, s.dispersal_by, s.robust_share, s.n_runs) == (0, 0.4, 0.3, 0.5, 0.8, 20)
    codes = [(25,), (37,), (32,), (45,), (17,), (40,), (16,), (0,)]
    assert told(spark, codes, "c int", R.land_cover_term(F.col("c"))) == pytest.approx([0.1, 0.5, 0.55, 0.4, 0.8, 0.7, 0.9, 0.61875])
    labels = told(spark, [(True, False), (False, True), (False, False)], "p boolean, c boolean", R.harvest_timing(F.col("p"), F.col("c")))
    assert labels == ["frozen-ground / winter preferred"] * 2 + ["no trafficability restriction"]


def test_resistance_of_a_forest_and_a_lake_cell(spark):
    from timbergrid.operators.raster import resistance_surface

    rows = [(0, 0, 25, 60.0, 10.0, 0.0), (0, 1, 42, 60.0, 10.0, 0.0), (0, 2, 17, None, None, None)]
    cells = spark.createDataFrame(rows, "row int, col int, clc int, meanage double, basalarea double, proportionother double")
    want = 1 + 99 * (0.3 * 0.5 + 0.25 * 0.6 + 0.2 * 1.0 + 0.25 * 0.1)
    assert [r.cost for r in resistance_surface(cells).orderBy("col").collect()] == pytest.approx([want, 1000.0, 80.2])


def test_perturbation_is_seeded_and_sums_to_one():
    a, b = perturbed(Resistance(), Sweep(n_runs=4)), perturbed(Resistance(), Sweep(n_runs=4))
    assert a == b and len({c.dispersal for _, c in a}) == 4
    assert all(sum(c.weights.values()) == pytest.approx(1) for _, c in a)


def test_problems_are_all_told():
    assert len(problems({"bbox": [1, 2, 0, 3], "rootrot": {"look_back_days": True}})) == 12
    with pytest.raises(ValueError):
        Area("a", 1, 0, 0, 1)


def whole_config():
    return {
        "bbox": [0, 0, 10, 10],
        "dtw": {"reference": "dtw_2019", "unit": "cm", "resolution_m": 2, "culvert_burn": False, "pit_removal": "breach", "flow": "dinf", "thresholds_ha": [0.5, 4]},
        "weather": {"enabled": True, "station": 101, "antecedent_days": [7, 14, 30]},
        "soil": {"enabled": True, "peat_penalty": 0.5},
        "rootrot": {"peat_spruce_share": 0.5, "mineral_conifer_share": 0.5, "look_back_days": 21, "period": {"start": "05-01", "end": "11-30"}, "frost_c": -10, "spore_c": 5, "setback_m": 10},
        "planning": {"buffer_widths_m": [10, 30], "habitat_widths_m": [10], "wet_m": 1, "channel_resolution_m": 16, "retention_trees_ha": 10, "retention_dbh_cm": 15, "deadwood_trees_ha": 5, "deadwood_zone": "south", "deadwood_m3_ha": 5.5, "deadwood_standing": 0.3, "stumps_ha": 4},
        "ccf": {"most_fertility_class": 3, "least_spruce_share": 0.5, "least_peat_code": 60, "drained_states": [7, 8, 9]},
        "erosion": {"benchmark": "layer", "r_factor": 300, "length_exponent": 0.4, "slope_exponent": 1.3, "most_length_m": 100, "k_default": 0.02, "c_default": 0.01, "k_by_soil": {"1": 0.01}, "c_by_cover": {"12": 0.15}},
        "nodes": {"sources": ["old_stands", "habitat_s10"], "old_age": 120},
        "resistance": {"low": 1, "high": 100, "dispersal": 8000, "weights": dict.fromkeys(("age", "structure", "species", "landcover"), 0.25), "resolution_m": 16, "water": 1000, "age_cap": 120, "basal_area_cap": 25, "deciduous_share": 0.5, "land_cover": {"a": 0.1}, "coarsen": 8, "backbone_k": 3, "corridor_slack": 0.15},
        "patches": {"merge_m": 200, "least_ha": 1},
        "sweep": {"n_runs": 20, "robust_share": 0.8, "seed": 0, "weight_by": 0.4, "land_cover_by": 0.3, "dispersal_by": 0.5},
    }


def test_a_whole_configuration_has_no_problems(tmp_path):
    assert every_problem(whole_config()) == []
    (tmp_path / "c.json").write_text(json.dumps(whole_config()))
    assert read_config(str(tmp_path / "c.json")) == whole_config()


@pytest.mark.parametrize(
    "section, key, wrong",
    [("dtw", "unit", "km"), ("dtw", "culvert_burn", 1), ("dtw", "thresholds_ha", []), ("dtw", "thresholds_ha", [1, 0]), ("dtw", "flow", None), ("weather", "antecedent_days", [7, True]), ("weather", "station", None), ("soil", "peat_penalty", 1.5),
     ("rootrot", "period", {"start": "05-01"}), ("rootrot", "period", {"start": "13-01", "end": "11-30"}), ("rootrot", "frost_c", "cold"), ("planning", "deadwood_zone", ""), ("planning", "wet_m", -1), ("ccf", "drained_states", [7.5]),
     ("erosion", "k_by_soil", {}), ("erosion", "c_by_cover", {"1": 2}), ("nodes", "sources", ["old_stands", "ponds"]), ("resistance", "land_cover", {"a": False}), ("resistance", "water", float("nan")), ("sweep", "seed", "x")],
)
def test_each_wrong_key_is_one_problem(section, key, wrong, tmp_path):
    config = whole_config()
    config[section][key] = wrong
    (told,) = every_problem(config)
    assert told.startswith(f"{section}.{key}: ")
    del config[section][key]
    assert every_problem(config) == [f"{section}.{key}: it is missing"]
    (tmp_path / "c.json").write_text(json.dumps(config))
    with pytest.raises(ValueError, match="it is missing"):
        read_config(str(tmp_path / "c.json"))


def test_a_missing_section_is_told_once():
    config = whole_config()
    del config["erosion"]
    config["soil"] = 3
    assert every_problem(config) == ["soil: the section is missing", "erosion: the section is missing"]


def test_numbers_by_type_are_not_read_as_text(spark):
    values = [0.0, -0.0, 1.5, 1e-7, 1.23456789012345e22, -2.0**53, float("nan"), float("inf"), -float("inf"), None]
    frame = spark.createDataFrame([(v, None if v is None or abs(v) > 1e20 or v != v else int(v)) for v in values], "x double, n long")
    text = frame.select(F.col("x").cast("string").alias("x"), F.col("n").cast("string").alias("n"))
    got = frame.select(R.number(F.col("x")).alias("x"), R.number(F.col("n")).alias("n"))
    assert [tuple(map(str, r)) for r in got.collect()] == [tuple(map(str, r)) for r in text.select(R.number(F.col("x")).alias("x"), R.number(F.col("n")).alias("n")).collect()]
    assert "RLIKE" not in got._jdf.queryExecution().optimizedPlan().toString().upper()
