from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from timbergrid.operators import stands
from timbergrid.plans import modules


def test_bars_of_a_site_plan(spark):
    at = "area_ha double, rootrot_obligation boolean, ccf_prescribed boolean, within_habitat_setback boolean, within_stream_buffer boolean"
    plan = spark.createDataFrame([(1.5, True, False, True, False), (2.0, True, False, None, False), (4.0, False, False, True, None)], at)
    assert {r.flag: r.area_ha for r in stands.site_plan_bars(plan).collect()} == {"rootrot_obligation": 3.5, "ccf_prescribed": 0.0, "within_habitat_setback": 5.5, "within_stream_buffer": 0.0}
    assert {r.area_ha for r in stands.site_plan_bars(plan.limit(0)).collect()} == {0.0}


def test_concordance_of_rates(spark):
    of = lambda *flags: spark.createDataFrame([(f,) for f in flags], "workable boolean")
    told = stands.concordance(of(True, True, True, False, None), of(True, False, False, False)).first()
    assert (told.declared_rate, told.control_rate, told.lift) == (0.75, 0.25, 3.0)
    none = stands.concordance(of(True), of(False)).first()
    assert (none.control_rate, none.lift) == (0.0, 1e9)


def test_control_dates_belong_to_their_rows(spark):
    first = dt.date(2001, 3, 1)
    rows = spark.createDataFrame([(k, first + dt.timedelta(days=k % 50)) for k in range(400)], "decl_id int, date date")
    drawn = {r.decl_id: r.date for r in stands.control_dates(rows).collect()}
    assert drawn.keys() == set(range(400)) and min(drawn.values()) == first and max(drawn.values()) == first + dt.timedelta(days=48)
    assert drawn == {r.decl_id: r.date for r in stands.control_dates(rows.repartition(7)).collect()}
    assert drawn != {r.decl_id: r.date for r in stands.control_dates(rows, seed=7).collect()}
    assert len(set(drawn.values())) == 49
    alone = stands.control_dates(rows.limit(1)).first()
    assert alone.date == rows.first().date or alone.date >= first


def test_network_report(spark):
    found = spark.createDataFrame([(0, p, 40.0 - p, 0.25) for p in range(12)], "run int, patch_id long, dpc double, pc double")
    scores = spark.createDataFrame([(0, k, float(k % 3)) for k in range(9)], "run int, label long, score double")
    swept = spark.createDataFrame([(r, p, 1.0, 0.1 * (r + 1)) for r in range(3) for p in range(2)], "run int, patch_id long, dpc double, pc double")
    robust = spark.createDataFrame([(1, 2.0, 3, True), (2, 1.0, 3, True), (3, 0.5, 0, False), (4, 9.0, 3, True)], "label long, mean_score double, top_decile_runs long, robust boolean")
    area = spark.createDataFrame([(1, 2.25), (2, 3.0), (3, 50.0)], "label long, area_ha double")
    nodes = spark.createDataFrame([("pa_state",), ("pa_state",), ("habitat_s10",), ("old_stand",)], "node_type string")
    told = {(r.section, r.item, r.metric): r.value for r in modules.network_report(nodes, {"connectivity": found, "scores": scores}, {"connectivity": swept, "robust": robust}, area, top=3).collect()}
    assert told == {
        ("nodes", "pa_state", "n_nodes"): 2.0, ("nodes", "habitat_s10", "n_nodes"): 1.0, ("nodes", "old_stand", "n_nodes"): 1.0,
        ("network", "", "n_patches"): 12.0, ("network", "", "probability_of_connectivity"): 0.25, ("network", "", "n_stands_scored"): 6.0,
        ("top_patches", "0", "dpc_pct"): 40.0, ("top_patches", "1", "dpc_pct"): 39.0, ("top_patches", "2", "dpc_pct"): 38.0,
        ("sweep", "", "n_runs"): 3.0, ("sweep", "", "pc_min"): 0.1, ("sweep", "", "pc_max"): 0.3, ("sweep", "", "n_robust_stands"): 3.0, ("sweep", "", "robust_stand_area_ha"): 5.2,
    }
    empty = modules.network_report(nodes.limit(0), {"connectivity": found.limit(0), "scores": scores.limit(0)}, {"connectivity": swept.limit(0), "robust": robust.limit(0)}, area).collect()
    assert not [r for r in empty if r.section in ("nodes", "top_patches")] and {r.value for r in empty if r.metric == "n_robust_stands"} == {0.0}


def test_planning_report_makes_its_tables_once(spark, monkeypatch):
    from timbergrid.plans import catalogue, proxies

    made, own = [], proxies.frame
    monkeypatch.setattr(proxies, "frame", lambda s, d, name: made.append(name) or own(s, d, name))
    monkeypatch.setattr(modules, "planning_report", lambda **parts: parts["dead"])
    catalogue.c05_planning_report(spark, "/root/testdata/sf0.001")
    assert made.count("grid") == 1 and made.count("weather") == 1
