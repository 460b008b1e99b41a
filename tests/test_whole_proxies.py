from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from timbergrid.plans import catalogue, proxies


@pytest.fixture
def tables(spark, tmp_path):
    spark.range(1, 91).select(F.col("id").alias("s_suppkey"), F.col("id").cast("int") % 25).toDF("s_suppkey", "s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    cells = [(r, c) for r in (2, 3, 6, 7, 28) for c in (1, 7, 8)]
    items = [(r, c, 1, 100) for r, c in cells] + [(20, 20, 1, 3)]
    spark.createDataFrame(items, "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path), cells


def test_edges_are_those_of_all_suppliers(spark, tables):
    got = {(r.i, r.j, r.cost) for r in proxies.frame(spark, tables[0], "edges").collect()}
    nation = {k: k % 25 for k in range(1, 91)}
    pairs = [(i, i + 2**n) for i in nation for n in range(10) if i + 2**n in nation and nation[i] % 2 == nation[i + 2**n] % 2]
    assert got == {(i, j, float((37 * i + 37 * j) % 991 + j - i)) for i, j in pairs}
    near = {}
    for i, j, cost in got:
        near.setdefault(i, []).append((cost, j))
        near.setdefault(j, []).append((cost, i))
    assert set(near) == set(nation)
    want = {(min(i, j), max(i, j)) for i, each in near.items() for _, j in sorted(each)[:3]}
    assert {(r.i, r.j) for r in catalogue.queries()["w11_backbone"](spark, tables[0]).collect()} == want


def test_patches_are_those_of_all_cells(spark, tables):
    sf, cells = tables
    got = {(r.row, r.col) for r in catalogue.queries()["r10_r11_patches"](spark, sf).collect()}
    # All but the lone cell (28, 1), which is smaller than a patch.
    assert {c for c in cells if c != (28, 1)} <= got and (20, 20) not in got
