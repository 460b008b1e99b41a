"""Domain tables derived from the supplied ones, as SQL that Spark and DuckDB both run.

``{orders}`` and the like stand for a table: a DataFrame in Spark, a view's name in DuckDB. ``{side}`` is the number of
rows and of columns of the grid, which grows with the root of the table that it is made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "weather": """
select station, d as date,
       case when ok % 3 = 0 then -1.0e0 else (ck % 200)/10.0e0 end as rrday,
       (170 - 2*tri + ok % 81 - 40)/10.0e0 + 5.0e0 as tday,
       (170 - 2*tri + ok % 81 - 40)/10.0e0 as tmin,
       case when tri > 120 then cast(tri - 120 + ck % 7 as double) else -1.0e0 end as snow
from (select cast(o_orderkey % 3 as int) as station, cast(o_orderdate as date) as d, cast(sum(o_orderkey) as bigint) as ok,
             cast(sum(o_custkey) as bigint) as ck,
             abs(dayofyear(cast(o_orderdate as date)) - 200) as tri
      from {orders} group by 1, 2, 5) q""",
    "stands": """
select p_partkey as stand_row, cast(p_size + 15 as varchar(10)) as soiltype,
       1 + p_partkey % 6 as fertilityclass, 1 + p_partkey % 9 as drainagestate,
       ((p_partkey*37) % 101)/100.0e0 as proportionspruce,
       ((p_partkey*53) % (101 - (p_partkey*37) % 101))/100.0e0 as proportionpine,
       ((p_partkey*17) % 97 + 3)/8.0e0 as area,
       (p_partkey*13) % 161 as meanage, (p_partkey*7) % 40 as basalarea,
       (p_partkey*7919) % 50000 as x, (p_partkey*104729) % 68000 as y
from {part}""",
    "habitats": """
select s_suppkey as hid, cast(1 + 2*(s_suppkey % 2) as int) as habitattype,
       (s_suppkey*6271) % 50000 as hx, (s_suppkey*90001) % 68000 as hy from {supplier}""",
    "declarations": """
select l_orderkey * 8 + l_linenumber as decl_id, cast(l_suppkey % 3 as int) as station, cast(l_shipdate as date) as date,
       cast(cast(l_quantity as bigint) + 15 as varchar(10)) as soiltype,
       ((l_partkey*37) % 101)/100.0e0 as proportionspruce, ((l_partkey*53) % (101 - (l_partkey*37) % 101))/100.0e0 as proportionpine,
       (l_partkey % 97)/16.0e0 as dtw_050, (l_partkey % 97)/16.0e0 + 0.25e0 as dtw_1, (l_partkey % 97)/16.0e0 + 0.5e0 as dtw_2,
       (l_partkey % 97)/16.0e0 + 1.0e0 as dtw_4, (l_partkey % 97)/16.0e0 + 2.0e0 as dtw_10
from {lineitem}""",
    "grid": """
select cast(l_partkey % {side} as int) as row, cast(l_suppkey % {side} as int) as col, cast(sum(l_linenumber) as double) as z,
       cast(max(l_linenumber) as int) as klass, cast(sum(l_partkey) % 50 as int) as clc, cast(1 + sum(l_suppkey) % 4 as int) as soil,
       cast(sum(l_orderkey) % 300 as double) as accum_cells, cast(sum(l_orderkey) % 640 as double) / 64.0e0 as dtw
from {lineitem} group by 1, 2""",
    "edges": """
select 0 as run, a.s_suppkey as i, b.s_suppkey as j, cast((37*a.s_suppkey + 37*b.s_suppkey) % 991 + abs(a.s_suppkey - b.s_suppkey) as double) as cost
from (select s_suppkey, s_nationkey, s_suppkey + n as near
      from {supplier} cross join (values (1), (2), (4), (8), (16), (32), (64), (128), (256), (512)) as o(n)) a
join {supplier} b on b.s_suppkey = a.near and b.s_nationkey % 2 = a.s_nationkey % 2""",
}
#: The grid's side: about 40 items to a cell, 40 cells at least.
SIDE_SQL = "(select greatest(40, cast(floor(sqrt(count(*) / 40.0e0)) as bigint)) from {lineitem})"
_TABLES = ("orders", "part", "supplier", "lineitem")


def side(spark: SparkSession, sf_dir: str) -> int:
    return spark.sql("select " + SIDE_SQL + " as side", lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")).first()["side"]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used: dict = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"{{{t}}}" in SQL[name]}
    if "{side}" in SQL[name]:
        used["side"] = side(spark, sf_dir)
    return spark.sql(SQL[name], **used)


def ctes(*names: str) -> str:
    """``with`` clause of the tables, for the SQL that results are held against."""
    told = {t: t for t in _TABLES}
    return "with " + ",\n".join(f"{n} as ({SQL[n].format(**told, side=SIDE_SQL.format(**told))})" for n in names) + "\n"
