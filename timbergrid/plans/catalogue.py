"""The registered queries and the SQL that they are held against; keys carry the operators' ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbergrid.functions import rules as R
from timbergrid.operators import hydrology, network, raster, spatial, stands, stats, weather
from timbergrid.operators.checkpoints import cut
from timbergrid.plans import modules, proxies
from timbergrid.plans.config import Resistance, Sweep, perturbed
from timbergrid.sources import layers
from timbergrid.streaming.weather import daily_values

Query = Callable[[SparkSession, str], DataFrame]
RES = 16.0
WIDTHS = (10.0, 20.0, 30.0)
FEATURE_Z = 150.0
BANDS = {0.5: "dtw_050", 1.0: "dtw_1", 2.0: "dtw_2", 4.0: "dtw_4", 10.0: "dtw_10"}
K_TABLE = {1: 0.013, 2: 0.043, 3: 0.031}
C_TABLE = {12: 0.15, 25: 0.0015, 33: 0.1}
#: What the SQL of a query says that has a table which refers to itself.
RECURSIVE = " from w join "
_found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, *tables: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        told = sql
        if sql is not None and tables:
            told = proxies.ctes(*tables) + (", " + sql.lstrip()[5:] if sql.lstrip().startswith("with ") else sql)
            if RECURSIVE in sql:
                told = told.replace("with ", "with recursive ", 1)
        _found[f.__name__] = f, told
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _grid(spark: SparkSession, sf: str) -> spatial.Grid:
    n = proxies.side(spark, sf)
    return spatial.Grid(0.0, n * RES, RES, n, n)


SIDE = proxies.SIDE_SQL.format(lineitem="lineitem")


@query(
    """select stand_row, coalesce(try_cast(soiltype as double) > 59, false) as is_peat,
case when coalesce(try_cast(soiltype as double) > 59, false) then proportionspruce >= 0.5e0 else proportionpine + proportionspruce >= 0.5e0 end as rootrot_obligation,
coalesce(try_cast(soiltype as double) >= 60 and fertilityclass <= 3 and drainagestate in (7, 8, 9) and proportionspruce >= 0.5e0, false) as ccf_prescribed,
area as area_ha from stands""",
    "stands",
)
def p01_p04_stand_rules(spark: SparkSession, sf: str) -> DataFrame:
    return stands.with_rules(proxies.frame(spark, sf, "stands")).select("stand_row", "is_peat", "rootrot_obligation", "ccf_prescribed", "area_ha")


@query(
    """with s as (select *, cast(soiltype as double) >= 60 as peat, drainagestate in (7, 8, 9) as dr, fertilityclass <= 3 and proportionspruce >= 0.5e0 as ok from stands),
t as (select count(*) filter (peat and dr and ok) as n_ccf, sum(area) as all_ha, round_even(coalesce(sum(area) filter (peat), 0), 1) as peat_ha, round_even(coalesce(sum(area) filter (peat and dr), 0), 1) as drained_ha,
round_even(coalesce(sum(area) filter (peat and dr and ok), 0), 1) as ccf_ha, round_even(coalesce(sum(area) filter (peat and dr and ok and fertilityclass <= 2), 0), 1) as ccf_strict_ha from s)
select n_ccf, round_even(all_ha, 1) as total_ha, peat_ha, drained_ha, ccf_ha, ccf_strict_ha, round_even(100 * ccf_ha / nullif(drained_ha, 0), 2) as ccf_of_drained_pct, round_even(100 * ccf_ha / nullif(all_ha, 0), 2) as ccf_of_total_pct from t""",
    "stands",
)
def a01_ccf_area_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stands.ccf_area_summary(proxies.frame(spark, sf, "stands"))


@query(
    """with s as (select area, proportionspruce >= 0.5e0 as rot from stands where cast(soiltype as double) >= 60 and drainagestate in (7, 8, 9) and fertilityclass <= 3 and proportionspruce >= 0.5e0)
select coalesce(sum(area), 0) as ccf_ha, coalesce(sum(area) filter (rot), 0) as conflict_ha, count(*) filter (rot) as n_conflict, round_even(coalesce(sum(area) filter (rot), 0) / nullif(coalesce(sum(area), 0), 0), 3) as conflict_share from s""",
    "stands",
)
def a02_ccf_rootrot_conflict(spark: SparkSession, sf: str) -> DataFrame:
    return stands.ccf_rootrot_conflict(proxies.frame(spark, sf, "stands"))


@query("select round_even(sum(area), 1) as area_ha, round_even(sum(area) * 5.5e0, 0) as deadwood_m3, round_even(sum(area) * (5.5e0 * 0.3e0), 0) as standing_m3 from stands", "stands")
def a03_deadwood(spark: SparkSession, sf: str) -> DataFrame:
    return stands.deadwood(proxies.frame(spark, sf, "stands"))


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    left = spatial.points(proxies.frame(spark, sf, "stands"), "stand_row", "x", "y")
    return spatial.nearest(left, spatial.points(proxies.frame(spark, sf, "habitats"), "hid", "hx", "hy"))


NEAREST = """with n as (select stand_row, min(struct_pack(d2 := (x - hx) * (x - hx) + (y - hy) * (y - hy), hid := hid)) as b from stands, habitats group by stand_row)"""


@query(NEAREST + " select stand_row, b.hid as habitat_id, cast(b.d2 as bigint) as d2 from n", "stands", "habitats")
def j04_nearest_habitat(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf).select(F.col("id").alias("stand_row"), F.col("other").alias("habitat_id"), F.col("d2").cast("long").alias("d2"))


@query(
    NEAREST
    + """, r as (select s.area, n.b.d2 as d2, h.habitattype as t from n join stands s using (stand_row) join habitats h on h.hid = n.b.hid),
w as (select unnest([500e0, 1000e0, 2000e0]) as width)
select width, count(*) filter (d2 <= width * width) as n_stands, coalesce(sum(area) filter (d2 <= width * width), 0) as area_ha, coalesce(sum(area) filter (d2 <= width * width and t = 1), 0) as type_1_ha,
coalesce(sum(area) filter (d2 <= width * width and t = 3), 0) as type_3_ha from r, w group by width""",
    "stands",
    "habitats",
)
def a04_habitat_proximity(spark: SparkSession, sf: str) -> DataFrame:
    near = _nearest(spark, sf).select(F.col("id").alias("stand_row"), F.sqrt("d2").alias("nearest_m"), F.col("other").alias("hid"))
    rows = proxies.frame(spark, sf, "stands").withColumn("area_ha", stands.area()).join(near, "stand_row", "left").join(proxies.frame(spark, sf, "habitats"), "hid", "left")
    return stands.proximity_report(rows, (500.0, 1000.0, 2000.0), (1, 3))


@query("select distinct stand_row as id from stands, habitats where (x - hx) * (x - hx) + (y - hy) * (y - hy) <= 1500 * 1500", "stands", "habitats")
def j05_setback_violation(spark: SparkSession, sf: str) -> DataFrame:
    left = spatial.points(proxies.frame(spark, sf, "stands"), "stand_row", "x", "y")
    return spatial.too_close(left, spatial.points(proxies.frame(spark, sf, "habitats"), "hid", "hx", "hy"), 1500.0)


@query(
    NEAREST
    + f""", rs as (select 68000e0 / {SIDE} as res, {SIDE} as side), sc as (select row as fr, col as fc from grid where accum_cells >= 270), cell as (select stand_row, round_even((68000 - y) / res, 0) as r, round_even(x / res, 0) as c, res from stands, rs where round_even((68000 - y) / res, 0) < side and round_even(x / res, 0) < side),
sd as (select stand_row, sqrt(min((r - fr) * (r - fr) + (c - fc) * (c - fc))) * min(res) as st from cell, sc group by stand_row)"""
    + """, r as (select s.*, sd.st, sqrt(n.b.d2) as m, cast(soiltype as double) > 59 as peat, cast(soiltype as double) >= 60 and fertilityclass <= 3 and drainagestate in (7, 8, 9) and proportionspruce >= 0.5e0 as ccf from n join stands s using (stand_row) left join sd using (stand_row))
select stand_row, round_even(area, 3) as area_ha, peat as is_peat, round_even(proportionspruce, 3) as spruce_share, case when peat then proportionspruce >= 0.5e0 else proportionpine + proportionspruce >= 0.5e0 end as rootrot_obligation,
ccf as ccf_prescribed, round_even(m, 1) as nearest_habitat_m, m <= 2000 as within_habitat_setback, round_even(st, 1) as nearest_derived_stream_m, coalesce(st <= 30, false) as within_stream_buffer,
case when peat or ccf then 'frozen-ground / winter preferred' else 'no trafficability restriction' end as harvest_timing from r""",
    "stands",
    "habitats",
    "grid",
)
def c01_site_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = proxies.frame(spark, sf, "stands")
    habitat = _nearest(spark, sf).select(F.col("id").alias("stand_row"), F.sqrt("d2").alias("nearest_habitat_m"))
    n = proxies.side(spark, sf)
    grid = spatial.Grid(0.0, 68000.0, 68000.0 / n, n, n)
    streams = proxies.frame(spark, sf, "grid").select("row", "col", F.when(F.col("accum_cells") >= 270, 1.0).otherwise(-32768.0).alias("stream"))
    stream = modules.stream_distance(rows, raster.stream_cells(streams), grid)
    return stands.site_plan(rows, habitat, stream, 2000.0, 30.0)


RAIN = "case when rrday < 0 then 0e0 else rrday end"
API = f"""with a as (select station, date, {", ".join(f"sum({RAIN}) over (partition by station order by date rows between {w - 1} preceding and current row) as api_{w}" for w in (7, 14, 30))},
greatest(coalesce(lag(case when snow < 0 then 0e0 else snow end) over (partition by station order by date) - case when snow < 0 then 0e0 else snow end, 0e0), 0e0) as melt from weather)"""
WET = API + """, sc as (select *, round((api_7 * 3e0 + api_14 * 2e0 + api_30 * 1e0) / 6e0 + 2e0 * melt, 6) as score from a),
wet as (select station, date, score, (rank() over (partition by station order by score) + (count(*) over (partition by station, score) - 1) / 2) / count(*) over (partition by station) as wetness from sc)"""


@query(API + " select station, date, round(api_7, 6) as api_7, round(api_14, 6) as api_14, round(api_30, 6) as api_30, melt from a", "weather")
def w01_w02_antecedent_and_melt(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weather.snowmelt(weather.antecedent(proxies.frame(spark, sf, "weather"))).select("station", "date", "api_7", "api_14", "api_30", "melt"))


@query(WET + " select station, date, round(wetness, 6) as wetness from wet", "weather")
def w03_wetness_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weather.wetness_percentile(proxies.frame(spark, sf, "weather")).select("station", "date", "wetness"))


FROST = """with frost as (select station, date, bool_or(tmin < -10) over (partition by station order by date range between interval 20 days preceding and current row) as had_frost from weather)"""


@query(FROST + " select station, date, had_frost from frost", "weather")
def w04_frost_look_back(spark: SparkSession, sf: str) -> DataFrame:
    return weather.frost_look_back(proxies.frame(spark, sf, "weather")).select("station", "date", "had_frost")


@query(FROST + " select d.decl_id, coalesce(f.had_frost, false) as cold_spell_exempt from declarations d asof left join frost f on d.station = f.station and d.date >= f.date", "weather", "declarations")
def j03_cold_spell_exemption(spark: SparkSession, sf: str) -> DataFrame:
    return weather.cold_spell_exempt(proxies.frame(spark, sf, "declarations"), proxies.frame(spark, sf, "weather")).select("decl_id", "cold_spell_exempt")


@query(
    FROST
    + """, r as (select d.*, coalesce(f.had_frost, false) as ex, case when cast(soiltype as double) > 59 then proportionspruce >= 0.5e0 else proportionpine + proportionspruce >= 0.5e0 end as trig, strftime(d.date, '%m-%d') between '05-01' and '11-30' as per
from declarations d asof left join frost f on d.station = f.station and d.date >= f.date)
select decl_id, trig as species_soil_trigger, per as in_mandatory_period, ex as cold_spell_exempt, trig and per and not ex as treatment_required from r""",
    "weather",
    "declarations",
)
def c02_obligation(spark: SparkSession, sf: str) -> DataFrame:
    rows = stands.obligation(proxies.frame(spark, sf, "declarations"), proxies.frame(spark, sf, "weather"))
    return rows.select("decl_id", "species_soil_trigger", "in_mandatory_period", "cold_spell_exempt", "treatment_required")


RUNS = """with f as (select *, {flag} as flag from weather), i as (select *, row_number() over (partition by station{extra} order by date) - row_number() over (partition by station{extra}, flag order by date) as g from f),
r as (select *, case when flag then count(*) over (partition by station{extra}, flag, g) end as n from i)"""
FROZEN = RUNS.format(flag="tmin <= -2", extra="")


@query(FROZEN + " select station, date, coalesce(n >= 3, false) as frozen from r", "weather")
def w06_frozen_ground(spark: SparkSession, sf: str) -> DataFrame:
    return weather.frozen_ground(proxies.frame(spark, sf, "weather")).select("station", "date", "frozen")


@query(FROZEN + " select station, min(date) as start, max(date) as end, count(*) as days from r where flag and n >= 3 group by station, g", "weather")
def w07_runs(spark: SparkSession, sf: str) -> DataFrame:
    return weather.runs_at_least(proxies.frame(spark, sf, "weather"), F.col("tmin") <= -2, 3)


@query(
    RUNS.format(flag="tday >= 5", extra=", year(date)")
    + """, s as (select station, year(date) as y, min(date) as a, max(date) as b from r where flag and n >= 5 group by station, year(date), g)
select w.station, cast(w.y as int) as year, min(a) as season_start, max(b) as season_end from (select distinct station, year(date) as y from weather) w left join s on s.station = w.station and s.y = w.y group by 1, 2""",
    "weather",
)
def w08_spore_season(spark: SparkSession, sf: str) -> DataFrame:
    return weather.spore_season(proxies.frame(spark, sf, "weather"))


WINTERS = FROZEN + """, v as (select station, cast(year(date) - case when month(date) < 7 then 1 else 0 end as int) as winter, count(*) filter (coalesce(n >= 3, false) and not strftime(date, '%m-%d') between '05-01' and '11-30') as days,
count(*) filter (coalesce(n >= 3, false)) as frozen_days, count(*) as n_rows from r group by 1, 2 having count(*) >= 100)"""


@query(WINTERS + " select * from v", "weather")
def a11_conflict_free_winters(spark: SparkSession, sf: str) -> DataFrame:
    return weather.conflict_free_days(proxies.frame(spark, sf, "weather"), least_rows=100)


@query(WINTERS + " select station, cast(floor(winter / 10) * 10 as int) as decade, round(avg(days), 6) as mean_days, count(*) as winters from v group by 1, 2", "weather")
def a11_conflict_free_decades(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weather.conflict_free_decades(proxies.frame(spark, sf, "weather"), least_rows=100))


@query()
def w09_trend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weather.trend(weather.conflict_free_days(proxies.frame(spark, sf, "weather"), least_rows=100), "winter", "days"))


WORK = WET.replace("with a as", "a as", 1) + """, j as (select d.*, w.wetness, coalesce(z.n >= 3, false) as frozen from declarations d left join wet w on w.station = d.station and w.date = d.date left join r z on z.station = d.station and z.date = d.date),
th as (select *, case when wetness >= 1 then 0.5e0 when wetness >= 0.75e0 then exp(ln(1e0) + (wetness - 0.75e0) * (ln(0.5e0) - ln(1e0)) / 0.25e0) when wetness >= 0.5e0 then exp(ln(2e0) + (wetness - 0.5e0) * (ln(1e0) - ln(2e0)) / 0.25e0)
when wetness >= 0.25e0 then exp(ln(4e0) + (wetness - 0.25e0) * (ln(2e0) - ln(4e0)) / 0.25e0) when wetness >= 0 then exp(ln(10e0) + wetness * (ln(4e0) - ln(10e0)) / 0.25e0) end as t from j),
bl as (select *, case when t <= 0.5e0 then dtw_050 when t <= 1 then dtw_050 + (ln(t) - ln(0.5e0)) / (ln(1e0) - ln(0.5e0)) * (dtw_1 - dtw_050) when t <= 2 then dtw_1 + (ln(t) - ln(1e0)) / (ln(2e0) - ln(1e0)) * (dtw_2 - dtw_1)
when t <= 4 then dtw_2 + (ln(t) - ln(2e0)) / (ln(4e0) - ln(2e0)) * (dtw_4 - dtw_2) when t <= 10 then dtw_4 + (ln(t) - ln(4e0)) / (ln(10e0) - ln(4e0)) * (dtw_10 - dtw_4) else dtw_10 end as m from th)
"""


@query(
    FROZEN + ", " + WORK + "select decl_id, round(wetness, 6) as wetness, round(t, 6) as threshold, round(case when t is not null then m end, 6) as dtw_m, frozen, round(case when t is not null then m end * case when cast(soiltype as double) > 59 then 0.5e0 else 1e0 end, 6) as adjusted_dtw_m from bl",
    "weather",
    "declarations",
)
def c03_declaration_workability(spark: SparkSession, sf: str) -> DataFrame:
    rows = stands.workability(proxies.frame(spark, sf, "declarations"), proxies.frame(spark, sf, "weather"), BANDS)
    return rounded(rows.select("decl_id", "wetness", "threshold", "dtw_m", "frozen", "adjusted_dtw_m"))


@query()
def c04_a10_concordance(spark: SparkSession, sf: str) -> DataFrame:
    d, w = proxies.frame(spark, sf, "declarations"), proxies.frame(spark, sf, "weather")
    return stands.concordance(stands.workability(d, w, BANDS), stands.workability(stands.control_dates(d), w, BANDS))


@query("select date, round(avg(rrday), 6) as rrday, round(avg(snow), 6) as snow from weather group by date", "weather")
def s20_pivot(spark: SparkSession, sf: str) -> DataFrame:
    w = proxies.frame(spark, sf, "weather").withColumns({c: F.col(c).cast("string") for c in ("rrday", "snow")})
    return rounded(weather.wide(w.unpivot(["date"], ["rrday", "snow"], "param", "value"), ["rrday", "snow"], ()))


def near(derived: str = "z > 150 and row % 2 = 0", mapped: str = "z > 150 and row % 2 = 1") -> str:
    """SQL: every cell with the least squared distances, a and b, to two sets of cells."""
    return f"""with s as (select row as fr, col as fc, {derived} as is_a, {mapped} as is_b from grid), c as (select * from (select unnest(range(0, {SIDE})) as row) r, (select unnest(range(0, {SIDE})) as col) k),
d as (select row, col, min((row - fr) * (row - fr) + (col - fc) * (col - fc)) filter (is_a) as a, min((row - fr) * (row - fr) + (col - fc) * (col - fc)) filter (is_b) as b from c left join (select * from s where is_a or is_b) f on true group by row, col)"""


NEAR = near()
BUFFERS = """, w as (select unnest([10e0, 20e0, 30e0]) as width), e as (select *, coalesce(a * 256 <= width * width, false) as na, coalesce(b * 256 <= width * width, false) as nb from d, w)
select width, round_even(count(*) filter (na) * 0.0256e0, 1) as derived_ha, round_even(count(*) filter (nb) * 0.0256e0, 1) as mapped_ha, round_even(count(*) filter (na and not nb) * 0.0256e0, 1) as additional_ha from e group by width
having count(*) filter (na or nb) > 0"""


def _features(spark: SparkSession, sf: str, side: int) -> DataFrame:
    return proxies.frame(spark, sf, "grid").where((F.col("z") > FEATURE_Z) & (F.col("row") % 2 == side)).select("row", "col")


@query(NEAR + BUFFERS, "grid")
def a05_buffer_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return raster.buffer_report(_features(spark, sf, 0), _features(spark, sf, 1), _grid(spark, sf), WIDTHS)


@query(NEAR + " select cast(row as int) as row, cast(col as int) as col, cast(a as bigint) as d2 from d where a is not null", "grid")
def r05_distance_transform(spark: SparkSession, sf: str) -> DataFrame:
    return raster.distance_everywhere(_features(spark, sf, 0), _grid(spark, sf))


SLOPE = """with g as (select row, col, z, lag(z) over x as l, lead(z) over x as r, lag(z) over y as u, lead(z) over y as d from grid window x as (partition by row order by col), y as (partition by col order by row)),
sl as (select row, col, degrees(atan(sqrt(power(case when l is null and r is null then 0 when l is null then (r - z) / 16e0 when r is null then (z - l) / 16e0 else (r - l) / 32e0 end, 2) + power(case when u is null and d is null then 0 when u is null then (d - z) / 16e0 when d is null then (z - u) / 16e0 else (d - u) / 32e0 end, 2)))) as slope_deg from g)"""


@query(SLOPE + " select row, col, round(slope_deg, 6) as slope_deg from sl", "grid")
def r07_slope(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(raster.slope_degrees(proxies.frame(spark, sf, "grid"), RES))


def _loss(spark: SparkSession, sf: str) -> DataFrame:
    return _loss_of(proxies.frame(spark, sf, "grid"))


def _loss_of(g: DataFrame) -> DataFrame:
    return raster.soil_loss(g.join(raster.slope_degrees(g, RES), ["row", "col"]), RES, K_TABLE, C_TABLE, 300.0)


LOSS = SLOPE + """, lo as (select row, col, power(least(accum_cells * 16, 100) / 22.13e0, 0.4e0) * power(sin(radians(slope_deg)) / 0.0896e0, 1.3e0) as ls,
case soil when 1 then 0.013e0 when 2 then 0.043e0 when 3 then 0.031e0 else 0.025e0 end as k, case clc when 12 then 0.15e0 when 25 then 0.0015e0 when 33 then 0.1e0 else 0.01e0 end as c from grid join sl using (row, col))"""


@query(LOSS + " select row, col, round(ls, 6) as ls, k, c, round(300e0 * (k * ls * c), 6) as a from lo", "grid")
def p12_p15_soil_loss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_loss(spark, sf).select("row", "col", "ls", "k", "c", "a"))


ERODED = """, er as (select row, col, 300e0 * (k * ls * c) as a from lo), bo as (select coalesce(quantile_cont(a, 0.9) filter (a > 0), 0e0) as bound from er), w as (select unnest([10e0, 20e0, 30e0]) as width),
h as (select width, coalesce(er.a >= bound, false) as high from d left join er using (row, col), bo, w where d.a * 256 <= width * width)
select width, round_even(count(*) * 0.0256e0, 1) as buffer_ha, round_even(count(*) filter (high) * 0.0256e0, 1) as high_ha, round_even(count(*) filter (high) / greatest(count(*), 1), 3) as high_share from h group by width"""


@query(LOSS + ", " + NEAR[5:] + ERODED, "grid")
def a06_erosion_in_buffers(spark: SparkSession, sf: str) -> DataFrame:
    return raster.erosion_in_buffers(_loss(spark, sf), _features(spark, sf, 0), _grid(spark, sf), WIDTHS)


@query("select cast(floor(row / 4) as int) as row, cast(floor(col / 4) as int) as col, round(avg(z), 6) as z from grid group by 1, 2", "grid")
def a15_resample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(raster.resample(proxies.frame(spark, sf, "grid"), 16.0, 64.0, "z"))


@query(
    f"select cast(floor(row / 3) as int) as row, cast(floor(col / 3) as int) as col, round(case when avg(z) > 500 then 1000e0 else greatest(avg(z), 0.001e0) end, 6) as cost from grid where row < {SIDE} // 3 * 3 and col < {SIDE} // 3 * 3 group by 1, 2",
    "grid",
)
def a14_coarsened_cost(spark: SparkSession, sf: str) -> DataFrame:
    n = proxies.side(spark, sf)
    return rounded(raster.coarsened(proxies.frame(spark, sf, "grid").withColumnRenamed("z", "cost"), 3, n, n))


@query(
    """with rk as (select dtw as a, z as b, rank() over (order by dtw) + (count(*) over (partition by dtw) - 1) / 2 as ra, rank() over (order by z) + (count(*) over (partition by z) - 1) / 2 as rb from grid)
select count(*) as n, round(corr(a, b), 6) as pearson, round(corr(ra, rb), 6) as spearman, round(avg(a - b), 6) as bias, round(sqrt(avg((a - b) * (a - b))), 6) as rmse, round(median(a), 6) as median_ours, round(median(b), 6) as median_reference from rk""",
    "grid",
)
def a08_w05_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.compared(proxies.frame(spark, sf, "grid"), "dtw", "z"))


def _benchmark(column: str) -> str:
    return f"""select n, case when n >= 100 then round_even(corr_r, 3) end as spearman, case when n >= 100 then round_even(corr_l, 3) end as pearson_log, case when n >= 100 then round_even(ratio, 1) end as median_ratio, '{column}' as label
from (select count(*) as n, corr(ra, rb) as corr_r, corr(ln(1 + a), ln(1 + b)) as corr_l, median(b / greatest(a, 1e-9)) as ratio
from (select a, b, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as rb
from (select {column} as a, mk as b from er where covered and {column} > 0 and mk > 0) p) r) t"""


BENCHMARK = ", er as (select l.*, 300e0 * (k * ls * c) as a, 300e0 * (k * ls * c) + z / 64 as mk, klass > 1 as covered from lo l join grid using (row, col))\n" + " union all ".join(map(_benchmark, ("a", "ls", "k", "c")))


@query(LOSS + BENCHMARK, "grid")
def a07_erosion_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return _benchmark_of(_loss(spark, sf))


def _benchmark_of(loss: DataFrame) -> DataFrame:
    return stats.erosion_benchmark(loss.withColumns({"covered": F.col("klass") > 1, "mk": F.col("a") + F.col("z") / 64}), "mk", ["a", "ls", "k", "c"])


@query(
    """with v as (select 1 + clc % 6 as klass, dtw from grid where dtw > 0), e as (select cast(klass as varchar) as klass, dtw from v union all select '1-3', dtw from v where klass <= 3 union all select 'all', dtw from v),
rk as (select rank() over (order by dtw) + (count(*) over (partition by dtw) - 1) / 2 as ra, rank() over (order by klass) + (count(*) over (partition by klass) - 1) / 2 as rb from v)
select klass, count(*) as n, round_even(median(dtw), 3) as median_dtw, round_even(avg(cast(dtw > 1 as int)), 3) as workable_share, case when klass = 'all' then (select round_even(corr(ra, rb), 3) from rk) end as spearman from e group by klass""",
    "grid",
)
def a09_class_table(spark: SparkSession, sf: str) -> DataFrame:
    return _classes_of(proxies.frame(spark, sf, "grid"))


def _classes_of(g: DataFrame) -> DataFrame:
    return stats.class_table(g.withColumn("klass", 1 + F.col("clc") % 6))


@query(
    """with b as (select i, j, cost from edges union all select j, i, cost from edges), k as (select *, row_number() over (partition by i order by cost, j) as n from b)
select distinct 0 as run, least(i, j) as i, greatest(i, j) as j, cost from k where n <= 3""",
    "edges",
)
def w11_backbone(spark: SparkSession, sf: str) -> DataFrame:
    return network.backbone(proxies.frame(spark, sf, "edges"))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select("run", F.explode(F.array("i", "j")).alias("patch_id")).distinct().withColumns({"area_ha": (F.col("patch_id") * 17 % 97 + 3) / 8, "dispersal": F.lit(400.0)})


#: Least sums over walks of 1, 2 and so on edges, up to as many as there are nodes.
PATHS = """with b as (select i, j, cost / 400e0 as c from edges union all select j, i, cost / 400e0 from edges), nd as (select distinct i as k, (i * 17 % 97 + 3) / 8e0 as area from b),
w as (select 0 as n, k as i, k as j, 0e0 as d from nd union all select w.n + 1, w.i, b.j, min(w.d + b.c) from w join b on b.i = w.j where w.n < (select count(*) from nd) group by w.n + 1, w.i, b.j),
p as (select i, j, exp(-min(d)) as p from w group by i, j)"""


@query(PATHS + " select 0 as run, i, j, round(p, 6) as p from p", "edges")
def g02_max_product(spark: SparkSession, sf: str) -> DataFrame:
    edges = proxies.frame(spark, sf, "edges")
    return rounded(network.max_product(edges, _nodes(edges)))


@query(
    PATHS
    + """, r as (select p.i, a.area as ai, sum(b.area * p.p) as s from p join nd a on a.k = p.i join nd b on b.k = p.j group by 1, 2), t as (select sum(ai * s) as total, sum(ai) as area from r)
select 0 as run, i as patch_id, round(100 * (2 * ai * s - ai * ai) / total, 6) as dpc, round(total / (area * area), 6) as pc from r, t""",
    "edges",
)
def a13_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    edges = proxies.frame(spark, sf, "edges")
    return rounded(network.connectivity_of(edges, _nodes(edges)))


def _patches(g: DataFrame, least: int = 4) -> DataFrame:
    """Patches of the cells in the highest tenth of z, of ``least`` cells or more."""
    cells = g.join(F.broadcast(stats.quantiles(g, "z", [0.9]).select(F.col("value").alias("bound"))), F.col("z") >= F.col("bound"))  # one row
    return network.patches(cells.select("row", "col"), 1.0, RES * RES / 1e4, least * RES * RES / 1e4)


CLOSED = """with bo as (select quantile_cont(z, 0.9) as bound from grid), nd as (select row, col from grid, bo where z >= bound), pl as (select * from (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) as o(dr, dc)),
gr as (select distinct row + dr as row, col + dc as col from nd, pl), ri as (select distinct g.row + a as row, g.col + b as col from gr g, (values (-1), (0), (1)) x(a), (values (-1), (0), (1)) y(b)),
ed as (select * from ri anti join gr using (row, col)), sh as (select distinct row + dr as row, col + dc as col from ed, pl), cl as (select * from gr anti join sh using (row, col) union select * from nd),
w as (select row as sr, col as sc, row, col from cl union select w.sr, w.sc, n.row, n.col from w join cl n on abs(n.row - w.row) <= 1 and abs(n.col - w.col) <= 1),
c as (select row, col, min(sr * 4294967296 + sc) as patch_id from w group by row, col), a as (select patch_id, count(*) * 0.0256e0 as area_ha from c group by patch_id)"""


@query(CLOSED + " select row, col, patch_id, area_ha from c join a using (patch_id) where area_ha >= 2 * 0.0256e0", "grid")
def r10_r11_patches(spark: SparkSession, sf: str) -> DataFrame:
    return _patches(cut(proxies.frame(spark, sf, "grid")), 2)


def _sweep(g: DataFrame, n: int, settings: list, patch: DataFrame, connected: bool = True) -> dict[str, DataFrame]:
    c = F.col
    cells = g.select("row", "col", "clc", (c("z") % 161).alias("meanage"), (c("z") % 40).alias("basalarea"), (c("z") % 101 / 100).alias("proportionother"))
    labels = g.select("row", "col", (F.floor(c("row") / 4) * n + F.floor(c("col") / 4)).cast("long").alias("label"))
    return network.sweep(cells, patch, labels, settings, n, n, connected=connected)


# The proxy's grid is small at small scale factors: blocks of four cells instead of eight.
NETWORK = Resistance(coarsen=4)


@query()
def g01_g04_sweep(spark: SparkSession, sf: str) -> DataFrame:
    g = cut(proxies.frame(spark, sf, "grid"))  # all runs read it
    return rounded(_sweep(g, proxies.side(spark, sf), perturbed(NETWORK, Sweep()), _patches(g), connected=False)["robust"])


@query()
def c06_network_report(spark: SparkSession, sf: str) -> DataFrame:
    g, n = cut(proxies.frame(spark, sf, "grid")), proxies.side(spark, sf)  # all runs read it
    # The base run, numbered -1, goes with the sweep's.
    told = _sweep(g, n, [(-1, NETWORK), *perturbed(NETWORK, Sweep())], cut(_patches(g)))
    base, swept = ({k: told[k].where(of) for k in ("scores", "connectivity")} for of in ("run < 0", "run >= 0"))
    area = g.groupBy((F.floor(F.col("row") / 4) * n + F.floor(F.col("col") / 4)).cast("long").alias("label")).agg((F.count(F.lit(1)) * RES * RES / 1e4).alias("area_ha"))
    return modules.network_report(_node_sources(spark, sf), base, swept | {"robust": told["robust"]}, area)


def _node_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Habitats stand for protected areas of two sources too, stands of one drainage for supported ones."""
    habitats = proxies.frame(spark, sf, "habitats").withColumnsRenamed({"hx": "x", "hy": "y"})
    rows = proxies.frame(spark, sf, "stands")
    protected = layers.protected_areas({"state": habitats.where("habitattype = 1").select("x", "y"), "private": None, "natura_sac": habitats.where("habitattype = 3").select("x", "y")})
    return layers.nodes(protected, habitats, rows.where("drainagestate = 9"), rows)


@query(
    """select node_type, count(*) as n_nodes from (select case habitattype when 1 then 'pa_state' else 'pa_natura_sac' end as node_type from habitats union all select 'habitat_s10' from habitats
union all select 'ymparistotuki' from stands where drainagestate = 9 union all select 'old_stand' from stands where meanage >= 120) q group by node_type""",
    "habitats",
    "stands",
)
def a16_node_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _node_sources(spark, sf).groupBy("node_type").agg(F.count(F.lit(1)).alias("n_nodes"))


@query()
def r12_r14_depth_to_water(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(hydrology.depth_to_water(_dem(spark, sf), [0.5, 1.0], RES))


def _dem(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.frame(spark, sf, "grid").select("row", "col", (F.col("z") + 7 * F.col("row")).alias("z"))


@query()
def r12_breached_surface(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(hydrology.breached(_dem(spark, sf), 20))


STEPS = "(values (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1)) as o(k, dr, dc)"
AROUND = f"e as (select row, col, z + 7 * row as z from grid), n as (select a.row, a.col, a.z, b.z as there, o.k, o.dr, o.dc from e a cross join {STEPS} join e b on b.row = a.row + dr and b.col = a.col + dc)"
CHANNEL_HA = (0.1, 0.3, 0.6)
LINKS = (
    "with "
    + AROUND
    + f""", f as (select row, col, row + dr as tr, col + dc as tc from n where z > there qualify row_number() over (partition by row, col order by (z - there) / case when dr <> 0 and dc <> 0 then sqrt(2e0) else 1e0 end desc, k) = 1),
w as (select row, col from e union all select f.tr, f.tc from w join f using (row, col)), acc as (select row, col, count(*) as n from w group by row, col),
t as (select unnest([{", ".join(f"{t}e0" for t in CHANNEL_HA)}]) as t), s as (select t, row, col from acc, t where n >= t * 10000 / 256),
d as (select s.t, s.row, s.col, f.tr, f.tc from s join f using (row, col) join s x on x.t = s.t and x.row = f.tr and x.col = f.tc), u as (select t, tr as row, tc as col, count(*) as n from d group by 1, 2, 3),
l as (select s.t, s.row as hr, s.col as hc, s.row, s.col from s left join u using (t, row, col) where coalesce(n, 0) <> 1 union all select l.t, l.hr, l.hc, d.tr, d.tc from l join d on d.t = l.t and d.row = l.row and d.col = l.col join u on u.t = l.t and u.row = d.tr and u.col = d.tc and u.n = 1),
m as (select l.t, hr, hc, sum(case when d.row <> tr and d.col <> tc then sqrt(2e0) * 16 else 16 end) as m from l join d on d.t = l.t and d.row = l.row and d.col = l.col group by 1, 2, 3)
select t.t as threshold_ha, count(m) as n_segments, round(coalesce(sum(m), 0), 6) as length_m, round(coalesce(max(m), 0), 6) as longest_m from t left join m on m.t = t.t group by t.t"""
)


@query(LINKS, "grid")
def r13_channel_links(spark: SparkSession, sf: str) -> DataFrame:
    flow = cut(hydrology.d8(_dem(spark, sf)))
    return rounded(hydrology.channel_report(cut(hydrology.accumulation(flow)), flow, list(CHANNEL_HA), RES))


def _shared_sql() -> str:
    number = {step: k for k, step in enumerate(hydrology._AROUND)}
    near = "v as (select row, col, z, " + ", ".join(f"max(there) filter (k = {k}) as z{k}" for k in range(8)) + " from n group by row, col, z)"
    facets = []
    for i, (direct, diagonal) in enumerate(hydrology.FACETS):
        a, b = number[direct], number[diagonal]
        facets.append(f"select row, col, {i} as i, {direct[0]} as r1, {direct[1]} as c1, {diagonal[0]} as r2, {diagonal[1]} as c2, z - z{a} as s1, z{a} - z{b} as s2, atan2(z{a} - z{b}, z - z{a}) as g from v")
    return (
        AROUND
        + f""", {near}, fa as ({" union all ".join(facets)}),
sl as (select *, case when g < 0 then s1 when g > pi() / 4 then (s1 + s2) / sqrt(2e0) else sqrt(s1 * s1 + s2 * s2) end as slope, greatest(0e0, least(1e0, g / (pi() / 4))) as p from fa where s1 is not null and s2 is not null),
be as (select * from sl where slope > 0 qualify row_number() over (partition by row, col order by round(slope, 9) desc, i) = 1),
fl as (select row, col, row + r1 as tr, col + c1 as tc, 1 - p as q from be where p < 1 union all select row, col, row + r2, col + c2, p from be where p > 0),
w as (select 0 as n, row, col, 1e0 as m from e union all select w.n + 1, fl.tr, fl.tc, sum(w.m * fl.q) from w join fl using (row, col) group by w.n + 1, fl.tr, fl.tc)
select row, col, round(sum(m), 6) as accum_cells from w group by row, col"""
    )


@query("with " + _shared_sql(), "grid")
def r14_shared_accumulation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(hydrology.shared_accumulation(hydrology.d_infinity(_dem(spark, sf))))


@query(
    """with w as (select user_id as station, cast(ts as date) as date, value from events)
select station, date, count(value) as n, round(avg(value), 6) as mean_value, min(value) as least, max(value) as most from w group by 1, 2"""
)
def t01_daily_values(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(daily_values(spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("user_id", "station")), 6)


@query("select row, col, clc, round(case when clc in (42, 46, 47, 48, 49) then 1000e0 else 1e0 + 99e0 * t end, 6) as cost from (select row, col, clc, case when clc between 1 and 16 then 0.9e0 when clc between 17 and 22 then 0.8e0 when clc between 23 and 30 then 0.1e0 when clc in (31, 32) then 0.55e0 when clc between 33 and 37 then 0.5e0 when clc in (38, 39, 40, 44) then 0.7e0 when clc in (41, 43, 45) then 0.4e0 else 0.61875e0 end as t from grid) q", "grid")
def p16_p18_land_cover_resistance(spark: SparkSession, sf: str) -> DataFrame:
    cover = R.land_cover_term(F.col("clc"))
    return rounded(proxies.frame(spark, sf, "grid").select("row", "col", "clc", R.resistance([(1.0, cover)], F.col("clc")).alias("cost")))


def _resistance_sql() -> str:
    """Squares about the stands, as wide as their area tells; a cell belongs to a square that holds its centre."""
    cfg = Resistance()
    cover = "case " + " ".join(f"when clc in ({', '.join(map(str, codes))}) then {cfg.land_cover[name]}e0" for name, codes in cfg.classes.items()) + f" else {sum(cfg.land_cover.values()) / len(cfg.land_cover)}e0 end"
    term = lambda c, most: f"case when {c} is null then t else 1 - least(greatest({c} / {most}e0, 0e0), 1e0) end"
    w = cfg.weights
    blend = f"{w['age']}e0 * {term('meanage', cfg.age_cap)} + {w['structure']}e0 * {term('basalarea', cfg.basal_area_cap)} + {w['species']}e0 * {term('proportionother', cfg.deciduous_share)} + {w['landcover']}e0 * t"
    return f"""with rs as (select 68000e0 / {SIDE} as res, {SIDE} as side), c as (select r.row, k.col, (k.col + 0.5e0) * res as cx, 68000 - (r.row + 0.5e0) * res as cy from rs, (select unnest(range(0, {SIDE})) as row) r, (select unnest(range(0, {SIDE})) as col) k),
b as (select c.row, c.col, arg_max(meanage, stand_row) as meanage, arg_max(basalarea, stand_row) as basalarea, arg_max(1 - proportionspruce - proportionpine, stand_row) as proportionother
from c join stands s on cx >= x - area * 100 and cx < x + area * 100 and cy >= y - area * 100 and cy < y + area * 100 group by c.row, c.col),
j as (select c.row, c.col, coalesce(g.clc, 0) as clc, meanage, basalarea, proportionother from c left join b using (row, col) left join grid g on g.row = c.row and g.col = c.col), q as (select *, {cover} as t from j)
select cast(row as int) as row, cast(col as int) as col, cast(clc as double) as clc, round(case when clc in ({", ".join(map(str, cfg.classes["water"]))}) then {cfg.water}e0 else {cfg.low}e0 + ({blend}) * ({cfg.high}e0 - {cfg.low}e0) end, 9) as cost from q"""


@query(_resistance_sql(), "stands", "grid")
def r09_stand_resistance(spark: SparkSession, sf: str) -> DataFrame:
    n = proxies.side(spark, sf)
    grid = spatial.Grid(0.0, 68000.0, 68000.0 / n, n, n)
    rows = proxies.frame(spark, sf, "stands").withColumn("id", F.col("stand_row")).withColumn("h", F.col("area") * 100)
    at = [(F.col("x") + i * F.col("h"), F.col("y") + j * F.col("h")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    sides = F.array(*[F.struct(*[c.cast("double").alias(name) for c, name in zip((*at[k], *at[(k + 1) % 4]), ("x1", "y1", "x2", "y2"), strict=True)]) for k in range(4)])
    edges = rows.select("id", F.explode(sides).alias("e")).select("id", "e.*")
    attributes = rows.select("id", "meanage", "basalarea", (1 - F.col("proportionspruce") - F.col("proportionpine")).alias("proportionother"))
    return rounded(raster.stand_resistance(edges, attributes, proxies.frame(spark, sf, "grid").select("row", "col", F.col("clc").cast("double").alias("clc")), grid, grid), 9)


def _part(section: str, item: str, metrics: tuple[str, ...], sql: str) -> str:
    rows = ", ".join(f"struct_pack(metric := '{m}', value := cast({m} as double))" for m in metrics)
    return f"select section, item, u.metric as metric, round(u.value, 6) as value from (select '{section}' as section, {item} as item, unnest([{rows}]) as u from ({sql}) x) y"


TREND = """with v as ($winters), p as (select a.station, sign(b.days - a.days) as s from v a join v b on a.station = b.station and b.winter > a.winter),
k as (select station, sum(s) as s, count(*) as pairs, count(*) filter (s = 0) as tied from p group by station), l as (select station, count(*) as n, regr_slope(days, winter) as slope from v group by station)
select station, n, coalesce(s, 0) as s, case when n >= 4 then s / sqrt(pairs * (pairs - tied)) end as tau, case when n >= 4 then slope end as slope from l left join k using (station)"""


def _report_sql() -> str:
    width, g = "cast(cast(width as int) as varchar)", proxies.ctes("grid")
    told = {name: sql for name, (_, sql) in _found.items()}
    parts = [_part(f"buffers_{t:g}ha", width, modules.BUFFER, g + ", " + near(f"accum_cells * 256 >= {t}e0 * 10000", "z > 150")[5:] + BUFFERS) for t in modules.THRESHOLDS_HA]
    parts += [_part(f"erosion_{t:g}ha", width, modules.ERODED, g + ", " + (LOSS + ", " + near(f"accum_cells * 256 >= {t}e0 * 10000", "false")[5:] + ERODED)[5:]) for t in modules.THRESHOLDS_HA]
    for section, item, metrics, name in (
        ("ccf_peatland", "''", modules.CCF, "a01_ccf_area_summary"),
        ("ccf_rootrot_conflict", "''", modules.CONFLICT, "a02_ccf_rootrot_conflict"),
        ("deadwood", "''", modules.DEADWOOD, "a03_deadwood"),
        ("habitat_proximity", width, modules.PROXIMITY, "a04_habitat_proximity"),
        ("felling_window", "station || ' ' || decade", modules.DECADES, "a11_conflict_free_decades"),
        ("felling_winters", "station || ' ' || winter", modules.WINTERS, "a11_conflict_free_winters"),
        ("erosion_benchmark", "label", modules.BENCHMARK, "a07_erosion_benchmark"),
        ("workability_classes", "klass", modules.CLASSES, "a09_class_table"),
    ):
        parts.append(_part(section, item, metrics, told[name]))
    parts.append(_part("felling_ends", "station", modules.ENDS, f"select station, arg_min(mean_days, decade) as first_decade_mean, arg_max(mean_days, decade) as last_decade_mean from ({told['a11_conflict_free_decades']}) q group by station"))
    parts.append(_part("felling_trend", "station", modules.TREND, TREND.replace("$winters", told["a11_conflict_free_winters"])))
    return "\nunion all\n".join(parts)


@query(_report_sql())
def c05_planning_report(spark: SparkSession, sf: str) -> DataFrame:
    found = queries()
    run = lambda name: found[name](spark, sf)
    # Fifteen sections are of the grid or the weather: each is made of the large tables once, not once a section and pass.
    grid, g, w = _grid(spark, sf), cut(proxies.frame(spark, sf, "grid")), cut(proxies.frame(spark, sf, "weather"))
    loss = cut(_loss_of(g))
    mapped = g.where(F.col("z") > FEATURE_Z).select("row", "col")
    streams = {t: hydrology.channels(g, t, RES) for t in modules.THRESHOLDS_HA}
    winters = cut(weather.conflict_free_days(w, least_rows=100))
    return rounded(
        modules.planning_report(
            buffers={t: raster.buffer_report(s, mapped, grid, WIDTHS) for t, s in streams.items()},
            eroded={t: raster.erosion_in_buffers(loss, s, grid, WIDTHS) for t, s in streams.items()},
            ccf=run("a01_ccf_area_summary"), conflict=run("a02_ccf_rootrot_conflict"), dead=run("a03_deadwood"), proximity=run("a04_habitat_proximity"),
            decades=rounded(weather.conflict_free_decades(w, least_rows=100)), winters=winters, trend=rounded(weather.trend(winters, "winter", "days")),
            benchmark=_benchmark_of(loss), classes=_classes_of(g),
        )
    )


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql is not None}
