"""Per-stand rules and their area sums: every report is one pass of conditional sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbergrid.functions import rules as R
from timbergrid.operators import weather
from timbergrid.plans.config import Ccf, RootRot

DEADWOOD_M3_PER_HA, STANDING_SHARE = 5.5, 0.3


def area(column: str = "area") -> Column:
    return F.coalesce(R.number(F.col(column)), F.lit(0.0))


def with_rules(stands: DataFrame, ccf: Ccf = Ccf(), rot: RootRot = RootRot()) -> DataFrame:
    """``area_ha, is_peat, rootrot_obligation, ccf_prescribed`` beside the stand's own columns."""
    c = F.col
    rows = stands.withColumns({"area_ha": area(), "is_peat": R.is_peat(c("soiltype"))})
    return rows.withColumns({"rootrot_obligation": R.species_rule(c("is_peat"), c("proportionpine"), c("proportionspruce"), rot), "ccf_prescribed": R.ccf_prescribed(c("soiltype"), c("fertilityclass"), c("drainagestate"), c("proportionspruce"), ccf)})


def ccf_area_summary(stands: DataFrame, ccf: Ccf = Ccf()) -> DataFrame:
    c = F.col
    peat = R.holds(R.number(c("soiltype")) >= ccf.peat_from)
    drained = peat & R.holds(R.number(c("drainagestate")).isin([float(x) for x in ccf.drained_states]))
    rows = stands.select(area().alias("ha"), peat.alias("peat"), drained.alias("drained"), R.ccf_prescribed(c("soiltype"), c("fertilityclass"), c("drainagestate"), c("proportionspruce"), ccf).alias("ccf"), R.holds(R.number(c("fertilityclass")) <= 2).alias("rich"))
    ha = lambda when: F.bround(F.coalesce(F.sum(F.when(when, c("ha"))), F.lit(0.0)), 1)
    sums = rows.agg(F.count_if("ccf").alias("n_ccf"), F.coalesce(F.sum("ha"), F.lit(0.0)).alias("all_ha"), ha(c("peat")).alias("peat_ha"), ha(c("drained")).alias("drained_ha"), ha(c("ccf")).alias("ccf_ha"), ha(c("ccf") & c("rich")).alias("ccf_strict_ha"))
    pct = lambda a, b: F.bround(100 * c(a) / F.nullif(c(b), F.lit(0.0)), 2)
    return sums.select("n_ccf", F.bround("all_ha", 1).alias("total_ha"), "peat_ha", "drained_ha", "ccf_ha", "ccf_strict_ha", pct("ccf_ha", "drained_ha").alias("ccf_of_drained_pct"), pct("ccf_ha", "all_ha").alias("ccf_of_total_pct"))


def ccf_rootrot_conflict(stands: DataFrame, ccf: Ccf = Ccf(), rot: RootRot = RootRot()) -> DataFrame:
    rows = with_rules(stands, ccf, rot).where("ccf_prescribed")
    both = F.col("rootrot_obligation")
    sums = rows.agg(F.coalesce(F.sum("area_ha"), F.lit(0.0)).alias("ccf_ha"), F.coalesce(F.sum(F.when(both, F.col("area_ha"))), F.lit(0.0)).alias("conflict_ha"), F.count_if(both).alias("n_conflict"))
    return sums.withColumn("conflict_share", F.bround(F.col("conflict_ha") / F.nullif(F.col("ccf_ha"), F.lit(0.0)), 3))


def deadwood(stands: DataFrame, m3_per_ha: float = DEADWOOD_M3_PER_HA, standing: float = STANDING_SHARE) -> DataFrame:
    total = F.coalesce(F.sum(area()), F.lit(0.0))
    return stands.agg(F.bround(total, 1).alias("area_ha"), F.bround(total * m3_per_ha, 0).alias("deadwood_m3"), F.bround(total * (m3_per_ha * standing), 0).alias("standing_m3"))


def proximity_report(stands: DataFrame, widths: Sequence[float], types: Sequence[int]) -> DataFrame:
    """Per setback width: stands within it, their area, and the area by type of the nearest habitat.

    ``stands`` has area_ha, nearest_m (NULL: none) and habitattype; each stand meets every width, a short list.
    """
    by_width = stands.withColumn("width", F.explode(F.array(*[F.lit(float(w)) for w in widths])))
    inside = R.holds(F.col("nearest_m") <= F.col("width"))
    ha = lambda when: F.coalesce(F.sum(F.when(when, F.col("area_ha"))), F.lit(0.0))
    by_type = [ha(inside & (R.number(F.col("habitattype")) == float(t))).alias(f"type_{t}_ha") for t in types]
    return by_width.groupBy("width").agg(F.count_if(inside).alias("n_stands"), ha(inside).alias("area_ha"), *by_type)


def site_plan(stands: DataFrame, habitat_m: DataFrame, stream_m: DataFrame, habitat_width: float = 30.0, stream_width: float = 30.0, ccf: Ccf = Ccf(), rot: RootRot = RootRot()) -> DataFrame:
    """The plan of every stand. ``habitat_m``: stand_row, nearest_habitat_m; ``stream_m``: stand_row, nearest_derived_stream_m."""
    rows = with_rules(stands, ccf, rot).join(habitat_m, "stand_row", "left").join(stream_m, "stand_row", "left")
    c = F.col
    return rows.select(
        "stand_row",
        F.bround("area_ha", 3).alias("area_ha"),
        "is_peat",
        F.bround(R.share(c("proportionspruce")), 3).alias("spruce_share"),
        "rootrot_obligation",
        "ccf_prescribed",
        F.bround("nearest_habitat_m", 1).alias("nearest_habitat_m"),
        R.holds(c("nearest_habitat_m") <= habitat_width).alias("within_habitat_setback"),
        F.bround("nearest_derived_stream_m", 1).alias("nearest_derived_stream_m"),
        R.holds(c("nearest_derived_stream_m") <= stream_width).alias("within_stream_buffer"),
        R.harvest_timing(c("is_peat"), c("ccf_prescribed")).alias("harvest_timing"),
    )


def site_plan_bars(plan: DataFrame) -> DataFrame:
    """Area under each flag of a site plan, as rows."""
    flags = ("rootrot_obligation", "ccf_prescribed", "within_habitat_setback", "within_stream_buffer")
    sums = plan.agg(*[F.coalesce(F.sum(F.when(F.col(f), F.col("area_ha"))), F.lit(0.0)).alias(f) for f in flags])
    return sums.unpivot([], list(flags), "flag", "area_ha")


def obligation(fellings: DataFrame, daily: DataFrame, rot: RootRot = RootRot(), by: Sequence[str] = weather.BY) -> DataFrame:
    """Fellings (soiltype, shares, date) with trigger, period, exemption and the resulting duty."""
    c = F.col
    rows = weather.cold_spell_exempt(fellings, daily, rot, by)
    rows = rows.withColumns({"species_soil_trigger": R.species_rule(R.is_peat(c("soiltype")), c("proportionpine"), c("proportionspruce"), rot), "in_mandatory_period": R.in_period(c("date"), rot)})
    return rows.withColumn("treatment_required", c("species_soil_trigger") & c("in_mandatory_period") & ~c("cold_spell_exempt"))


def workability(declarations: DataFrame, daily: DataFrame, bands: dict[float, str], by: Sequence[str] = weather.BY) -> DataFrame:
    """Declarations with DTW bands: wetness of the day, threshold, blended and soil-adjusted DTW, frozen, workable.

    A day without weather has no threshold and no DTW, and isn't frozen. The calendar meets the declarations in an
    equi-join by station and day. Of several rows of a day the wettest counts, and of those a frozen one.
    """
    c = F.col
    calendar = weather.frozen_ground(weather.wetness_percentile(daily, by=by), by=by)
    calendar = calendar.groupBy(*by, "date").agg(F.max(F.struct("wetness", "frozen")).alias("_day")).select(*by, "date", "_day.wetness", "_day.frozen")
    rows = declarations.join(calendar, [*by, "date"], "left").withColumn("threshold", R.threshold_ha(c("wetness")))
    rows = rows.withColumns({"dtw_m": R.at_threshold(c("threshold"), {t: c(name) for t, name in bands.items()}), "is_peat": R.is_peat(c("soiltype")), "frozen": R.holds(c("frozen"))})
    rows = rows.withColumn("adjusted_dtw_m", R.adjusted_dtw(c("dtw_m"), c("is_peat")))
    return rows.withColumn("workable", R.workable(c("adjusted_dtw_m"), c("frozen")))


def control_dates(declarations: DataFrame, seed: int = 42) -> DataFrame:
    """The same rows on other days: uniform from the first day on, the last never drawn; a hash of (row, seed) draws.

    The draw belongs to the row's id, so it is the same however the rows are partitioned.
    """
    span = declarations.agg(F.min("date").alias("_first"), F.datediff(F.max("date"), F.min("date")).alias("_days"))
    rows = declarations.join(F.broadcast(span))  # one row
    drawn = F.pmod(F.xxhash64("decl_id", F.lit(seed)), F.greatest(F.col("_days"), F.lit(1)).cast("long")).cast("int")
    return rows.withColumn("date", F.date_add("_first", drawn)).drop("_first", "_days")


def concordance(declared: DataFrame, control: DataFrame) -> DataFrame:
    rate = lambda d, name: d.agg(F.avg(F.col("workable").cast("int")).alias(name))
    both = rate(declared, "declared").join(F.broadcast(rate(control, "control")))  # one row each
    return both.select(F.bround("declared", 4).alias("declared_rate"), F.bround("control", 4).alias("control_rate"), F.bround(F.col("declared") / F.greatest(F.col("control"), F.lit(1e-9)), 3).alias("lift"))
