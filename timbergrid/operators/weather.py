"""Daily weather: windows over each station's days, runs of days, seasons and trends.

Every window is partitioned by the station columns ``by``, so the work spreads over stations and a partition is as long
as one station's record. Row windows count rows, range windows count days.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbergrid.functions import rules as R
from timbergrid.plans.config import RootRot

BY = ("station",)
DIGITS = 6
#: Stations whose last days are broadcast, a few dozen bytes each.
STATIONS = 100_000


def wide(long: DataFrame, variables: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """(by, date, param, value) to one column for each variable; repeated values are averaged, 'NaN' is missing."""
    value = F.when(~F.isnan(F.col("value").try_cast("double")), F.col("value").try_cast("double"))
    return long.withColumn("value", value).groupBy(*by, "date").pivot("param", list(variables)).agg(F.avg("value"))


def no_sentinel(value: Column) -> Column:
    """-1 says none: 0; missing stays missing."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def _days(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("date")


def antecedent(daily: DataFrame, windows: Sequence[int] = (7, 14, 30), by: Sequence[str] = BY) -> DataFrame:
    rain = no_sentinel(F.col("rrday"))
    return daily.withColumns({f"api_{w}": F.sum(rain).over(_days(by).rowsBetween(-(w - 1), 0)) for w in windows})


def snowmelt(daily: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    snow = no_sentinel(F.col("snow"))
    fall = F.lag(snow).over(_days(by)) - snow
    return daily.withColumn("melt", F.greatest(F.coalesce(fall, F.lit(0.0)), F.lit(0.0)))


def wetness_percentile(daily: DataFrame, windows: Sequence[int] = (7, 14, 30), weights: Sequence[float] = (3, 2, 1), melt_weight: float = 2.0, by: Sequence[str] = BY) -> DataFrame:
    """Average rank of a day's wetness among the station's days, as a share of them; scores tie at ``DIGITS`` digits."""
    if len(windows) > len(weights):
        raise ValueError("each window needs a weight")
    used = list(zip(windows, weights, strict=False))
    rows = snowmelt(antecedent(daily, windows, by), by)
    score = sum((F.col(f"api_{w}") * float(k) for w, k in used), F.lit(0.0)) / float(sum(k for _, k in used)) + melt_weight * F.col("melt")
    rows = rows.withColumn("score", F.round(score, DIGITS))
    rank = F.rank().over(Window.partitionBy(*by).orderBy(F.col("score").asc_nulls_last()))
    ties = F.count("score").over(Window.partitionBy(*by, "score"))
    known = F.count("score").over(Window.partitionBy(*by))
    return rows.withColumn("wetness", F.when(F.col("score").isNotNull(), (rank + (ties - 1) / 2) / known))


def frost_look_back(daily: DataFrame, cfg: RootRot = RootRot(), by: Sequence[str] = BY) -> DataFrame:
    """``had_frost``: a day colder than the bound within the days looked back on, the day itself included."""
    cold = R.holds(F.col("tmin") < cfg.frost_c).cast("int")
    back = Window.partitionBy(*by).orderBy(F.unix_date("date")).rangeBetween(-(cfg.look_back_days - 1), 0)
    return daily.withColumn("had_frost", F.max(cold).over(back) == 1)


def as_of(left: DataFrame, right: DataFrame, date: str, values: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """Each left row with the last right row of its station on or before its date; NULLs where there is none.

    Both sides are sorted together once by (station, date), so the cost is that of a sort, not of an inequality join.
    """
    told = F.struct(*[F.col(v) for v in values])
    a = left.select(*[F.col(b) for b in by], F.col(date).alias("_at"), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), F.lit(None).cast(right.select(told.alias("t")).schema["t"].dataType).alias("_told"))
    b = right.select(*[F.col(b) for b in by], F.col(date).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), told.alias("_told"))
    upto = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_told", ignorenulls=True).over(upto)).where("_side = 1")
    return both.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def as_of_day(left: DataFrame, daily: DataFrame, date: str, value: str, by: Sequence[str] = BY) -> DataFrame:
    """``as_of`` for a daily record: the record is made whole, a row for every day from its first to its last, and left
    rows meet it in an equi-join by station and day; days after the last take the last.

    Only the record, days times stations, is sorted; left rows are spread by station and day, however few the stations.
    Of several values of a day the largest counts (true before false), so a left row stays one row.
    """
    ends = daily.groupBy(*by).agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    every = ends.select(*by, F.explode(F.sequence("_from", "_to")).alias("_at"))
    known = daily.groupBy(*by, F.col("date").alias("_at")).agg(F.max(value).alias("_told"))
    upto = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    whole = every.join(known, [*by, "_at"], "left").select(*by, "_at", F.last("_told", ignorenulls=True).over(upto).alias(value))
    last = ends.select(*by, "_to")
    if last.limit(STATIONS + 1).count() <= STATIONS:
        last = F.broadcast(last)
    told = left.join(last, list(by), "left").withColumn("_at", F.least(F.col(date), F.col("_to")))
    return told.join(whole, [*by, "_at"], "left").select(*[F.col(f"`{c}`") for c in left.columns], value)


def cold_spell_exempt(fellings: DataFrame, daily: DataFrame, cfg: RootRot = RootRot(), by: Sequence[str] = BY) -> DataFrame:
    frost = frost_look_back(daily, cfg, by).select(*by, "date", "had_frost")
    return as_of_day(fellings, frost, "date", "had_frost", by).withColumn("cold_spell_exempt", R.holds(F.col("had_frost"))).drop("had_frost")


def with_runs(daily: DataFrame, flag: Column, by: Sequence[str] = BY) -> DataFrame:
    """``flag`` and, for flagged rows, ``run`` and ``run_length``: neighbouring rows with the flag."""
    rows = daily.withColumn("flag", R.holds(flag))
    number = F.row_number().over(_days(by)) - F.row_number().over(Window.partitionBy(*by, "flag").orderBy("date"))
    rows = rows.withColumn("run", F.when(F.col("flag"), number))
    return rows.withColumn("run_length", F.when(F.col("flag"), F.count(F.lit(1)).over(Window.partitionBy(*by, "flag", "run"))))


def frozen_ground(daily: DataFrame, most_c: float = -2.0, least_days: int = 3, by: Sequence[str] = BY) -> DataFrame:
    runs = with_runs(daily, F.col("tmin") <= most_c, by)
    return runs.withColumn("frozen", R.holds(F.col("run_length") >= least_days)).drop("flag", "run", "run_length")


def runs_at_least(daily: DataFrame, flag: Column, least: int, by: Sequence[str] = BY) -> DataFrame:
    """(by, start, end, days) of runs of flagged rows."""
    runs = with_runs(daily, flag, by).where(F.col("flag") & (F.col("run_length") >= least))
    return runs.groupBy(*by, "run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("days")).drop("run")


def spore_season(daily: DataFrame, cfg: RootRot = RootRot(), least_run: int = 5, by: Sequence[str] = BY) -> DataFrame:
    """For every station and year: start of its first warm run and end of its last; runs end with the year."""
    rows = daily.withColumn("year", F.year("date"))
    runs = runs_at_least(rows, F.col("tday") >= cfg.spore_c, least_run, (*by, "year"))
    bounds = runs.groupBy(*by, "year").agg(F.min("start").alias("season_start"), F.max("end").alias("season_end"))
    return rows.select(*by, "year").distinct().join(bounds, [*by, "year"], "left")


def conflict_free_days(daily: DataFrame, cfg: RootRot = RootRot(), least_rows: int = 350, by: Sequence[str] = BY) -> DataFrame:
    """For every winter with enough rows: days on frozen ground outside the treatment period."""
    rows = frozen_ground(daily, by=by).withColumns({"winter": R.winter_of(F.col("date")), "free": F.col("frozen") & ~R.in_period(F.col("date"), cfg)})
    return rows.groupBy(*by, "winter").agg(F.count_if("free").alias("days"), F.count_if("frozen").alias("frozen_days"), F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least_rows)


def conflict_free_decades(daily: DataFrame, cfg: RootRot = RootRot(), least_rows: int = 350, by: Sequence[str] = BY) -> DataFrame:
    winters = conflict_free_days(daily, cfg, least_rows, by)
    return winters.groupBy(*by, R.decade_of(F.col("winter")).alias("decade")).agg(F.avg("days").alias("mean_days"), F.count(F.lit(1)).alias("winters"))


def trend(series: DataFrame, at: str, value: str, by: Sequence[str] = BY) -> DataFrame:
    """Mann-Kendall over a short series (years) of every station: n, S, Kendall's tau-b, p and the least-squares slope.

    Pairs are formed within a station; a record has as many values as years. Fewer than four values give NULLs.
    """
    rows = series.where(F.col(value).isNotNull()).select(*by, F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    later = rows.select(*by, F.col("t").alias("t2"), F.col("v").alias("v2"))
    s = rows.join(later, list(by)).where("t2 > t").groupBy(*by).agg(F.sum(F.signum(F.col("v2") - F.col("v"))).alias("s"), F.count_if(F.col("v2") == F.col("v")).alias("tied"))
    ties = rows.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("k")).groupBy(*by).agg(F.sum(F.expr("case when k > 1 then k * (k - 1) * (2 * k + 5) else 0 end")).cast("double").alias("ties"))
    line = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("v", "t").alias("slope"))
    out = line.join(ties, list(by)).join(s, list(by), "left").where("n >= 1")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    out = out.withColumn("tau", F.col("s") / F.sqrt(pairs * (pairs - F.col("tied"))))

    def p_value(n: int, s: float, ties: float, tied_pairs: float) -> float:
        """Two-sided p of Kendall's S: exact without ties up to 33 values, else the normal approximation."""
        if not ties and n <= 33:
            ways = [1.0]
            for k in range(2, n + 1):
                ways = [sum(ways[max(0, i - k + 1) : i + 1]) for i in range(len(ways) + k - 1)]
            fewer = int((n * (n - 1) // 2 - abs(s)) // 2)
            return min(1.0, 2 * sum(ways[: fewer + 1]) / math.factorial(n))
        m = n * (n - 1.0)
        var = (m * (2 * n + 5) - ties) / 18
        return math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2)) if var > 0 else float("nan")

    def add_p(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [p_value(int(n), s, t, d) if n >= 4 else None for n, s, t, d in zip(b["n"], b["s"], b["ties"], b["tied"], strict=True)]
            yield b.assign(p=pd.Series(p, dtype="float64"))

    kept = out.select(*by, "n", F.coalesce("s", F.lit(0.0)).alias("s"), "tau", "slope", "ties", F.coalesce("tied", F.lit(0)).cast("long").alias("tied"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", p double"
    judged = kept.mapInPandas(add_p, schema)  # one row for each station
    enough = lambda c: F.when(F.col("n") >= 4, F.col(c)).alias(c)
    return judged.select(*by, "n", "s", enough("tau"), enough("p"), enough("slope"))
