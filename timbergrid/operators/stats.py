"""Agreement statistics: global average ranks without a single partition, correlations, bias, class tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbergrid.operators.checkpoints import cut

SPLITS = 256
#: Ranges of a round of ``quantiles``, and as many values of a range as are sorted in one task.
BINS, FEW = 1024, 4096


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rank_<column>`` beside each column, ties averaged; NULLs have none.

    Values are counted first, so a hot value is one row. Distinct values fall into ranges between approximate
    quantiles; a range's start is the sum of those before it, and windows run within ranges.
    """
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
        bounds = counts.agg(F.percentile_approx("_v", [i / SPLITS for i in range(1, SPLITS)], 10_000).alias("b")).first()["b"] or []
        edges = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
        placed = counts.withColumn("_range", F.size(F.filter(edges, lambda b: b < F.col("_v"))))
        totals = placed.groupBy("_range").agg(F.sum("_k").alias("_n"))  # SPLITS rows at most
        before = totals.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
        upto = F.sum("_k").over(Window.partitionBy("_range").orderBy("_v"))
        ranks = placed.join(F.broadcast(before), "_range").select("_v", (F.col("_before") + upto - (F.col("_k") - 1) / 2).alias(f"rank_{c}"))
        df = df.join(ranks, df[c] == ranks["_v"], "left").drop("_v")
    return df


def quantiles(df: DataFrame, value: str, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, fraction, value): exact quantiles, interpolated between the two nearest ranks; groups are few.

    A wanted rank is found by ranges: rows are counted in ``BINS`` ranges between the least and the largest value, and the
    next round looks into the one range that holds the rank. Ranges are even on a logarithmic scale first, then on the
    values' own, so rounds are few however the values lie. A range of one value, or of few values, ends it. What is
    shuffled are counts: no task gathers the values of a group. NULL, NaN and infinite values take no part.
    """
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    rows = cut(df.select(*by, F.col(value).cast("double").alias("v")).where(finite))
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    place = (F.col("n") - 1) * F.col("fraction")
    wanted = cut(groups.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumns({"below": F.floor(place), "above": F.ceil(place), "part": place - F.floor(place)}))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_{k}"]) for k in by], F.lit(True))
    named = lambda d: d.select(*[F.col(k).alias(f"_{k}") for k in by], *[c for c in d.columns if c not in by])
    state = wanted.select(*by, F.explode(F.array_distinct(F.array("below", "above"))).alias("rank"), "n", "lo", "hi").distinct().withColumn("at", F.col("rank"))
    scale = lambda c: F.signum(c) * F.when(c == 0, 0.0).otherwise(F.ln(F.abs(c)) + 750)
    first = True
    while not (open_ := state.where((F.col("n") > FEW) & (F.col("lo") < F.col("hi")))).isEmpty():
        asked = named(open_)
        inside = rows.join(F.broadcast(asked), same(rows, asked) & F.col("v").between(F.col("lo"), F.col("hi")))  # two rows for each group and fraction
        y = scale if first else (lambda c: c)
        bin_ = F.least(F.floor((y(F.col("v")) - y(F.col("lo"))) / (y(F.col("hi")) - y(F.col("lo"))) * BINS), F.lit(BINS - 1))
        counts = inside.withColumn("bin", F.coalesce(bin_, F.lit(0))).groupBy(*by, "rank", "at", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("n").over(Window.partitionBy(*by, "rank").orderBy("bin")) - F.col("n")
        chosen = counts.withColumn("before", before).where((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("n")))
        chosen = chosen.select(*by, "rank", "n", "lo", "hi", (F.col("at") - F.col("before")).alias("at"))
        state = cut(chosen.unionByName(state.where((F.col("n") <= FEW) | (F.col("lo") >= F.col("hi")))))
        first = False
    asked = named(state.where("lo < hi"))
    some = rows.join(F.broadcast(asked), same(rows, asked) & F.col("v").between(F.col("lo"), F.col("hi")))
    listed = some.groupBy(*by, "rank", "at").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # FEW values at most
    found = listed.select(*by, "rank", F.get("vs", F.col("at").cast("int")).alias("is")).unionByName(state.where("lo >= hi").select(*by, "rank", F.col("lo").alias("is")))
    low, high = named(found.select(*by, F.col("rank").alias("below"), F.col("is").alias("a"))), named(found.select(*by, F.col("rank").alias("above"), F.col("is").alias("b")))
    out = wanted.join(low, same(wanted, low) & (wanted["below"] == low["below"])).drop(low["below"]).drop(*[f"_{k}" for k in by])
    out = out.join(high, same(out, high) & (out["above"] == high["above"])).drop(high["above"])
    return out.select(*by, "fraction", (F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")).alias("value"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    return average_ranks(both, ["a", "b"]).agg(F.corr("rank_a", "rank_b").alias("spearman"), F.count(F.lit(1)).alias("n"))


def compared(cells: DataFrame, ours: str, reference: str) -> DataFrame:
    """One row: n, Pearson, Spearman over all cells, bias, RMSE, medians; of cells that have both values."""
    both = cells.where(F.col(ours).isNotNull() & F.col(reference).isNotNull()).select(F.col(ours).cast("double").alias("a"), F.col(reference).cast("double").alias("b"))
    ranked = average_ranks(both, ["a", "b"])
    d = F.col("a") - F.col("b")
    told = ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("pearson"), F.corr("rank_a", "rank_b").alias("spearman"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"))
    for c, name in (("a", "median_ours"), ("b", "median_reference")):
        told = told.join(quantiles(both, c, [0.5]).select(F.col("value").alias(name)), how="left")  # one row each
    return told


def erosion_benchmark(cells: DataFrame, benchmark: str, columns: Sequence[str], least: int = 100) -> DataFrame:
    """A row for each compared column over covered cells where both are positive; statistics from ``least`` cells on."""
    cells, out = cut(cells.select("covered", benchmark, *columns)), None
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("a")) for c in columns])
    each = cells.where(F.col("covered") & (F.col(benchmark) > 0)).select(F.col(benchmark).cast("double").alias("b"), F.explode(pairs).alias("p")).where("p.a > 0")
    ratios = each.select("p.label", (F.col("b") / F.greatest(F.col("p.a"), F.lit(1e-9))).alias("ratio"))
    middles = cut(quantiles(ratios, "ratio", [0.5], ["label"]).select("label", F.bround("value", 1).alias("_middle")))
    for c in columns:
        both = cells.where(F.col("covered") & (F.col(c) > 0) & (F.col(benchmark) > 0)).select(F.col(c).cast("double").alias("a"), F.col(benchmark).cast("double").alias("b"))
        enough = lambda x: F.when(F.count(F.lit(1)) >= least, x)
        row = average_ranks(both, ["a", "b"]).agg(
            F.count(F.lit(1)).alias("n"),
            enough(F.bround(F.corr("rank_a", "rank_b"), 3)).alias("spearman"),
            enough(F.bround(F.corr(F.log1p("a"), F.log1p("b")), 3)).alias("pearson_log"),
        ).join(middles.where(F.col("label") == c).drop("label"), how="left")  # one row each
        row = row.select("n", "spearman", "pearson_log", F.when(F.col("n") >= least, F.col("_middle")).alias("median_ratio"), F.lit(c).alias("label"))
        out = row if out is None else out.unionByName(row)
    return out


def class_table(cells: DataFrame, wet: float = 1.0) -> DataFrame:
    """Trafficability classes 1 to 6 against depth to water: n, median, share that is dry.

    A row for each class, one for 1 to 3, and one for all valid cells, which also has the rank correlation of depth and
    class.
    """
    valid = cells.where(F.col("klass").between(1, 6) & (F.col("dtw") > 0)).select(F.col("klass").cast("double").alias("klass"), F.col("dtw").cast("double").alias("dtw"))
    of = F.array_compact(F.array(F.col("klass").cast("int").cast("string"), F.when(F.col("klass") <= 3, "1-3"), F.lit("all")))
    each = valid.select(F.explode(of).alias("klass"), "dtw")
    told = each.groupBy("klass").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg((F.col("dtw") > wet).cast("int")), 3).alias("workable_share"))
    middle = quantiles(each, "dtw", [0.5], ["klass"]).select("klass", F.bround("value", 3).alias("median_dtw"))
    whole = spearman(valid, "dtw", "klass").select(F.bround("spearman", 3).alias("spearman"), F.lit("all").alias("klass"))
    return told.join(middle, "klass").join(whole, "klass", "left").select("klass", "n", "median_dtw", "workable_share", "spearman")
