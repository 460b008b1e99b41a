"""Row-wise rules as native column expressions: soil, species, season, wetness and erosion terms.

Missing values are NULL, never NaN; a predicate over a missing value is false. Codes may come as text or as numbers.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from timbergrid.plans.config import Ccf, Resistance, RootRot

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: The labels of the harvest timing.
HOLDS = "no trafficability restriction"
FROZEN_ONLY = "frozen-ground / winter preferred"


def number(code: Column) -> Column:
    """A double where the code reads as a plain number, else NULL ('60d' is no number).

    What is a number by its type is not written out and read again; the type is known when the query is planned.
    """
    text, plain = code.cast("string"), code.try_cast("double")
    read = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.typeof(code).isin("double", "bigint", "int", "smallint", "tinyint"), F.when(F.abs(plain) < float("inf"), plain)).otherwise(read)


def holds(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def share(value: Column) -> Column:
    return F.coalesce(number(value), F.lit(0.0))


def is_peat(soiltype: Column) -> Column:
    return holds(number(soiltype) > 59)


def species_rule(peat: Column, pine: Column, spruce: Column, cfg: RootRot = RootRot()) -> Column:
    """Spruce decides on peat, pine and spruce together on mineral soil; bounds are inclusive."""
    return holds(F.when(peat, share(spruce) >= cfg.peat_spruce_share).otherwise(share(pine) + share(spruce) >= cfg.mineral_conifer_share))


def in_period(date: Column, cfg: RootRot = RootRot()) -> Column:
    """Month-day between both ends, inclusive; a period that would wrap the year is empty."""
    return holds(F.date_format(date, "MM-dd").between(cfg.period_start, cfg.period_end))


def ccf_prescribed(soiltype: Column, fertility: Column, drainage: Column, spruce: Column, cfg: Ccf = Ccf()) -> Column:
    drained = number(drainage).isin([float(x) for x in cfg.drained_states])
    return holds((number(soiltype) >= cfg.peat_from) & (number(fertility) <= cfg.most_fertility_class) & drained & (number(spruce) >= cfg.least_spruce_share))


def adjusted_dtw(dtw: Column, peat: Column, penalty: float = 0.5) -> Column:
    return dtw * F.when(peat, F.lit(1 - penalty)).otherwise(F.lit(1.0))


def workable(dtw: Column, frozen: Column, wet: float = 1.0) -> Column:
    return holds(dtw > wet) | holds(frozen)


def harvest_timing(peat: Column, ccf: Column) -> Column:
    return F.when(peat | ccf, F.lit(FROZEN_ONLY)).otherwise(F.lit(HOLDS))


#: Wetness percentile to channel threshold in hectares, wettest first.
WETNESS_KNOTS = ((1.0, 0.5), (0.75, 1.0), (0.5, 2.0), (0.25, 4.0), (0.0, 10.0))


def threshold_ha(percentile: Column) -> Column:
    """Piecewise linear in the logarithm between the knots, held at the ends."""
    out = F.when(percentile >= 1.0, F.lit(WETNESS_KNOTS[0][1]))
    for (above, high), (below, low) in zip(WETNESS_KNOTS, WETNESS_KNOTS[1:], strict=False):
        slope = (math.log(high) - math.log(low)) / (above - below)
        out = out.when(percentile >= below, F.exp(F.lit(math.log(low)) + (percentile - below) * slope))
    return out.when(percentile < 0.0, F.lit(WETNESS_KNOTS[-1][1]))


def at_threshold(threshold: Column, bands: Mapping[float, Column]) -> Column:
    """Value at a threshold between bands: linear in log(threshold), clamped outside; NULL if either side is."""
    knots = sorted(bands)
    out = F.when(threshold <= knots[0], bands[knots[0]])
    for low, high in zip(knots, knots[1:], strict=False):
        t = (F.log(threshold) - math.log(low)) / (math.log(high) - math.log(low))
        inside = F.when(threshold == high, bands[high]).otherwise(bands[low] + t * (bands[high] - bands[low]))
        out = out.when(threshold <= high, inside)
    return out.when(threshold > knots[-1], bands[knots[-1]])


def cells_for_distance(distance_m: float, resolution_m: float) -> int:
    """Whole cells of a distance, at least one, ties to even."""
    return max(1, round(distance_m / resolution_m))


def looked_up(code: Column, table: Mapping[int, float], default: float) -> Column:
    """The table's value at the code, rounded half-even first; the default where it has none."""
    if not table:
        return F.lit(default)
    entries = [x for k, v in table.items() for x in (F.lit(int(k)), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.bround(number(code), 0).cast("int")), F.lit(default))


def ls_factor(accumulated_cells: Column, slope_deg: Column, resolution_m: float, most_length_m: float = 100.0) -> Column:
    """Slope length and steepness; 0 where an input is missing."""
    length = F.least(F.greatest(accumulated_cells, F.lit(0.0)) * resolution_m, F.lit(most_length_m))
    steep = F.sin(F.radians(F.greatest(slope_deg, F.lit(0.0))))
    value = F.pow(length / 22.13, F.lit(0.4)) * F.pow(steep / 0.0896, F.lit(1.3))
    return F.when(accumulated_cells.isNull() | slope_deg.isNull(), F.lit(0.0)).otherwise(value)


def soil_loss(ls: Column, k: Column, c: Column, r_factor: float, p_factor: float = 1.0) -> Column:
    return F.lit(r_factor * p_factor) * (k * ls * c)


def winter_of(date: Column) -> Column:
    """The year in which the winter of a day began; July begins a new one."""
    return F.year(date) - F.when(F.month(date) < 7, 1).otherwise(0)


def decade_of(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def day_of_stamp(stamp: Column) -> Column:
    """The local day of an ISO string, whatever its offset."""
    return F.to_date(F.substring(stamp, 1, 10))


def land_cover_term(clc: Column, cfg: Resistance = Resistance()) -> Column:
    """Relative resistance of a land-cover class; the mean of all categories where it has none."""
    by_class = {code: cfg.land_cover[name] for name, codes in cfg.classes.items() for code in codes}
    return looked_up(clc, by_class, sum(cfg.land_cover.values()) / len(cfg.land_cover))


def stand_term(value: Column, reference: float, fallback: Column) -> Column:
    term = 1 - F.least(F.greatest(value / reference, F.lit(0.0)), F.lit(1.0))
    return F.when(value.isNull(), fallback).otherwise(term)


def resistance(terms: Sequence[tuple[Column, Column]], clc: Column, cfg: Resistance = Resistance()) -> Column:
    """Weighted blend of terms scaled between the bounds; water is a fixed high value."""
    blend = F.lit(cfg.low)
    for weight, term in terms:
        blend = blend + weight * term * (cfg.high - cfg.low)
    return F.when(holds(number(clc).isin([float(x) for x in cfg.classes["water"]])), F.lit(cfg.water)).otherwise(blend)
