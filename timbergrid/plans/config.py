"""Settings of the analyses, their validation and their seeded perturbation; all on the driver, all small."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

import numpy as np


@dataclass(frozen=True)
class RootRot:
    peat_spruce_share: float = 0.5
    mineral_conifer_share: float = 0.5
    period_start: str = "05-01"
    period_end: str = "11-30"
    frost_c: float = -10.0
    look_back_days: int = 21
    spore_c: float = 5.0


@dataclass(frozen=True)
class Ccf:
    peat_from: float = 60
    most_fertility_class: float = 3
    drained_states: tuple[int, ...] = (7, 8, 9)
    least_spruce_share: float = 0.5


#: The land-cover map's classes by category.
LAND_COVER_CLASSES = {
    "forest": (23, 24, 25, 26, 27, 28, 29, 30),
    "transitional": (33, 34, 35, 36, 37),
    "open_veg": (31, 32),
    "mire": (41, 43, 45),
    "agriculture": (17, 18, 19, 20, 21, 22),
    "bare": (38, 39, 40, 44),
    "built": (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16),
    "water": (42, 46, 47, 48, 49),
}
#: Relative resistance by category, and weights of the terms.
LAND_COVER = {"forest": 0.10, "transitional": 0.50, "open_veg": 0.55, "mire": 0.40, "agriculture": 0.80, "bare": 0.70, "built": 0.90, "water": 1.00}
WEIGHTS = {"age": 0.30, "structure": 0.25, "species": 0.20, "landcover": 0.25}


@dataclass(frozen=True)
class Resistance:
    """``land_cover``: category to relative resistance; ``classes``: category to land-cover codes."""

    low: float = 1.0
    high: float = 100.0
    water: float = 1000.0
    age_cap: float = 120.0
    basal_area_cap: float = 25.0
    deciduous_share: float = 0.5
    classes: Mapping[str, tuple[int, ...]] = field(default_factory=lambda: dict(LAND_COVER_CLASSES))
    land_cover: Mapping[str, float] = field(default_factory=lambda: dict(LAND_COVER))
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    dispersal: float = 8000.0
    coarsen: int = 8
    corridor_slack: float = 0.15
    backbone_k: int = 3


@dataclass(frozen=True)
class Sweep:
    n_runs: int = 20
    seed: int = 0
    weight_by: float = 0.40
    land_cover_by: float = 0.30
    dispersal_by: float = 0.50
    robust_share: float = 0.80


@dataclass(frozen=True)
class Area:
    """A rectangle in EPSG:3067 metres."""

    name: str
    x_min: float
    y_min: float
    x_max: float
    y_max: float

    def __post_init__(self) -> None:
        if not (self.x_min < self.x_max and self.y_min < self.y_max):
            raise ValueError("an area needs min < max on both axes")

    @property
    def km2(self) -> float:
        return (self.x_max - self.x_min) * (self.y_max - self.y_min) / 1e6


def perturbed(base: Resistance, sweep: Sweep) -> list[tuple[int, Resistance]]:
    """One setting for each run: weights drawn first and brought back to a sum of one, then land cover, then dispersal."""
    rng, out = np.random.default_rng(sweep.seed), []
    for run in range(sweep.n_runs):
        weights = {k: v * (1 + rng.uniform(-sweep.weight_by, sweep.weight_by)) for k, v in base.weights.items()}
        total = sum(weights.values())
        cover = {k: float(np.clip(v * (1 + rng.uniform(-sweep.land_cover_by, sweep.land_cover_by)), 0.02, 1.0)) for k, v in base.land_cover.items()}
        dispersal = base.dispersal * (1 + rng.uniform(-sweep.dispersal_by, sweep.dispersal_by))
        out.append((run, dataclasses.replace(base, weights={k: v / total for k, v in weights.items()}, land_cover=cover, dispersal=float(dispersal))))
    return out


def problems(config: Mapping[str, Any]) -> list[str]:
    """Everything that is wrong with a nested configuration, not only the first thing; booleans are no numbers."""
    found: list[str] = []

    def is_number(x: Any) -> bool:
        return isinstance(x, int | float) and not isinstance(x, bool)

    def number(path: str, low: float, high: float) -> None:
        x: Any = config
        for key in path.split("."):
            x = x.get(key) if isinstance(x, Mapping) else None
        if not is_number(x):
            found.append(f"{path}: a number is needed, not {x!r}")
        elif not low <= x <= high:
            found.append(f"{path}: {x} isn't within {low} and {high}")

    for path, low, high in (
        ("rootrot.peat_spruce_share", 0, 1), ("rootrot.mineral_conifer_share", 0, 1), ("rootrot.look_back_days", 1, 366),
        ("ccf.most_fertility_class", 1, 8), ("ccf.least_spruce_share", 0, 1), ("resistance.low", 0, 1e9),
        ("resistance.high", 0, 1e9), ("resistance.dispersal", 1e-9, 1e9), ("sweep.n_runs", 1, 1e6), ("sweep.robust_share", 0, 1),
    ):
        number(path, low, high)
    weights = config.get("resistance", {}).get("weights") if isinstance(config.get("resistance"), Mapping) else None
    wanted = set(WEIGHTS)
    if not isinstance(weights, Mapping) or set(weights) != wanted:
        found.append(f"resistance.weights: exactly {sorted(wanted)} are needed")
    elif not all(map(is_number, weights.values())) or abs(sum(weights.values()) - 1) > 1e-6:
        found.append("resistance.weights: they must be numbers with a sum of 1")
    box = config.get("bbox")
    if not (isinstance(box, list | tuple) and len(box) == 4 and all(map(is_number, box)) and box[0] < box[2] and box[1] < box[3]):
        found.append("bbox: four numbers x_min, y_min, x_max, y_max with min < max are needed")
    return found


def _is_number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def _within(low: float, high: float = float("inf")) -> Callable[[Any], bool]:
    return lambda x: _is_number(x) and low <= x <= high


def _one_of(*allowed: str) -> Callable[[Any], bool]:
    return lambda x: isinstance(x, str) and x in allowed


def _listed(each: Callable[[Any], bool]) -> Callable[[Any], bool]:
    return lambda x: isinstance(x, list | tuple) and len(x) > 0 and all(map(each, x))


def _mapped(each: Callable[[Any], bool]) -> Callable[[Any], bool]:
    return lambda x: isinstance(x, Mapping) and len(x) > 0 and all(map(each, x.values()))


def _whole(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _flag(x: Any) -> bool:
    return isinstance(x, bool)


def _named(x: Any) -> bool:
    return isinstance(x, str) and x != ""


def _season(x: Any) -> bool:
    return isinstance(x, Mapping) and all(re.fullmatch(r"(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])", str(x.get(k, ""))) for k in ("start", "end"))


def _positive(x: Any) -> bool:
    return _is_number(x) and x > 0


SHARE, AT_LEAST_0 = (_within(0, 1), "a number from 0 to 1"), (_within(0), "a number of 0 or more")
NUMBER, POSITIVE = (_is_number, "a number"), (_listed(_positive), "a list of positive numbers")
#: Every other key of a configuration: its section, its name, the test that it must pass, and how that is told.
KEYS: tuple[tuple[str, str, tuple[Callable[[Any], bool], str]], ...] = (
    ("dtw", "reference", (_one_of("dtw_2019", "dtw_2023_cmv2"), "dtw_2019 or dtw_2023_cmv2")),
    ("dtw", "unit", (_one_of("mm", "cm", "m"), "mm, cm or m")),
    ("dtw", "resolution_m", AT_LEAST_0),
    ("dtw", "culvert_burn", (_flag, "true or false")),
    ("dtw", "pit_removal", (_one_of("carve", "breach"), "carve or breach")),
    ("dtw", "flow", (_one_of("dinf", "d8", "mfd"), "dinf, d8 or mfd")),
    ("dtw", "thresholds_ha", POSITIVE),
    ("weather", "enabled", (_flag, "true or false")),
    ("weather", "station", (lambda x: x is not None and x != "", "a station")),
    ("weather", "antecedent_days", (_listed(lambda x: _whole(x) and x > 0), "a list of positive whole numbers")),
    ("soil", "enabled", (_flag, "true or false")),
    ("soil", "peat_penalty", SHARE),
    ("rootrot", "period", (_season, "start and end as month and day")),
    ("rootrot", "frost_c", NUMBER),
    ("rootrot", "spore_c", NUMBER),
    ("rootrot", "setback_m", AT_LEAST_0),
    ("planning", "buffer_widths_m", POSITIVE),
    ("planning", "habitat_widths_m", POSITIVE),
    ("planning", "wet_m", AT_LEAST_0),
    ("planning", "channel_resolution_m", AT_LEAST_0),
    ("planning", "retention_trees_ha", AT_LEAST_0),
    ("planning", "retention_dbh_cm", AT_LEAST_0),
    ("planning", "deadwood_trees_ha", AT_LEAST_0),
    ("planning", "deadwood_zone", (_named, "a name")),
    ("planning", "deadwood_m3_ha", AT_LEAST_0),
    ("planning", "deadwood_standing", SHARE),
    ("planning", "stumps_ha", AT_LEAST_0),
    ("ccf", "least_peat_code", AT_LEAST_0),
    ("ccf", "drained_states", (_listed(_whole), "a list of whole numbers")),
    ("erosion", "benchmark", (_named, "a name")),
    ("erosion", "r_factor", AT_LEAST_0),
    ("erosion", "length_exponent", AT_LEAST_0),
    ("erosion", "slope_exponent", AT_LEAST_0),
    ("erosion", "most_length_m", AT_LEAST_0),
    ("erosion", "k_default", SHARE),
    ("erosion", "c_default", SHARE),
    ("erosion", "k_by_soil", (_mapped(_within(0, 1)), "codes with numbers from 0 to 1")),
    ("erosion", "c_by_cover", (_mapped(_within(0, 1)), "codes with numbers from 0 to 1")),
    ("nodes", "sources", (_listed(_one_of("protected_areas", "habitat_s10", "ymparistotuki", "old_stands")), "a list of known sources")),
    ("nodes", "old_age", AT_LEAST_0),
    ("resistance", "resolution_m", AT_LEAST_0),
    ("resistance", "water", AT_LEAST_0),
    ("resistance", "age_cap", AT_LEAST_0),
    ("resistance", "basal_area_cap", AT_LEAST_0),
    ("resistance", "deciduous_share", AT_LEAST_0),
    ("resistance", "land_cover", (_mapped(_within(0, 1)), "categories with numbers from 0 to 1")),
    ("resistance", "coarsen", AT_LEAST_0),
    ("resistance", "backbone_k", AT_LEAST_0),
    ("resistance", "corridor_slack", AT_LEAST_0),
    ("patches", "merge_m", AT_LEAST_0),
    ("patches", "least_ha", AT_LEAST_0),
    ("sweep", "seed", AT_LEAST_0),
    ("sweep", "weight_by", AT_LEAST_0),
    ("sweep", "land_cover_by", AT_LEAST_0),
    ("sweep", "dispersal_by", AT_LEAST_0),
)


def every_problem(config: Mapping[str, Any]) -> list[str]:
    """``problems`` and what is wrong with all other keys; a section that isn't there is told once, not for each key."""
    found, missing = problems(config), []
    for section, key, (good, wanted) in KEYS:
        part = config.get(section)
        if not isinstance(part, Mapping):
            missing += [] if section in missing else [section]
        elif key not in part:
            found.append(f"{section}.{key}: it is missing")
        elif not good(part[key]):
            found.append(f"{section}.{key}: {wanted} is needed, not {part[key]!r}")
    return found + [f"{section}: the section is missing" for section in missing]


def read_config(path: str) -> dict[str, Any]:
    """A JSON configuration without problems; else an error that tells all of them."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    if found := every_problem(config):
        raise ValueError("\n".join(found))
    return config


def config_digest(config: Mapping[str, Any]) -> str:
    """SHA-256 of the configuration in canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
