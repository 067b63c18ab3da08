"""Options of the three pipelines, with their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Ranks that an LCA can be asked for.
LCA_RANKS = (
    "superkingdom", "domain", "lineage", "kingdom", "subkingdom", "superphylum", "phylum", "subphylum", "superclass", "class",
    "subclass", "infraclass", "clade", "cohort", "subcohort", "superorder", "order", "suborder", "infraorder", "parvorder",
    "superfamily", "family", "subfamily", "tribe", "subtribe", "infratribe", "genus", "subgenus", "section", "series",
    "subseries", "subsection", "species", "species group", "species subgroup", "subspecies", "varietas", "morph", "subvariety",
    "forma", "forma specialis", "biotype", "genotype", "isolate", "pathogroup", "serogroup", "serotype", "strain",
)


class ConfigError(ValueError):
    """An option is out of range or contradicts another one."""


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ConfigError(f"{name} must lie in [{low}, {high}], not {value}")


def parse_size(text: str | float, base: int = 1000) -> float:
    """A number with an optional suffix K, M or G."""
    if isinstance(text, (int, float)):
        return float(text)
    number, suffix = text.strip(), ""
    if number and number[-1].upper() in "KMG":
        number, suffix = number[:-1], number[-1].upper()
    try:
        return float(number) * base ** " KMG".index(suffix or " ")
    except ValueError:
        raise ConfigError(f"not a size: {text!r}") from None


@dataclass(frozen=True)
class ReassignConfig:
    iters: int = 25
    scale: float = 0.9
    min_read_ani: float = 90.0
    min_read_length: float = 30
    max_read_length: float = math.inf
    min_read_count: int = 3
    match_reward: int = 1
    mismatch_penalty: int = -2
    gap_open_penalty: int = 5
    gap_extension_penalty: int = 2

    def __post_init__(self) -> None:
        _within("iters", self.iters, 0, 100_000)
        _within("scale", self.scale, 0, 1)
        _within("min_read_ani", self.min_read_ani, 0, 100)
        _within("min_read_count", self.min_read_count, 1, math.inf)
        _within("mismatch_penalty", self.mismatch_penalty, -math.inf, 0)
        if self.max_read_length < self.min_read_length:
            raise ConfigError("max_read_length is below min_read_length")


@dataclass(frozen=True)
class FilterConfig:
    """``min_norm_entropy`` and ``min_norm_gini`` take a number, "auto" (knee of the curve) or None (not used)."""

    min_read_ani: float = 90.0
    min_read_length: float = 30
    max_read_length: float = math.inf
    min_read_count: int = 3
    min_expected_breadth_ratio: float = 0.0
    min_norm_entropy: float | str | None = 0.0
    min_norm_gini: float | str | None = 1.0
    min_breadth: float = 0.0
    min_avg_read_ani: float = 90.0
    min_coverage_evenness: float = 0.0
    min_coeff_var: float = math.inf
    min_coverage_mean: float = 0.0
    include_low_detection: bool = False
    trim_ends: int = 0
    trim_min: int = 10
    trim_max: int = 90
    scale: float = 1_000_000.0
    bin_rule: str = "classic"
    read_length_freqs: bool = False
    read_hits_count: bool = False

    def __post_init__(self) -> None:
        for name in ("min_norm_entropy", "min_norm_gini"):
            value = getattr(self, name)
            if value in ("None", "none", ""):
                object.__setattr__(self, name, None)
            elif value is not None and value != "auto":
                object.__setattr__(self, name, float(value))
                _within(name, float(value), 0, 1)
        for name, high in (("min_read_ani", 100), ("min_avg_read_ani", 100), ("min_expected_breadth_ratio", 1), ("min_breadth", 1), ("min_coverage_evenness", 1), ("trim_min", 100), ("trim_max", 100)):
            _within(name, getattr(self, name), 0, high)
        _within("trim_ends", self.trim_ends, 0, math.inf)
        if self.trim_min >= self.trim_max:
            raise ConfigError("trim_min must be below trim_max")
        if self.max_read_length < self.min_read_length:
            raise ConfigError("max_read_length is below min_read_length")
        if self.bin_rule not in ("classic", "integer"):
            raise ConfigError("bin_rule is classic or integer")


@dataclass(frozen=True)
class LcaConfig:
    rank: str = "species"
    scale: float = 1_000_000.0
    custom: bool = False

    def __post_init__(self) -> None:
        if self.rank not in LCA_RANKS:
            raise ConfigError(f"unknown rank {self.rank!r}; known are {', '.join(LCA_RANKS)}")
