"""Options of a matrix query, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class OptionError(ValueError):
    """An option, or a combination of options, that no matrix can be made with."""


class Statistic(str, Enum):
    MEAN = "mean"
    MEDIAN = "median"
    MIN = "min"
    MAX = "max"
    STD = "std"
    SUM = "sum"


class SortOrder(str, Enum):
    KEEP = "keep"
    NO = "no"
    ASCEND = "ascend"
    DESCEND = "descend"


class SortMetric(str, Enum):
    MEAN = "mean"
    MEDIAN = "median"
    MAX = "max"
    MIN = "min"
    SUM = "sum"
    REGION_LENGTH = "region_length"


class Anchor(str, Enum):
    TSS = "TSS"
    TES = "TES"
    CENTER = "center"


class EmptyGroups(str, Enum):
    """What becomes of a group without regions: before the computation, and after row filters."""

    DROP = "drop"
    ERROR = "error"
    KEEP_AT_ZERO = "keep at zero"


@dataclass(frozen=True)
class General:
    """What both layouts share."""

    bin_size: int = 10
    statistic: Statistic = Statistic.MEAN
    missing_as_zero: bool = False
    skip_zeros: bool = False
    min_threshold: float | None = None
    max_threshold: float | None = None
    scale: float = 1.0
    sort_regions: SortOrder = SortOrder.KEEP
    sort_using: SortMetric = SortMetric.MEAN
    sort_using_samples: tuple[int, ...] | None = None
    metagene: bool = False
    verbose: bool = False
    processors: int = 1

    def __post_init__(self) -> None:
        if self.bin_size <= 0:
            raise OptionError("bin size must be greater than zero")
        object.__setattr__(self, "statistic", Statistic(self.statistic))
        object.__setattr__(self, "sort_regions", SortOrder(self.sort_regions))
        object.__setattr__(self, "sort_using", SortMetric(self.sort_using))

    @property
    def empty_before(self) -> EmptyGroups:
        return EmptyGroups.ERROR if self.sort_regions is SortOrder.KEEP else EmptyGroups.DROP

    def sort_samples(self, n_samples: int) -> list[int]:
        """0-based samples that the sort metric uses; checked whatever the order."""
        if self.sort_using_samples is None:
            return list(range(n_samples))
        for s in self.sort_using_samples:
            if not 1 <= s <= n_samples:
                raise OptionError(f"sample {s} to sort by is not between 1 and {n_samples}")
        return [s - 1 for s in self.sort_using_samples]


def _multiple(name: str, length: int, bin_size: int) -> int:
    if length < 0:
        raise OptionError(f"{name} must not be negative")
    if length % bin_size:
        raise OptionError(f"{name} ({length}) must be a multiple of the bin size ({bin_size})")
    return length // bin_size


@dataclass(frozen=True)
class ReferencePoint:
    """Bins of one width around an anchor."""

    anchor: Anchor = Anchor.TSS
    upstream: int = 500
    downstream: int = 1500
    nan_after_end: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "anchor", Anchor(self.anchor))

    def counts(self, bin_size: int) -> tuple[int, int]:
        if self.upstream + self.downstream <= 0:
            raise OptionError("upstream and downstream must not both be zero")
        return _multiple("upstream", self.upstream, bin_size), _multiple("downstream", self.downstream, bin_size)

    def n_bins(self, bin_size: int) -> int:
        return sum(self.counts(bin_size))


@dataclass(frozen=True)
class ScaleRegions:
    """Flanks and unscaled ends at their own width, the body scaled to one length."""

    body: int = 1000
    upstream: int = 0
    downstream: int = 0
    unscaled_5: int = 0
    unscaled_3: int = 0
    nan_after_end: bool = field(default=False, init=False)

    def counts(self, bin_size: int) -> tuple[int, int, int, int, int]:
        """Bins of upstream, unscaled 5', body, unscaled 3', downstream."""
        lengths = {"upstream": self.upstream, "unscaled 5 prime": self.unscaled_5, "region body length": self.body, "unscaled 3 prime": self.unscaled_3, "downstream": self.downstream}
        n = tuple(_multiple(k, v, bin_size) for k, v in lengths.items())
        if (self.unscaled_5 or self.unscaled_3) and not self.body:
            raise OptionError("unscaled ends need a region body length greater than zero")
        if not sum(n):
            raise OptionError("the layout has no bins")
        return n

    def n_bins(self, bin_size: int) -> int:
        return sum(self.counts(bin_size))


Layout = ReferencePoint | ScaleRegions


@dataclass(frozen=True)
class GtfNames:
    """Which GTF features are regions and blocks, and which attribute ties them."""

    transcript: str = "transcript"
    exon: str = "exon"
    attribute: str = "transcript_id"
