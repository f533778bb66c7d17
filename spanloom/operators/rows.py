"""Filters on whole rows, an array of values for all samples of a region; null is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.options import General

VALUES = "values"


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def hits_threshold(low: float | None, high: float | None, values: str = VALUES) -> Column:
    """Whether a value is at most `low` or at least `high`, in a row without missing values."""
    full = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v))
    hit = F.lit(False)
    if low is not None:
        hit = hit | F.exists(values, lambda v: v <= low)
    if high is not None:
        hit = hit | F.exists(values, lambda v: v >= high)
    return full & F.coalesce(hit, F.lit(False))


def scaled(factor: float, values: str = VALUES) -> Column:
    return F.transform(values, lambda v: F.when(_finite(v), v * factor).otherwise(v))


def all_zero(values: str = VALUES) -> Column:
    """Whether the mean of the finite values is exactly zero, or there are none."""
    finite = F.filter(values, _finite)
    total = F.aggregate(finite, F.lit(0.0), lambda a, v: a + v)
    return (F.size(finite) == 0) | (total / F.size(finite) == 0)


def filter_rows(rows: DataFrame, general: General) -> DataFrame:
    """Thresholds on raw values, then the scale, then rows of zeros."""
    if general.min_threshold is not None or general.max_threshold is not None:
        rows = rows.filter(~hits_threshold(general.min_threshold, general.max_threshold))
    if general.scale != 1.0:
        rows = rows.withColumn(VALUES, scaled(general.scale))
    if general.skip_zeros:
        rows = rows.filter(~all_zero())
    return rows
