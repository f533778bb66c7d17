"""Statistics of bins from run lengths: every overlap counts with its width in bases.

For a bin, C is the number of bases with signal and W the number of bases that may count. Missing is
null. Where missing counts as zero, the W - C other bases are zeros, and a bin without any base is zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.options import Statistic


def partials(statistic: Statistic) -> dict[str, Column]:
    """What is aggregated from rows (w, x); a row that stands for an empty cell has null for both."""
    w, x = F.col("w").cast("double"), F.col("x")
    out = {"covered": F.sum("w")}
    if statistic in (Statistic.MEAN, Statistic.SUM, Statistic.STD):
        out["wx"] = F.sum(w * x)
    if statistic is Statistic.STD:
        out["wxx"] = F.sum(w * x * x)
    if statistic is Statistic.MIN:
        out["low"] = F.min("x")
    if statistic is Statistic.MAX:
        out["high"] = F.max("x")
    if statistic is Statistic.MEDIAN:
        out["runs"] = F.collect_list(F.when(F.col("w").isNotNull(), F.struct("x", "w")))
    return out


def value(statistic: Statistic, zero: bool) -> Column:
    """The bin's value from partials(), covered and counted."""
    covered, counted = F.coalesce(F.col("covered"), F.lit(0)), F.coalesce(F.col("counted"), F.lit(0))
    nothing = F.lit(0.0) if zero else F.lit(None).cast("double")
    n = (counted if zero else covered).cast("double")
    gap = covered < counted
    if statistic is Statistic.SUM:
        out = F.col("wx")
    elif statistic is Statistic.MEAN:
        out = F.when(n > 0, F.col("wx") / n)
    elif statistic is Statistic.STD:
        out = F.when(n > 0, F.sqrt(F.greatest(n * F.col("wxx") - F.col("wx") * F.col("wx"), F.lit(0.0))) / n)
    elif statistic in (Statistic.MIN, Statistic.MAX):
        own, pick = (F.col("low"), F.least) if statistic is Statistic.MIN else (F.col("high"), F.greatest)
        out = F.when(gap & own.isNotNull(), pick(own, F.lit(0.0))).otherwise(own) if zero else own
    else:
        zeros = F.when(gap, F.array(F.struct(F.lit(0.0).alias("x"), (counted - covered).alias("w")))).otherwise(F.array().cast("array<struct<x:double,w:bigint>>"))
        out = weighted_median(F.concat(F.col("runs"), zeros) if zero else F.col("runs"))
    return F.coalesce(out, nothing)


def weighted_median(runs: Column) -> Column:
    """Median of the bases in runs (x, w); the mean of the two middle ones of an even number."""
    total = F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, r: a + r["w"])
    low, high = F.floor((total - 1) / 2), F.floor(total / 2)
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))

    def step(s: Column, r: Column) -> Column:
        seen = s["seen"] + r["w"]
        return F.struct(
            seen.alias("seen"),
            F.when(s["a"].isNull() & (seen > low), r["x"]).otherwise(s["a"]).alias("a"),
            F.when(s["b"].isNull() & (seen > high), r["x"]).otherwise(s["b"]).alias("b"),
        )

    return F.when(total > 0, F.aggregate(F.array_sort(runs), start, step, lambda s: (s["a"] + s["b"]) / 2))
