"""Order of rows within their groups, group counts and boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.options import General, SortMetric, SortOrder


def selected(values: str, samples: list[int], n_samples: int, n_bins: int) -> Column:
    """The values of some samples, without the missing."""
    if samples == list(range(n_samples)):
        return F.array_compact(values)
    return F.array_compact(F.concat(*[F.slice(values, s * n_bins + 1, n_bins) for s in samples]))


def metric(kind: SortMetric, samples: list[int], n_samples: int, n_bins: int, metagene: bool = False, values: str = "values") -> Column:
    """What a row is sorted by; null without values, but zero for the sum."""
    if kind is SortMetric.REGION_LENGTH:
        plain = (F.col("end") - F.col("start")).cast("double")
        if not metagene:
            return plain
        spliced = F.aggregate("exons", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"]).cast("double")
        return F.when(F.size("exons") > 0, spliced).otherwise(plain)
    own = selected(values, samples, n_samples, n_bins)
    total = F.aggregate(own, F.lit(0.0), lambda a, v: a + v)
    if kind is SortMetric.SUM:
        return total
    if kind is SortMetric.MEAN:
        return F.when(F.size(own) > 0, total / F.size(own))
    if kind is SortMetric.MAX:
        return F.array_max(own)
    if kind is SortMetric.MIN:
        return F.array_min(own)
    ordered, n = F.array_sort(own), F.size(own)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def order_columns(order: SortOrder) -> list[Column]:
    """Sort keys of rows with group_idx, chrom, window_start, window_end, region_id and metric.

    Ties go by the order in which regions lie on the chromosomes; `descend` is `ascend` backwards.
    """
    place = ["chrom", "window_start", "window_end", "region_id"]
    if order is SortOrder.KEEP:
        return [F.col("region_id")]
    if order is SortOrder.NO:
        return [F.col("group_idx"), *map(F.col, place)]
    if order is SortOrder.ASCEND:
        return [F.col("group_idx"), F.col("metric").asc_nulls_last(), *map(F.col, place)]
    return [F.col("group_idx"), F.col("metric").desc_nulls_first(), *[F.col(c).desc() for c in place]]


def ordered(rows: DataFrame, general: General, n_samples: int, n_bins: int) -> DataFrame:
    """rows in the order in which they are written; a range sort, no single task holds them all."""
    if general.sort_regions in (SortOrder.ASCEND, SortOrder.DESCEND):
        rows = rows.withColumn("metric", metric(general.sort_using, general.sort_samples(n_samples), n_samples, n_bins, general.metagene))
    else:
        general.sort_samples(n_samples)
    return rows.orderBy(*order_columns(general.sort_regions))


def group_counts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """groups (group_idx, group_label) with n, zero for those without rows."""
    n = rows.groupBy("group_idx").agg(F.count(F.lit(1)).alias("n"))
    return groups.join(n, "group_idx", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def group_boundaries(counts: DataFrame) -> DataFrame:
    """counts and boundary, the number of rows up to and with the group. One row per group, a few."""
    return counts.withColumn("boundary", F.sum("n").over(Window.orderBy("group_idx").rowsBetween(Window.unboundedPreceding, 0)))


def sample_boundaries(n_samples: int, n_bins: int) -> list[int]:
    return [k * n_bins for k in range(n_samples + 1)]
