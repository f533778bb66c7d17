"""Regions before any signal is read: spelling of chromosomes, common chromosomes, blacklist, empty groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.chroms import normal_chrom
from spanloom.operators.intervals import merge, overlap_join, subtract
from spanloom.options import EmptyGroups


#: Width of the tiles on which starts meet the blacklist, whose intervals are some thousand bases long.
BLACK_TILE = 4096


class EmptyResultError(ValueError):
    """No region is left, or a group is empty where it must not be."""


def common_chroms(chroms: DataFrame, n_samples: int) -> DataFrame:
    """(norm): the chromosomes that every score file has. chroms: (sample_idx, chrom, length)."""
    named = chroms.select("sample_idx", normal_chrom(F.col("chrom")).alias("norm")).distinct()
    return named.groupBy("norm").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n_samples).select("norm")


def chrom_sizes(chroms: DataFrame) -> DataFrame:
    """(norm, length): of the first score file that has the chromosome."""
    return chroms.groupBy(normal_chrom(F.col("chrom")).alias("norm")).agg(F.min_by("length", F.struct("sample_idx", "chrom")).alias("length"))


def spelled_like_first(regions: DataFrame, chroms: DataFrame) -> DataFrame:
    """regions with the chromosome as the first score file spells it, where it has it."""
    first = chroms.filter("sample_idx = 0").groupBy(normal_chrom(F.col("chrom")).alias("_norm")).agg(F.min("chrom").alias("_spelling"))
    joined = regions.withColumn("_own", normal_chrom(F.col("chrom"))).join(first, F.col("_own") == F.col("_norm"), "left")
    return joined.withColumn("chrom", F.coalesce("_spelling", "chrom")).drop("_own", "_norm", "_spelling")


def on_common_chroms(regions: DataFrame, chroms: DataFrame, n_samples: int) -> DataFrame:
    common = common_chroms(chroms, n_samples)
    return regions.join(common, normal_chrom(regions.chrom) == common.norm, "left_semi")


def blacklist(intervals: DataFrame) -> DataFrame:
    """(norm, start, end), merged. intervals: (chrom, start, end)."""
    return merge(intervals.select(normal_chrom(F.col("chrom")).alias("norm"), "start", "end"), ["norm"])


def allowed(black: DataFrame, sizes: DataFrame) -> DataFrame:
    """(norm, start, end): what the blacklist leaves of each chromosome."""
    return subtract(sizes.select("norm", F.lit(0).cast("long").alias("start"), F.col("length").alias("end")), black, ["norm"])


def outside_blacklist(regions: DataFrame, black: DataFrame, chroms: DataFrame) -> DataFrame:
    """regions (with region_id) whose start is on no blacklisted interval.

    On a chromosome with blacklisted intervals a start past the chromosome's end goes too. Only the
    start counts. Starts meet intervals on tiles, so that a crowded chromosome is spread.
    """
    starts = regions.select("region_id", normal_chrom(F.col("chrom")).alias("norm"), F.col("start").alias("l_start"), (F.col("start") + 1).alias("l_end"))
    covered = overlap_join(starts, black.withColumnsRenamed({"start": "r_start", "end": "r_end"}), "norm", BLACK_TILE).select("region_id")
    ends = chrom_sizes(chroms).join(black.select("norm").distinct(), "norm")
    past = starts.join(ends, "norm").filter(F.col("l_start") >= F.col("length")).select("region_id")
    return regions.join(covered.unionByName(past).distinct(), "region_id", "left_anti").select(*regions.columns)


def renumbered(regions: DataFrame, groups: DataFrame, policy: EmptyGroups) -> tuple[DataFrame, DataFrame]:
    """(regions, groups) without the groups that have no region, numbered anew; or an error."""
    n = {r.group_idx for r in regions.select("group_idx").distinct().collect()}
    rows = sorted(groups.collect(), key=lambda g: g.group_idx)
    if not n:
        raise EmptyResultError("No regions remain after pre-dispatch filtering.")
    if policy is EmptyGroups.ERROR and any(g.group_idx not in n for g in rows):
        empty = ", ".join(g.group_label for g in rows if g.group_idx not in n)
        raise EmptyResultError(f"No regions are left in: {empty}")
    left = [g for g in rows if g.group_idx in n]
    spark = regions.sparkSession
    numbers = F.create_map(*[F.lit(x) for k, g in enumerate(left) for x in (g.group_idx, k)])
    new = spark.createDataFrame([(k, g.group_label) for k, g in enumerate(left)], "group_idx int, group_label string")
    return regions.withColumn("group_idx", numbers[F.col("group_idx")]), new


