"""Half-open intervals [start, end) on named chromosomes: merge, subtract, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the tiles on which intervals meet; a few times the usual length of a bin or of a signal's interval.
TILE = 64


def islands(intervals: DataFrame, keys: list[str], gap: Column | int = 0) -> DataFrame:
    """intervals (keys, start, end) with island: those that touch, or lie at most `gap` apart, share a number."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end").over(before)
    opens = F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)
    return intervals.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(upto)).drop("_opens")


def merge(intervals: DataFrame, keys: list[str], gap: Column | int = 0) -> DataFrame:
    """(keys, start, end): the islands; intervals that touch merge."""
    return islands(intervals, keys, gap).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def subtract(spans: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of spans, one per keys, without the merged holes that fall on them; empty pieces vanish."""
    cut = holes.select(*keys, F.col("start").alias("h_start"), F.col("end").alias("h_end"))
    inside = (F.col("h_end") > F.col("start")) & (F.col("h_start") < F.col("end"))
    hit = spans.join(cut, keys).filter(inside)
    order = Window.partitionBy(*keys).orderBy("h_start")
    # A piece before each hole, and one after the last.
    first = hit.select(*keys, F.greatest("start", F.coalesce(F.lag("h_end").over(order), F.col("start"))).alias("start"), F.least("h_start", "end").alias("end"))
    last = hit.groupBy(*keys).agg(F.max(F.greatest("h_end", "start")).alias("start"), F.max("end").alias("end"))
    free = spans.join(cut.select(*keys, "h_start", "h_end"), keys, "left").groupBy(*keys).agg(F.max("start").alias("start"), F.max("end").alias("end"), F.max(F.coalesce(inside, F.lit(False))).alias("_hit")).filter("not _hit").drop("_hit")
    return first.unionByName(last).unionByName(free).filter("start < end")


def tiles(start: Column, end: Column, width: int = TILE) -> Column:
    """The tiles that a nonempty interval touches; none for an empty one. Coordinates may be negative."""
    first = F.floor(start / width)
    last = F.floor((end - 1) / width)
    return F.when(start < end, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int = TILE) -> DataFrame:
    """Pairs of left (l_start, l_end) and right (r_start, r_end) with equal key that overlap, each once.

    Both sides are spread over tiles, which makes the range join an equi-join: it partitions by
    place, not by key alone, and adaptive execution splits a crowded tile. A pair that shares several
    tiles is kept in the one where its overlap starts.
    """
    a = left.withColumn("tile", F.explode_outer(tiles(F.col("l_start"), F.col("l_end"), width)))
    b = right.withColumn("tile", F.explode_outer(tiles(F.col("r_start"), F.col("r_end"), width)))
    begin = F.greatest("l_start", "r_start")
    meets = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.floor(begin / width) == F.col("tile"))
    return a.join(b, [key, "tile"]).filter(meets).drop("tile")


def gap_percentile(intervals: DataFrame, keys: list[str], share: float = 0.75) -> DataFrame:
    """One row, gap: the percentile of the positive distances between neighbours; null without any."""
    nearest = Window.partitionBy(*keys).orderBy("start", "end")
    gaps = intervals.withColumn("gap", F.lead("start").over(nearest) - F.col("end")).filter("gap > 0")
    return gaps.agg(F.percentile("gap", share).alias("gap"))
