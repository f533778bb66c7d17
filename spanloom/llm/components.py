"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch


def star_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node of its component.

    Each round hangs a node's larger neighbours on its smallest one, then its smaller neighbours and
    itself likewise, until nothing changes; rounds grow with the logarithm of the largest component.
    Minima are combined before the shuffle, no group is gathered, and each round's edges are written
    to the shared folder, so that lost executors cost one round at most. Self-loops and repeated
    edges do no harm; no edges give no rows.
    """
    last, own = Scratch(edges.sparkSession), Scratch(edges.sparkSession)
    now = own.keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        n, mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == before or n == 0:
            break
        before = (n, mark)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # After the large star every edge runs from the larger to the smaller node.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        last.clear()
        last, own = own, Scratch(edges.sparkSession)
        now = own.keep(small, "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    last.clear()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
