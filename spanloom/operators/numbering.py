"""Positions of sorted rows without gathering them in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a folder of our own where it is unset, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, so that it is computed once and can't change."""
    path = f"{shared_folder(df.sparkSession)}/spanloom/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[Column], name: str = "position") -> DataFrame:
    """df with the 0-based position of each row in the order of keys.

    A range sort; a row's number is its place in its partition plus the rows of the partitions before,
    of which there is one row each.
    """
    in_order = kept(df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = in_order.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return in_order.join(F.broadcast(sizes), part == F.col("_part")).withColumn(name, place).drop("_at", "_part", "_before")
