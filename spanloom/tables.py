"""Regions, signal and the like derived from the general test tables, in SQL that Spark and DuckDB share.

Values are whole numbers, so that sums are exact in any order. {minute} is the minute of an event since 2024.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.shipping import ship

MINUTE = {"spark": "CAST(timestampdiff(MINUTE, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) AS bigint)", "duckdb": "CAST(floor((epoch_us(ts) - 1704067200000000) / 60000000) AS bigint)"}

SIGNAL = """
SELECT sample_idx, chrom, start_ AS s, end_ AS e, value FROM (
  SELECT sample_idx, chrom, m AS start_, value,
         least(m + 30, coalesce(lead(m) OVER (PARTITION BY sample_idx, chrom ORDER BY m, event_id), m + 30)) AS end_
  FROM (SELECT CAST(user_id % 3 AS int) AS sample_idx, event_type AS chrom, event_id, {minute} AS m, CAST(round(value * 100) AS double) AS value FROM events) a
) b WHERE start_ < end_
"""

REGIONS = """
SELECT o_orderkey AS region_id,
       CAST(ascii(substr(o_orderpriority, 1, 1)) - 49 AS int) AS group_idx, o_orderpriority AS group_label,
       CASE o_orderkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS chrom,
       CAST((o_orderkey * 37) % 42000 AS bigint) AS s,
       CAST((o_orderkey * 37) % 42000 + 100 + o_custkey % 400 AS bigint) AS e,
       CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '.' END AS strand
FROM orders
"""

#: Blocks of up to 49 bases, 60 apart; a region without lines has none.
EXONS = """
SELECT r.region_id, r.s + (n - 1) * 60 AS s, r.s + (n - 1) * 60 + 20 + k % 30 AS e
FROM (SELECT l_orderkey, l_linenumber AS n, max(l_partkey) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber) l
JOIN ({regions}) r ON r.region_id = l_orderkey
"""

CHROMS = "SELECT sample_idx, chrom, CAST(max(e) AS bigint) AS length FROM ({signal}) x GROUP BY sample_idx, chrom"
BLACKLIST = "SELECT event_type AS chrom, {minute} AS s, {minute} + 40 AS e FROM events WHERE event_id % 97 = 0"


def sql(name: str, engine: str) -> str:
    signal = SIGNAL.replace("{minute}", MINUTE[engine])
    regions = REGIONS
    text = {"signal": signal, "regions": regions, "exons": EXONS.replace("{regions}", regions), "chroms": CHROMS.replace("{signal}", signal), "blacklist": BLACKLIST.replace("{minute}", MINUTE[engine])}
    return text[name]


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    ship(spark)
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables above; its interval is (start, end)."""
    needs = {"signal": ["events"], "chroms": ["events"], "blacklist": ["events"], "regions": ["orders"], "exons": ["orders", "lineitem"]}[name]
    load(spark, sf_dir, *needs)
    if name in ("signal", "chroms"):
        # In the order of place, rows that are shuffled to meet their neighbours compress better.
        spark.table("events").sortWithinPartitions("event_type", F.col("user_id") % 3, "ts").createOrReplaceTempView("events")
    df = spark.sql(sql(name, "spark"))
    return df.withColumnsRenamed({"s": "start", "e": "end"}) if name != "chroms" else df


def lengths(signal: DataFrame) -> DataFrame:
    """The table chroms, of a derived signal, whose shuffle it shares.

    Spark reuses a shuffle of the same columns only: the count, which is never negative, keeps it from leaving out the value.
    """
    found = signal.groupBy("sample_idx", "chrom").agg(F.max("end").cast("long").alias("length"), F.count("value").alias("_n"))
    return found.filter("_n >= 0").drop("_n")
