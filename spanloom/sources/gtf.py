"""GTF: transcripts as regions, exons as their blocks, tied by an attribute.

Starts are counted from 1 in the file. Features without the attribute or without length are left
out. An exon may come before its transcript; of transcripts with one id the last gets the exons.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.options import GtfNames
from spanloom.sources.bed import EXON, RegionFileError, read_lines


def attribute(attributes: Column, key: str) -> Column:
    """Value of `key "value"` or key value, up to the semicolon; null if it isn't there."""
    found = F.regexp_extract(attributes, rf'(?:^|;)\s*{re.escape(key)}\s+"?([^";]*)"?', 1)
    return F.nullif(F.trim(found), F.lit(""))


def features(lines: DataFrame, names: GtfNames) -> DataFrame:
    """(line_no, chrom, feature, start, end, strand, id) of the features that count."""
    rows = lines.filter(~F.startswith("line", F.lit("#"))).withColumn("f", F.split("line", "\t")).filter(F.size("f") >= 9)
    strand = F.when(F.col("f")[6].isin("+", "-"), F.col("f")[6]).otherwise(".")
    out = rows.select(
        "line_no",
        F.col("f")[0].alias("chrom"),
        F.col("f")[2].alias("feature"),
        (F.col("f")[3].try_cast("bigint") - 1).alias("start"),
        F.col("f")[4].try_cast("bigint").alias("end"),
        strand.alias("strand"),
        attribute(F.col("f")[8], names.attribute).alias("id"),
    )
    return out.filter(F.col("id").isNotNull() & (F.col("start") < F.col("end")) & F.col("feature").isin(names.transcript, names.exon))


def transcripts(lines: DataFrame, names: GtfNames = GtfNames()) -> DataFrame:
    """Regions with exons cut to the transcript; exons are null where none is left."""
    every = features(lines, names)
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.col("line_no").desc())) == 1
    found = every.filter(F.col("feature") == names.transcript).withColumn("_last", last)
    blocks = every.filter(F.col("feature") == names.exon).groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_exons"))
    joined = found.join(blocks, (F.col("id") == F.col("_id")) & F.col("_last"), "left")
    cut = F.filter(F.transform("_exons", lambda x: F.struct(F.greatest(x["start"], F.col("start")).alias("start"), F.least(x["end"], F.col("end")).alias("end"))), lambda x: x["start"] < x["end"])
    exons = F.when(F.size(cut) > 0, cut).cast(EXON)
    return joined.select(
        "line_no", "chrom", "start", "end", F.col("id").alias("name"), F.lit(None).cast("int").alias("bed_field_count"), F.lit(None).cast("float").alias("score"),
        F.lit(None).cast("string").alias("score_raw"), "strand", F.lit(None).cast("string").alias("strand_raw"), _extra(exons).alias("extra_fields"), exons.alias("exons"),
    )


def _extra(exons: Column) -> Column:
    """BED fields 7 to 12 of a transcript with exons."""
    sizes = F.array_join(F.transform(exons, lambda x: (x["end"] - x["start"]).cast("string")), ",")
    starts = F.array_join(F.transform(exons, lambda x: (x["start"] - F.col("start")).cast("string")), ",")
    made = F.array(F.col("start").cast("string"), F.col("end").cast("string"), F.lit("0"), F.size(exons).cast("string"), F.concat(sizes, F.lit(",")), F.concat(starts, F.lit(",")))
    return F.when(F.size(exons) > 0, made).otherwise(F.array().cast("array<string>"))


def read_gtf(spark: SparkSession, path: str, names: GtfNames = GtfNames()) -> DataFrame:
    """Regions of one group, group_idx 0."""
    found = transcripts(read_lines(spark, path), names)
    if found.isEmpty():
        raise RegionFileError(f"{path}: no feature {names.transcript} with {names.attribute}")
    return found.withColumn("group_idx", F.lit(0))
