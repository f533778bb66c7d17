"""Region files of either format, as one table with one numbering of groups and regions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.names import natural_label, unique_labels, with_unique_names
from spanloom.options import GtfNames
from spanloom.sources.bed import RegionFileError, read_bed
from spanloom.sources.gtf import read_gtf

COLUMNS = ["region_id", "group_idx", "chrom", "start", "end", "name", "bed_field_count", "score", "score_raw", "strand", "strand_raw", "extra_fields", "exons"]


def is_gtf(path: str) -> bool:
    return re.search(r"\.(gtf|gff|gff3)(\.gz)?$", path, re.I) is not None


def load_regions(spark: SparkSession, paths: list[str], names: GtfNames = GtfNames()) -> tuple[DataFrame, DataFrame]:
    """(regions, groups (group_idx, group_label)) of all files.

    region_id rises with group and line. Of one file the default label is `genes`, of several
    each has its file's name. Labels are told apart over all files, names of BED regions within a group.
    """
    if not paths:
        raise RegionFileError("no region files")
    parts, labels = [], []
    for path in paths:
        default = "genes" if len(paths) == 1 else natural_label(path)
        if is_gtf(path):
            found, raw, bed = read_gtf(spark, path, names), [default], False
        else:
            (found, raw), bed = read_bed(spark, path, default), True
        found = found.withColumn("group_idx", F.col("group_idx") + len(labels))
        found = found.withColumn("region_id", F.shiftleft(F.col("group_idx").cast("long"), 48) + F.col("line_no")).select(COLUMNS)
        parts.append(with_unique_names(found) if bed else found)
        labels += [(label, default) for label in raw]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    groups = spark.createDataFrame(list(enumerate(unique_labels(labels))), "group_idx int, group_label string")
    return every, groups
