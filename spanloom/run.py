"""A matrix from files to files."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.chroms import normal_chrom
from spanloom.functions.names import sample_labels
from spanloom.operators.numbering import kept
from spanloom.operators.ordering import group_counts, metric, order_columns
from spanloom.operators.regions import EmptyResultError, blacklist, on_common_chroms, outside_blacklist, renumbered, spelled_like_first
from spanloom.options import General, GtfNames, Layout
from spanloom.plans.bins import with_bins
from spanloom.plans.matrix import matrix
from spanloom.shipping import ship
from spanloom.sinks import files
from spanloom.sources.bed import first_error, parse_bed, read_lines
from spanloom.sources.bigwig import read_signal
from spanloom.sources.regions import load_regions

#: Bases by which the windows of regions are told to the readers of signals.
STRETCH = 1 << 17


@dataclass(frozen=True)
class Files:
    """Where a matrix comes from and goes to."""

    regions: list[str]
    scores: list[str]
    matrix: str | None = None
    values: str | None = None
    sorted_regions: str | None = None
    blacklist: str | None = None
    labels: list[str] | None = None


@dataclass
class Result:
    """The header, and the rows in the order in which they are written."""

    header: dict[str, Any]
    rows: DataFrame


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """Merged intervals of a BED file, whatever its groups."""
    lines = read_lines(spark, path).filter((F.trim("line") != "") & ~F.startswith("line", F.lit("#")))
    parsed = parse_bed(lines.withColumn("raw", F.col("line")))
    first_error(parsed, path)
    return blacklist(parsed.select("chrom", "start", "end"))


def compute(spark: SparkSession, regions: DataFrame, groups: DataFrame, signal: DataFrame, chroms: DataFrame, samples: list[str], layout: Layout, general: General, black: DataFrame | None = None) -> Result:
    """The matrix of regions and signal, whichever way they were read.

    Regions go that lie on a chromosome some sample lacks, or start on the blacklist. Rows that
    filters take leave their group with a count of zero.
    """
    n, n_bins = len(samples), layout.n_bins(general.bin_size)
    chosen = general.sort_samples(n)
    found = on_common_chroms(spelled_like_first(regions, chroms), chroms, n)
    if black is not None:
        found = outside_blacklist(found, black, chroms)
    found, groups = renumbered(kept(found), groups, general.empty_before)
    rows = matrix(found, signal, chroms, layout, general, n)
    rows = rows.withColumn("metric", metric(general.sort_using, chosen, n, n_bins, general.metagene)).join(groups, "group_idx")
    rows = kept(rows.orderBy(*order_columns(general.sort_regions)))
    per_group = [(r.group_label, r.n) for r in group_counts(rows, groups).orderBy("group_idx").collect()]
    if not sum(count for _, count in per_group):
        raise EmptyResultError("No regions remain after runtime row filtering.")
    return Result(files.header(layout, general, per_group, samples), rows.orderBy(*order_columns(general.sort_regions)))


def window_ranges(regions: DataFrame, layout: Layout, general: General) -> list[tuple[str, int, int]]:
    """(chromosome, start, end) of the stretches of STRETCH bases that windows touch, neighbours joined.

    Chromosomes end below 2**32, so each gives 2**15 stretches at most.
    """
    windows = with_bins(regions.withColumn("norm", normal_chrom(F.col("chrom"))), layout, general).filter("window_start < window_end")
    at = F.explode(F.sequence(F.floor(F.greatest("window_start", F.lit(0)) / STRETCH), F.floor(F.greatest(F.col("window_end") - 1, F.lit(0)) / STRETCH)))
    out: list[tuple[str, int, int]] = []
    for r in windows.select("norm", at.alias("k")).distinct().orderBy("norm", "k").collect():
        if out and out[-1][0] == r.norm and out[-1][2] == r.k * STRETCH:
            out[-1] = (r.norm, out[-1][1], (r.k + 1) * STRETCH)
        else:
            out.append((r.norm, r.k * STRETCH, (r.k + 1) * STRETCH))
    return out


def run(spark: SparkSession, where: Files, layout: Layout, general: General, names: GtfNames = GtfNames()) -> Result:
    ship(spark)
    layout.counts(general.bin_size)
    labels = sample_labels(where.scores, where.labels)
    regions, groups = load_regions(spark, where.regions, names)
    signal, chroms = read_signal(spark, where.scores, window_ranges(regions, layout, general))
    black = read_blacklist(spark, where.blacklist) if where.blacklist else None
    out = compute(spark, regions, groups, signal, chroms, labels, layout, general, black)
    if where.matrix:
        files.write_matrix(where.matrix, out.header, out.rows, general.metagene)
    if where.values:
        files.write_values(where.values, out.header, out.rows)
    if where.sorted_regions:
        files.write_regions(where.sorted_regions, out.rows, general.metagene)
    return out
