"""Command line: `scale-regions`, `reference-point`, and `header`, `values`, `diff` of written matrices."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from spanloom.options import Anchor, General, GtfNames, Layout, OptionError, ReferencePoint, ScaleRegions, SortMetric, SortOrder, Statistic
from spanloom.run import Files, run

#: Short flags of several letters, which a parser would read as one flag and its value.
MISLEADING = {"-bs": "--binSize", "-bl": "--blackListFileName", "-out": "--outFileName"}


def distance(text: str) -> int:
    """A length; a negative one is taken without its sign, with a warning."""
    n = int(text)
    if n < 0:
        print(f"warning: {n} is taken as {-n}", file=sys.stderr)
    return abs(n)


def processors(text: str) -> int:
    cores = os.cpu_count() or 1
    if text in ("max", "max/2"):
        return cores if text == "max" else max(1, cores // 2)
    return min(max(1, int(text)), cores)


def _common(p: argparse.ArgumentParser) -> None:
    add = p.add_argument
    add("-R", "--regionsFileName", nargs="+", required=True, metavar="FILE", help="BED or GTF files")
    add("-S", "--scoreFileName", nargs="+", required=True, metavar="FILE", help="bigWig files")
    add("-o", "--outFileName", required=True, help="the matrix, gzip")
    add("--outFileNameMatrix", help="a plain table of the values")
    add("--outFileSortedRegions", help="the regions in the order of the matrix")
    add("--binSize", "--bs", type=int, default=10)
    add("--sortRegions", choices=[x.value for x in SortOrder], default="keep")
    add("--sortUsing", choices=[x.value for x in SortMetric], default="mean")
    add("--sortUsingSamples", nargs="+", type=int, help="counted from 1")
    add("--averageTypeBins", choices=[x.value for x in Statistic], default="mean")
    add("--missingDataAsZero", action="store_true")
    add("--skipZeros", action="store_true")
    add("--minThreshold", type=float)
    add("--maxThreshold", type=float)
    add("--blackListFileName", "--bl")
    add("--samplesLabel", nargs="+")
    add("--smartLabels", action="store_true", help="accepted; labels are file names without extension anyway")
    add("-q", "--quiet", action="store_true")
    add("--verbose", action="store_true")
    add("--scale", type=float, default=1.0)
    add("-p", "--numberOfProcessors", type=processors, default=1)
    add("--metagene", action="store_true", help="count bases of blocks alone")
    add("--transcriptID", default="transcript")
    add("--exonID", default="exon")
    add("--transcript_id_designator", default="transcript_id")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanloom", description="Interval signals summarised over regions, on Spark.", allow_abbrev=False)
    sub = top.add_subparsers(dest="command", required=True)
    scale = sub.add_parser("scale-regions", help="bodies scaled to one length", allow_abbrev=False)
    _common(scale)
    scale.add_argument("-m", "--regionBodyLength", type=distance, default=1000)
    scale.add_argument("-b", "--upstream", "--beforeRegionStartLength", type=distance, default=0)
    scale.add_argument("-a", "--downstream", "--afterRegionStartLength", type=distance, default=0)
    scale.add_argument("--unscaled5prime", type=distance, default=0)
    scale.add_argument("--unscaled3prime", type=distance, default=0)
    scale.add_argument("--startLabel", default="TSS", help="accepted; no file shows it")
    scale.add_argument("--endLabel", default="TES", help="accepted; no file shows it")
    ref = sub.add_parser("reference-point", help="bins around a point", allow_abbrev=False)
    _common(ref)
    ref.add_argument("--referencePoint", choices=[x.value for x in Anchor], default="TSS")
    ref.add_argument("-b", "--upstream", "--beforeRegionStartLength", type=distance, default=500)
    ref.add_argument("-a", "--downstream", "--afterRegionStartLength", type=distance, default=1500)
    ref.add_argument("--nanAfterEnd", action="store_true")
    for name, text in (("header", "differences of headers"), ("values", "differences of values"), ("diff", "all differences")):
        c = sub.add_parser(name, help=text, allow_abbrev=False)
        c.add_argument("left")
        c.add_argument("right")
        c.add_argument("--tolerance", type=float, default=1e-6)
        c.add_argument("--ignore", nargs="*", default=[], help="header keys")
        c.add_argument("--max-diffs", type=int, default=20)
    return top


def options(a: argparse.Namespace) -> tuple[Files, Layout, General, GtfNames]:
    general = General(
        bin_size=a.binSize,
        statistic=a.averageTypeBins,
        missing_as_zero=a.missingDataAsZero,
        skip_zeros=a.skipZeros,
        min_threshold=a.minThreshold,
        max_threshold=a.maxThreshold,
        scale=a.scale,
        sort_regions=a.sortRegions,
        sort_using=a.sortUsing,
        sort_using_samples=tuple(a.sortUsingSamples) if a.sortUsingSamples else None,
        metagene=a.metagene,
        verbose=a.verbose and not a.quiet,
        processors=a.numberOfProcessors,
    )
    if a.command == "reference-point":
        layout: Layout = ReferencePoint(a.referencePoint, a.upstream, a.downstream, a.nanAfterEnd)
    else:
        layout = ScaleRegions(a.regionBodyLength, a.upstream, a.downstream, a.unscaled5prime, a.unscaled3prime)
    layout.counts(general.bin_size)
    where = Files(a.regionsFileName, a.scoreFileName, a.outFileName, a.outFileNameMatrix, a.outFileSortedRegions, a.blackListFileName, a.samplesLabel)
    return where, layout, general, GtfNames(a.transcriptID, a.exonID, a.transcript_id_designator)


def session(cores: int) -> SparkSession:
    """The active session, or a local one with the cores asked for."""
    active = SparkSession.getActiveSession()
    return active or SparkSession.builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def compare_files(a: argparse.Namespace) -> int:
    from spanloom.compare import full_diff, header_differences
    from spanloom.sources.matrix_file import read_matrix

    spark = session(1)
    left, right = read_matrix(spark, a.left), read_matrix(spark, a.right)
    if a.command == "header":
        found = header_differences(left[0], right[0], set(a.ignore))
        for key, x, y in found[: a.max_diffs]:
            print(f"{key}: {json.dumps(x)} != {json.dumps(y)}")
        return int(bool(found))
    diff = full_diff(left, right, a.tolerance, set(a.ignore), a.max_diffs)
    if a.command == "values":
        diff.header, diff.regions, diff.n_regions, diff.reordered = [], [], 0, False
    print(diff.report())
    return int(not diff.same)


def main(argv: Sequence[str] | None = None) -> int:
    """0, or 1 where matrices differ, or 2 for an error."""
    args = list(sys.argv[1:] if argv is None else argv)
    for a in args:
        if a.split("=")[0] in MISLEADING:
            print(f"{a} is not a flag here; write {MISLEADING[a.split('=')[0]]}", file=sys.stderr)
            return 2
    a = parser().parse_args(args)
    try:
        if a.command in ("header", "values", "diff"):
            return compare_files(a)
        where, layout, general, names = options(a)
        run(session(general.processors), where, layout, general, names)
    except (OptionError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
