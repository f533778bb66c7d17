"""Files of a matrix: gzip with a header, a plain table of values, the ordered regions.

Rows are formatted on the executors and streamed through the driver in order, one partition at a
time, so that one file results; the driver holds no more than a partition. A file that can't be finished is removed.
"""

from __future__ import annotations

import gzip
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from typing import IO, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.formatting import matrix_values, plain_values, score_text
from spanloom.operators.ordering import sample_boundaries
from spanloom.options import General, Layout, ReferencePoint

#: Fixed: the names of the columns of an ordered-regions file, as readers of such files know them.
REGION_COLUMNS = ("chrom", "start", "end", "name", "score", "strand", "thickStart", "thickEnd", "itemRGB", "blockCount", "blockSizes", "blockStart", "deepTools_group")


def header(layout: Layout, general: General, groups: list[tuple[str, int]], samples: list[str]) -> dict[str, Any]:
    """The header of a matrix; the order of its keys is part of the format."""
    n, reference = len(samples), isinstance(layout, ReferencePoint)
    each = lambda value: [value] * n
    bounds = [0]
    for _, count in groups:
        bounds.append(bounds[-1] + count)
    return {
        "upstream": each(layout.upstream),
        "downstream": each(layout.downstream),
        "body": each(0 if reference else layout.body),
        "bin size": each(general.bin_size),
        "ref point": each(layout.anchor.value if reference else None),
        "verbose": general.verbose,
        "bin avg type": general.statistic.value,
        "missing data as zero": general.missing_as_zero,
        "min threshold": general.min_threshold,
        "max threshold": general.max_threshold,
        "scale": float(general.scale),
        "skip zeros": general.skip_zeros,
        "nan after end": layout.nan_after_end,
        "proc number": general.processors,
        "sort regions": general.sort_regions.value,
        "sort using": general.sort_using.value,
        "unscaled 5 prime": each(0 if reference else layout.unscaled_5),
        "unscaled 3 prime": each(0 if reference else layout.unscaled_3),
        "group_labels": [label for label, _ in groups],
        "group_boundaries": bounds,
        "sample_labels": list(samples),
        "sample_boundaries": sample_boundaries(n, layout.n_bins(general.bin_size)),
    }


def counts(head: dict[str, Any]) -> list[int]:
    bounds = head["group_boundaries"]
    return [b - a for a, b in zip(bounds, bounds[1:], strict=False)]


def _score() -> Column:
    own = F.when(F.col("bed_field_count") == 5, ".").when(F.col("score_raw").isNotNull(), "0.0")
    return own.when(F.col("score").isNotNull(), score_text(F.col("score").cast("double"))).otherwise(".")


def _strand() -> Column:
    return F.when(F.col("strand_raw").isNotNull(), ".").otherwise(F.col("strand"))


def _ends(metagene: bool) -> tuple[Column, Column]:
    """Start and end; in a spliced layout those of all blocks, comma by comma."""
    start, end = F.col("start").cast("string"), F.col("end").cast("string")
    if not metagene:
        return start, end
    listed = lambda side: F.array_join(F.transform("exons", lambda x: x[side].cast("string")), ",")
    return F.when(F.size("exons") > 0, listed("start")).otherwise(start), F.when(F.size("exons") > 0, listed("end")).otherwise(end)


def matrix_lines(rows: DataFrame, metagene: bool) -> Column:
    start, end = _ends(metagene)
    return F.concat_ws("\t", "chrom", start, end, F.coalesce("name", F.lit(".")), _score(), _strand(), matrix_values("values"))


def region_lines(rows: DataFrame, metagene: bool) -> Column:
    has = (F.size("exons") > 0) & F.lit(metagene)
    listed = lambda f: F.array_join(F.transform("exons", f), ",")
    sizes = F.when(has, listed(lambda x: (x["end"] - x["start"]).cast("string"))).otherwise((F.col("end") - F.col("start")).cast("string"))
    starts = F.when(has, listed(lambda x: (x["start"] - F.col("start")).cast("string"))).otherwise("0")
    count = F.when(has, F.size("exons")).otherwise(1).cast("string")
    start, end = F.col("start").cast("string"), F.col("end").cast("string")
    return F.concat_ws("\t", "chrom", start, end, F.coalesce("name", F.lit(".")), _score(), _strand(), start, end, F.lit("0"), count, sizes, starts, "group_label")


def table_header(head: dict[str, Any]) -> list[str]:
    """The three lines above a table of values."""
    labelled = [f"{label}:{n}" for label, n in zip(head["group_labels"], counts(head), strict=True)]
    first = lambda key: head[key][0] if head[key] else 0
    layout = f"#downstream:{first('downstream')}\tupstream:{first('upstream')}\tbody:{first('body')}\tbin size:{first('bin size')}\tunscaled 5 prime:{first('unscaled 5 prime')}\tunscaled 3 prime:{first('unscaled 3 prime')}"
    bounds = head["sample_boundaries"]
    samples = [label for label, a, b in zip(head["sample_labels"], bounds, bounds[1:], strict=False) for _ in range(b - a)]
    return ["#" + "\t".join(labelled), layout, "\t".join([*labelled, *samples])]


@contextmanager
def finished(path: str, compressed: bool | None) -> Iterator[IO]:
    """A file under its name only once it is whole; of bytes if `compressed` is None."""
    part = f"{path}.part"
    try:
        if compressed is None:
            opened = open(part, "wb")
        else:
            opened = gzip.open(part, "wt", encoding="utf-8", newline="\n") if compressed else open(part, "w", encoding="utf-8", newline="\n")
        with opened as f:
            yield f
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def _write(path: str, head: list[str], lines: DataFrame, compressed: bool) -> None:
    with finished(path, compressed) as f:
        for line in head:
            f.write(line + "\n")
        for row in lines.toLocalIterator(prefetchPartitions=True):
            f.write(row[0] + "\n")


def write_matrix(path: str, head: dict[str, Any], rows: DataFrame, metagene: bool) -> None:
    text = "@" + json.dumps(head, separators=(",", ":"), ensure_ascii=False)
    _write(path, [text], rows.select(matrix_lines(rows, metagene)), True)


def write_values(path: str, head: dict[str, Any], rows: DataFrame) -> None:
    _write(path, table_header(head), rows.select(plain_values("values")), False)


def write_regions(path: str, rows: DataFrame, metagene: bool) -> None:
    """rows need group_label."""
    _write(path, ["#" + "\t".join(REGION_COLUMNS)], rows.select(region_lines(rows, metagene)), False)
