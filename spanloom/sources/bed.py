"""BED lines, and files of several groups of them.

Lines are split at tabs if they have one, else at white space; one empty last field is dropped.
Fields 1 to 3 are needed; a negative start counts as 0. With 3 to 5 fields the name is made from the
coordinates. A field that is no score or no strand is kept as it is in score_raw or strand_raw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.names import coordinate_name

#: u32 coordinates.
MOST = 2**32 - 1
STRANDS = {"+": "+", "-": "-", ".": ".", "?": ".", "*": "."}
EXON = "array<struct<start:bigint,end:bigint>>"


class RegionFileError(ValueError):
    """A region file that can't be read, with the line at fault."""


def _numbers(field: Column) -> Column:
    """The whole numbers of a comma-separated list, null for a part that is none."""
    return F.transform(F.filter(F.split(field, ","), lambda x: x != ""), lambda x: F.trim(x).try_cast("bigint"))


def block_exons(start: Column, extra: Column) -> Column:
    """Blocks of fields 10 to 12 as sorted (start, end); null where they don't add up, empty for none."""
    count = F.get(extra, F.lit(3)).try_cast("bigint")
    sizes, starts = _numbers(F.get(extra, F.lit(4))), _numbers(F.get(extra, F.lit(5)))
    sound = (F.size(sizes) == count) & (F.size(starts) == count) & F.forall(sizes, lambda x: x > 0) & F.forall(starts, lambda x: x >= 0)
    made = F.zip_with(starts, sizes, lambda a, b: F.struct((start + a).alias("start"), (start + a + b).alias("end")))
    return F.when((F.size(extra) >= 6) & F.coalesce(sound, F.lit(False)), F.array_sort(made)).cast(EXON)


def parse_bed(lines: DataFrame) -> DataFrame:
    """lines (line, others): the others and the fields of a region; `error` says why a line can't be read."""
    fields = F.when(F.contains("line", F.lit("\t")), F.split(F.regexp_replace("line", "\t$", ""), "\t")).otherwise(F.split(F.btrim("line"), r"\s+"))
    field = lambda k: F.get("_c", F.lit(k))
    n = F.size("_c")
    start, end = field(1).try_cast("bigint"), field(2).try_cast("bigint")
    clamped = F.greatest(start, F.lit(0).cast("bigint"))
    error = (
        F.when(n < 3, "expected at least three columns")
        .when(start.isNull(), "start column must be an integer")
        .when(end.isNull() | (end < 0) | (end > MOST) | (clamped > MOST), "end column must be an unsigned integer")
        .when(end < clamped, "end must not be smaller than start")
    )
    score = F.when((n >= 5) & ~field(4).isin("", "."), field(4))
    known = F.create_map(*[F.lit(x) for pair in STRANDS.items() for x in pair])
    strand = F.when(n >= 6, field(5))
    raw = strand.isNotNull() & ~strand.isin(*STRANDS)
    return (
        lines.withColumn("_c", fields)
        .withColumns(
            {
                "error": error,
                "chrom": field(0),
                "start": clamped,
                "end": end,
                "bed_field_count": n,
                "name": F.when(n < 6, coordinate_name(field(0), clamped, end)).otherwise(F.nullif(field(3), F.lit(""))),
                "score": score.try_cast("float"),
                "score_raw": F.when(score.try_cast("float").isNull(), score),
                "strand": F.when(strand.isNull() | raw, ".").otherwise(F.try_element_at(known, F.coalesce(strand, F.lit(".")))),
                "strand_raw": F.when(raw, strand),
                "extra_fields": F.when(n > 6, F.slice("_c", F.lit(7), n)).otherwise(F.array().cast("array<string>")),
            }
        )
        .withColumn("exons", block_exons(F.col("start"), F.col("extra_fields")))
        .drop("_c", "line")
    )


def assign_groups(lines: DataFrame, default: str) -> tuple[DataFrame, list[tuple[int, str]]]:
    """lines (line_no, line): (records with segment and label, headers (line_no, label)).

    A line `#label` ends the run of records before it and names it; what follows the last one gets
    the default, as does an empty label. The headers are the groups of the matrix, so the driver may know them.
    """
    marked = lines.filter(F.trim("line") != "")
    is_header = F.startswith("line", F.lit("#"))
    headers = sorted((r.line_no, r.label) for r in marked.filter(is_header).select("line_no", F.trim(F.expr("substring(line, 2)")).alias("label")).collect())
    records = marked.filter(~is_header)
    if not headers:
        return records.withColumns({"segment": F.lit(0), "label": F.lit(default)}), headers
    at = F.lit([h[0] for h in headers])
    names = F.lit([h[1] or default for h in headers] + [default])
    # The number of headers before a line, by halving steps.
    steps = F.lit([1 << k for k in range(len(headers).bit_length() - 1, -1, -1)])
    further = lambda n, step: (n + step <= len(headers)) & (F.get(at, n + step - 1) < F.col("line_no"))
    segment = F.aggregate(steps, F.lit(0), lambda n, step: F.when(further(n, step), n + step).otherwise(n))
    return records.withColumn("segment", segment).withColumn("label", F.get(names, F.col("segment"))), headers


def first_error(parsed: DataFrame, path: str) -> None:
    """Raise the first line that can't be read, with its number."""
    bad = parsed.filter("error IS NOT NULL").agg(F.min(F.struct("line_no", "error", "raw")).alias("e")).first().e
    if bad is not None:
        # Numbers rise but aren't dense over the splits of a file.
        number = read_lines(parsed.sparkSession, path).filter(F.col("line_no") <= bad.line_no).count()
        raise RegionFileError(f"{path}: line {number}: {bad.error}: {bad.raw}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of one file, plain or compressed; numbers rise in the order of the lines."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))


def read_bed(spark: SparkSession, path: str, default: str) -> tuple[DataFrame, list[str]]:
    """(regions with group_idx from 0 and line_no, raw labels of the groups that have records)."""
    records, headers = assign_groups(read_lines(spark, path), default)
    parsed = parse_bed(records.withColumn("raw", F.col("line")))
    first_error(parsed, path)
    segments = sorted(r.segment for r in parsed.select("segment").distinct().collect())
    if not segments:
        raise RegionFileError(f"{path}: the file has no regions")
    numbers = F.create_map(*[F.lit(x) for k, s in enumerate(segments) for x in (s, k)])
    labels = [headers[s][1] if s < len(headers) else "" for s in segments]
    return parsed.withColumn("group_idx", numbers[F.col("segment")]).drop("error", "raw", "segment", "label"), labels


