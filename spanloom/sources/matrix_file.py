"""Written matrices, plain or compressed: a header line `@{...}`, then regions and values."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.bed import read_lines

#: Spellings of values that are no plain numbers.
SPECIAL = {"nan": "NaN", "na": "NaN", "inf": "Infinity", "+inf": "Infinity", "infinity": "Infinity", "-inf": "-Infinity", "-infinity": "-Infinity"}


class MatrixFileError(ValueError):
    """A file that is no matrix."""


def number(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SPECIAL.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(text))), text).try_cast("double")


def read_matrix(spark: SparkSession, path: str) -> tuple[dict[str, Any], DataFrame]:
    """(header, rows (row_no from 0, chrom, start, end, name, score, strand, values)); BED fields stay texts.

    Rows are numbered by the order of lines; a file is read by one task if it is compressed.
    """
    from spanloom.operators.numbering import numbered

    lines = read_lines(spark, path)
    first = lines.filter(F.startswith("line", F.lit("@"))).agg(F.min_by("line", "line_no").alias("line")).first().line
    if first is None:
        raise MatrixFileError(f"{path} has no header")
    header = json.loads(first[1:])
    body = lines.filter(~F.startswith("line", F.lit("@")) & (F.trim("line") != "")).withColumn("f", F.split("line", "\t"))
    fields = {c: F.get("f", F.lit(k)) for k, c in enumerate(("chrom", "start", "end", "name", "score", "strand"))}
    values = F.transform(F.slice("f", F.lit(7), F.greatest(F.size("f") - 6, F.lit(0))), number)
    return header, numbered(body.select("line_no", *[c.alias(n) for n, c in fields.items()], values.alias("values")), [F.col("line_no")], "row_no").drop("line_no")
