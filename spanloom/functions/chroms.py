"""Names of chromosomes that differ in spelling only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_chrom(chrom: Column) -> Column:
    """The name without a leading `chr`; the mitochondrion is MT."""
    bare = F.when(F.startswith(chrom, F.lit("chr")), F.substring(chrom, 4, 2**31 - 1)).otherwise(chrom)
    return F.when(bare == "M", "MT").otherwise(bare)


def normal_chrom_name(chrom: str) -> str:
    bare = chrom.removeprefix("chr")
    return "MT" if bare == "M" else bare
