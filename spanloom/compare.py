"""Comparison of two matrices: headers, regions as multisets, values within a tolerance."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "<missing>"


def header_differences(left: dict[str, Any], right: dict[str, Any], ignore: set[str] = frozenset()) -> list[tuple[str, Any, Any]]:
    """(key, left, right) of the keys that differ, in order of key."""
    keys = sorted((left.keys() | right.keys()) - set(ignore))
    pairs = [(k, left.get(k, MISSING), right.get(k, MISSING)) for k in keys]
    return [p for p in pairs if p[1] != p[2] or isinstance(p[1], bool) != isinstance(p[2], bool)]


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_left, n_right: the rows that one side has more often; counted on either side before they meet."""
    both = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return both.groupBy(*keys).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right")).filter("n_left <> n_right")


def differs(left: Column, right: Column, tolerance: float) -> Column:
    """Two missing values, or equal infinite ones, are the same."""
    a, b = F.isnull(left) | F.isnan(left), F.isnull(right) | F.isnan(right)
    near = (left == right) | (F.abs(left - right) <= tolerance)
    return F.when(a & b, False).when(a | b, True).otherwise(~near)


def value_differences(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """keys, left, right: the cells (keys, value) that differ, or that one side lacks."""
    a = left.select(*keys, F.col("value").alias("left"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col("value").alias("right"), F.lit(True).alias("_r"))
    joined = a.join(b, keys, "full")
    return joined.filter(F.col("_l").isNull() | F.col("_r").isNull() | differs(F.col("left"), F.col("right"), tolerance)).drop("_l", "_r")


@dataclass
class FullDiff:
    """What a comparison of two files found; at most `limit` examples of each kind."""

    header: list[tuple[str, Any, Any]]
    regions: list[tuple[str, int, int]] = field(default_factory=list)
    n_regions: int = 0
    reordered: bool = False
    rows: tuple[int, int] = (0, 0)
    extra_columns: int = 0
    values: list[tuple[int, int, float | None, float | None]] = field(default_factory=list)
    n_values: int = 0

    @property
    def same(self) -> bool:
        return not (self.header or self.n_regions or self.reordered or self.n_values or self.extra_columns or self.rows[0] != self.rows[1])

    def report(self) -> str:
        out = [f"header {k}: {a!r} != {b!r}" for k, a, b in self.header]
        if self.rows[0] != self.rows[1]:
            out.append(f"rows: {self.rows[0]} != {self.rows[1]}")
        out += [f"region {k}: {a} times, {b} times" for k, a, b in self.regions]
        if self.n_regions > len(self.regions):
            out.append(f"... {self.n_regions} regions differ")
        if self.reordered:
            out.append("the same regions in another order")
        if self.extra_columns:
            out.append(f"{self.extra_columns} values have no counterpart in their row")
        out += [f"row {i} value {k}: {a} != {b}" for i, k, a, b in self.values]
        if self.n_values > len(self.values):
            out.append(f"... {self.n_values} values differ")
        return "\n".join(out or ["identical"])


BED6 = ["chrom", "start", "end", "name", "score", "strand"]


def full_diff(left: tuple[dict, DataFrame], right: tuple[dict, DataFrame], tolerance: float = 1e-6, ignore: set[str] = frozenset(), limit: int = 20) -> FullDiff:
    """Matrices as sources.matrix_file.read_matrix gives them: a header, and rows (row_no, BED6, values)."""
    (h1, a), (h2, b) = left, right
    out = FullDiff(header_differences(h1, h2, ignore), rows=(a.count(), b.count()))
    regions = multiset_difference(a, b, BED6)
    out.n_regions = regions.count()
    out.regions = [("\t".join(map(str, r[:6])), r.n_left, r.n_right) for r in regions.orderBy(*BED6).limit(limit).collect()]
    pairs = a.select("row_no", *[F.col(c).alias(f"l_{c}") for c in [*BED6, "values"]]).join(b.select("row_no", *[F.col(c).alias(f"r_{c}") for c in [*BED6, "values"]]), "row_no")
    if not out.n_regions:
        moved = F.lit(False)
        for c in BED6:
            moved = moved | (F.col(f"l_{c}") != F.col(f"r_{c}"))
        out.reordered = not pairs.filter(moved).isEmpty()
    out.extra_columns = int(pairs.agg(F.sum(F.abs(F.size("l_values") - F.size("r_values")))).first()[0] or 0)
    n = F.least(F.size("l_values"), F.size("r_values"))
    cells = pairs.select("row_no", F.posexplode(F.arrays_zip(F.slice("l_values", F.lit(1), n).alias("l"), F.slice("r_values", F.lit(1), n).alias("r"))).alias("k", "v"))
    wrong = cells.filter(differs(F.col("v.l"), F.col("v.r"), tolerance))
    out.n_values = wrong.count()
    out.values = [(r.row_no, r.k, r.v.l, r.v.r) for r in wrong.orderBy("row_no", "k").limit(limit).collect()]
    return out
