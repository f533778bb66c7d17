"""Names and labels that must not repeat."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import PurePath

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Names:
    """Hands out names; one that is taken gets the first free of `_r1`, `_r2`, ..."""

    def __init__(self) -> None:
        self.taken: set[str] = set()
        self.next: dict[str, int] = {}

    def give(self, name: str) -> str:
        out, k = name, self.next.get(name, 1)
        while out in self.taken:
            out, k = f"{name}_r{k}", k + 1
        self.next[name] = k
        self.taken.add(out)
        return out


def unique_labels(labels: Iterable[tuple[str | None, str]]) -> list[str]:
    """Labels (raw, default) in order: trimmed, the default for an empty one, told apart."""
    names = Names()
    return [names.give((raw or "").strip() or default) for raw, default in labels]


def sample_label(path: str) -> str:
    """The file's name without its last extension."""
    return PurePath(path).stem


def sample_labels(paths: list[str], given: list[str] | None) -> list[str]:
    if given is None:
        return [sample_label(p) for p in paths]
    if len(given) != len(paths):
        raise ValueError(f"{len(given)} sample labels for {len(paths)} score files")
    return list(given)


ROOT = r"(_r[0-9]+)+$"


def with_unique_names(regions: DataFrame, group: str = "group_idx", order: str = "region_id", name: str = "name") -> DataFrame:
    """Within a group a repeated name gets `_r1`, `_r2`, ... in order, skipping names that are taken.

    Names can only meet others with the same root (the name without such endings). Where a root has
    just one spelling, numbering its rows is enough; only the others are probed one by one.
    """
    root = F.regexp_replace(F.coalesce(F.col(name), F.lit("")), ROOT, "")
    keyed = regions.withColumn("_root", root)
    counted = keyed.groupBy(F.col(group).alias("_g"), F.col("_root").alias("_r")).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(name).alias("_spellings"))
    same = F.col(group).eqNullSafe(F.col("_g")) & F.col("_root").eqNullSafe(F.col("_r"))
    marked = keyed.join(counted.filter("_n > 1"), same, "left").drop("_g", "_r", "_n")
    simple = marked.filter(F.coalesce(F.col("_spellings"), F.lit(1)) <= 1)
    k = F.row_number().over(Window.partitionBy(group, name).orderBy(order)) - 1
    numbered = simple.withColumn(name, F.when(F.col("_spellings").isNull() | (k == 0), F.col(name)).otherwise(F.concat(F.col(name), F.lit("_r"), k.cast("string"))))
    out_schema = regions.schema

    def probe(rows: pd.DataFrame) -> pd.DataFrame:
        names, rows = Names(), rows.sort_values(order, kind="stable")
        rows[name] = [None if n is None else names.give(n) for n in rows[name]]
        return rows[[f.name for f in out_schema.fields]]

    probed = marked.filter(F.col("_spellings") > 1).drop("_spellings").groupBy(group, "_root").applyInPandas(probe, out_schema)
    return numbered.drop("_root", "_spellings").select(regions.columns).unionByName(probed)


def coordinate_name(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def natural_label(path: str) -> str:
    return re.split(r"[/\\]", path)[-1]
