"""Queries held against their SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def connect(sf_dir: str = SMALL) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return c


def plain(rows) -> list[tuple]:
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def assert_same(query, sql: str, spark, sf_dir: str = SMALL) -> None:
    df, rel = query(spark, sf_dir), connect(sf_dir).sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    ours = plain(df.select(*[F.col(f"`{c}`") for c in columns]).collect())
    theirs = plain(rel.select(*[f'"{c}"' for c in columns]).fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
