"""Texts of values as the written files have them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def special(value: float | None) -> str | None:
    if value is None or math.isnan(value):
        return "nan"
    if math.isinf(value):
        return "inf" if value > 0 else "-inf"
    return None


def matrix_value(value: float | None) -> str:
    """Six decimals, the half to even of the binary product; zero has no sign."""
    text = special(value)
    if text is not None:
        return text
    scaled = float(np.rint(value * 1e6))
    if not math.isfinite(scaled) or abs(scaled) >= 2**63:
        return f"{value:.6f}"
    n = int(scaled)
    whole, part = divmod(abs(n), 1_000_000)
    return f"{'-' if n < 0 else ''}{whole}.{part:06d}"


def plain_value(value: float | None) -> str:
    """Four significant digits, as C's %.4g."""
    return special(value) or f"{value:.4g}"


def score_value(value: float) -> str:
    """The shortest text that reads back as the value, with a decimal point."""
    text = special(value)
    if text is not None:
        return text
    text = np.format_float_positional(value, unique=True, trim="0")
    return text if "." in text else text + ".0"


def _joined(values: Iterator[pd.Series], one) -> Iterator[pd.Series]:
    for rows in values:
        yield rows.map(lambda row: "\t".join(one(None if v is None else float(v)) for v in row))


@pandas_udf(StringType())
def matrix_values(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """An array of values as one text, tab by tab."""
    yield from _joined(values, matrix_value)


@pandas_udf(StringType())
def plain_values(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _joined(values, plain_value)


@pandas_udf(StringType())
def matrix_value_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: matrix_value(None if v is None else float(v)))


@pandas_udf(StringType())
def plain_value_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: plain_value(None if v is None else float(v)))


@pandas_udf(StringType())
def score_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None or math.isnan(v) else score_value(float(v)))
