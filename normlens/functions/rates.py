"""Rates with the zero rules of the metrics: 0.0 wherever a denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def floored_ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1), the histogram sweep's rule."""
    return a.cast("double") / F.greatest(b, F.lit(1))


def f1(precision: Column, recall: Column, floor: float = 1e-12) -> Column:
    return 2 * precision * recall / F.greatest(precision + recall, F.lit(floor))
