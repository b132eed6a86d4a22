"""Latency statistics over logs: one row for each stage and request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.operators.percentiles import weighted, with_percentiles


def summarize(log: DataFrame, by: list[str], value: str = "ms") -> DataFrame:
    """n, mean, median, p95 (linear interpolation), min, max."""
    rows = log.where(F.col(value).isNotNull())
    return with_percentiles(rows, by, value, {"median": 0.5, "p95": 0.95}, weighted(value)).select(*by, "n", "mean", "median", "p95", "min", "max")


def throughput(log: DataFrame, by: list[str], value: str = "ms") -> DataFrame:
    """Requests a second from the mean time of one, 0.0 if that is 0."""
    mean = F.avg(value)
    return log.where(F.col(value).isNotNull()).groupBy(*by).agg(F.when(mean > 0, 1000 / mean).otherwise(F.lit(0.0)).alias("per_second"))


def unpivot_stages(log: DataFrame, keys: list[str], stages: list[str]) -> DataFrame:
    """Wide timings, one column for each stage, as rows (keys, stage, ms)."""
    return log.unpivot(keys, stages, "stage", "ms")


def skip_warm_up(log: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The log without its first ``n`` requests, by ``order`` (a bounded list of their keys is collected)."""
    first = [r[0] for r in log.select(order).distinct().orderBy(order).limit(n).collect()]
    return log.where(~F.col(order).isin(first)) if first else log
