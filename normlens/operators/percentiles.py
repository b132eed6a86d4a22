"""Exact percentiles of groups of any size, in two levels.

Rows are added up by distinct value, once, and the distinct values are dealt by range over partitions of equal depth (their
edges come from Spark's own sample of the values, so neither outliers nor heavy tails fill one). The partitions' totals say
which of them hold the wanted ranks; only their values are sorted. So no task holds all values of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlens.scratch import process_scratch


def ranged(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``counts``, kept as a table, with ``bin``: the number of its part of the order of ``keys`` and ``value``; NaN is last."""
    dealt = counts.repartitionByRange(*keys, value).withColumn("bin", F.spark_partition_id())
    return process_scratch(counts.sparkSession).table(dealt, "ranged")


def tally(rows: DataFrame, by: list[str], value: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The ``by`` columns, ``value``, ``extra``, times (rows that have them) and bin; the only read of ``rows``."""
    return ranged(rows.groupBy(*by, value, *extra).agg(F.count(F.lit(1)).alias("times")), by, value)


def _same(by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by], F.lit(True))


def percentiles(counts: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Of a ``tally``: the ``by`` columns, and for each name of ``shares`` that percentile (linear between neighbours) of the non-null values."""
    counts = counts.where(F.col(value).isNotNull())
    order = Window.partitionBy(*by or [F.lit(0)]).orderBy("bin")
    tops = counts.groupBy(*by, "bin").agg(F.sum("times").alias("held"))
    tops = tops.withColumn("before", F.coalesce(F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tops = tops.withColumn("total", F.sum("held").over(Window.partitionBy(*by or [F.lit(0)])))
    place = {name: F.lit(float(p)) * (F.col("total") - 1) for name, p in shares.items()}
    holds = [(F.col("before") <= end(at)) & (end(at) < F.col("before") + F.col("held")) for at in place.values() for end in (F.floor, F.ceil)]
    wanted = tops.where(reduce(lambda a, b: a | b, holds)).select(*[F.col(k).alias(f"_{k}") for k in by], F.col("bin").alias("_bin"), "before", "total")
    found = counts.join(wanted if by else F.broadcast(wanted), _same(by) & (F.col("bin") == F.col("_bin")))
    up_to = Window.partitionBy(*by, "bin").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("after", F.col("before") + F.sum("times").over(up_to)).withColumn("first", F.col("after") - F.col("times"))
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank < F.col("after")), F.col(value)))
    ends = [x for name, p in place.items() for x in (at(F.floor(p)).alias(f"{name}_low"), at(F.ceil(p)).alias(f"{name}_high"))]
    out = found.groupBy(*by).agg(F.max("total").alias("total"), *ends)
    low, high = (lambda n: F.col(f"{n}_low")), (lambda n: F.col(f"{n}_high"))
    return out.select(*by, *[(low(n) + (high(n) - low(n)) * (p - F.floor(p))).cast("double").alias(n) for n, p in place.items()])


def weighted(value: str) -> dict[str, Column]:
    """Aggregates over a tally of the rows' non-null values: n, mean, min, max."""
    x = F.col(value)
    n = F.coalesce(F.sum(F.when(x.isNotNull(), F.col("times"))), F.lit(0))
    return {"n": n, "mean": F.sum(x.cast("double") * F.col("times")) / F.nullif(n, F.lit(0)), "min": F.min(x), "max": F.max(x)}


def with_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], sums: dict[str, Column], extra: tuple[str, ...] = ()) -> DataFrame:
    """The aggregates ``sums`` of each group of a tally (of ``value`` and ``extra``), and the percentiles beside them (null without values)."""
    counts = tally(rows, by, value, extra)
    found = percentiles(counts, by, value, shares).select(*[F.col(k).alias(f"_{k}") for k in by], *shares)
    summed = counts.groupBy(*by).agg(*[c.alias(name) for name, c in sums.items()])
    return summed.join(found if by else F.broadcast(found), _same(by), "left").drop(*[f"_{k}" for k in by])
