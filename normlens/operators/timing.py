"""Measured stages: each is run to its end as a table, with its rows observed on the way, after runs that only warm up."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from normlens.scratch import Scratch

LOG_SCHEMA = "variant string, stage string, run int, ms double, n_rows long"
#: Stages of a variant in turn: a name, and what makes its rows from the tables of the stages before.
Stages = list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]]


def measure(spark: SparkSession, variants: dict[str, Stages], scratch: Scratch, runs: int = 3, warm_up: int = 1) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The log (variant, stage, run, ms, n_rows) with a stage 'total' for each run, and the last table of each variant.

    Variants take turns, so that what the machine does besides falls on all of them alike. The first ``warm_up`` runs are not
    logged. The tables of a run go at its end, but the last ones stay in ``scratch``."""
    log: list[tuple[str, str, int, float, int]] = []
    results: dict[str, DataFrame] = {}
    for run in range(warm_up + runs):
        for variant, stages in variants.items():
            with Scratch(spark) as own:
                made: dict[str, DataFrame] = {}
                lines = []
                for stage, make in stages:
                    keep = scratch if run == warm_up + runs - 1 and stage == stages[-1][0] else own
                    seen, began = Observation(), time.perf_counter()
                    made[stage] = keep.table(make(made).observe(seen, F.count(F.lit(1)).alias("n_rows")), stage)
                    lines.append((variant, stage, run - warm_up, (time.perf_counter() - began) * 1000, seen.get["n_rows"]))
                if run >= warm_up:
                    log += [*lines, (variant, "total", run - warm_up, sum(x[3] for x in lines), lines[-1][4])]
                results[variant] = made[stages[-1][0]]
    return spark.createDataFrame(log, LOG_SCHEMA), results


def agreement(results: dict[str, DataFrame], key: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """variant, n_rows, agreement: the share of keys whose value is that of the first variant; keys of one side only disagree."""
    first, *_ = results
    out = None
    for variant, rows in results.items():
        a = results[first].select(F.col(key).alias("a_key"), F.col(value).alias("a"))
        b = rows.select(F.col(key).alias("b_key"), F.col(value).alias("b"))
        both = a.join(b, F.col("a_key") == F.col("b_key"), "full")
        equal = F.coalesce((F.abs(F.col("a") - F.col("b")) <= tolerance).cast("double"), F.lit(0.0))
        line = both.agg(F.lit(variant).alias("variant"), F.count("b_key").alias("n_rows"), F.avg(equal).alias("agreement"))
        out = line if out is None else out.unionByName(line)
    return out
