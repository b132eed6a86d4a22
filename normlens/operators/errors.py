"""Grouped error analysis over scored images: type, score, y_true, y_pred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.functions.rates import ratio
from normlens.operators.scoring import error_type


def with_errors(rows: DataFrame, threshold: float) -> DataFrame:
    out = rows.withColumn("y_pred", (F.col("score") >= threshold).cast("int"))
    return out.withColumn("error_type", error_type(F.col("y_true"), F.col("y_pred")))


def recall_by_type(rows: DataFrame, by: str) -> DataFrame:
    """total, tp, fn, recall, miss_rate of the defects of each type."""
    hit = F.sum(F.when(F.col("y_pred") == 1, 1).otherwise(0))
    out = rows.where("y_true = 1").groupBy(by).agg(F.count(F.lit(1)).alias("total"), hit.alias("tp"))
    out = out.withColumn("fn", F.col("total") - F.col("tp"))
    return out.withColumns({"recall": ratio(F.col("tp"), F.col("total")), "miss_rate": ratio(F.col("fn"), F.col("total"))})


def misses_by_type(rows: DataFrame, by: str) -> DataFrame:
    return rows.where("error_type = 'FN'").groupBy(by).agg(F.count(F.lit(1)).alias("n_missed"))


def worst(rows: DataFrame, kind: str, k: int, key: str) -> DataFrame:
    """The k worst errors: false positives from the highest score, false negatives from the lowest."""
    order = F.desc("score") if kind == "FP" else F.asc("score")
    return rows.where(F.col("error_type") == kind).orderBy(order, key).limit(k)


def recovered(scores: DataFrame, lost: DataFrame, on: list[str]) -> DataFrame:
    """Scores of the cases that an earlier version lost altogether."""
    return scores.join(lost.where("fully_lost").select(*on).distinct(), on, "left_semi")


def overall_and_by_type(rows: DataFrame, by: str) -> DataFrame:
    """``recall_by_type`` with a first row '(all)'."""
    every = recall_by_type(rows.withColumn(by, F.lit("(all)")), by)
    return every.unionByName(recall_by_type(rows.withColumn(by, F.col(by).cast("string")), by))
