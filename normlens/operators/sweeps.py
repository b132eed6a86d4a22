"""Threshold sweeps: evenly spaced thresholds and histogram thresholds, by suffix sums.

Both bin each row once (a map-side combined aggregate of at most as many groups as thresholds) and add up
from the highest bin down, instead of comparing every row with every threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlens.functions.rates import floored_ratio, ratio
from normlens.operators.metrics import with_rates

BINS = 4096


def linear_sweep(rows: DataFrame, steps: int = 500) -> DataFrame:
    """step, threshold, tn, fp, fn, tp and rates at ``steps`` even thresholds from the least to the greatest score.

    A row counts at a threshold if its score is at or above it. No scores, no rows; one distinct score gives
    ``steps`` equal thresholds."""
    usable = rows.where(F.col("score").isNotNull() & F.col("y_true").isNotNull()).select("score", F.col("y_true").cast("int").alias("y"))
    ends = usable.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    grid = ends.where("lo IS NOT NULL").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(steps - 1))
    at = F.when(F.col("step") == steps - 1, F.col("hi")).otherwise(F.col("lo") + F.col("step") * width)
    grid = grid.select("step", at.alias("threshold"))
    # The highest threshold at or below a score: the even position, put right by one where rounding misleads.
    guess = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("score") - F.col("lo")) / width)).otherwise(F.lit(steps - 1))
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(steps - 1))
    placed = usable.crossJoin(F.broadcast(ends)).withColumn("guess", guess)
    value = lambda k: F.when(k == steps - 1, F.col("hi")).otherwise(F.col("lo") + k * width)
    g = F.col("guess")
    step = F.when((g < steps - 1) & (value(g + 1) <= F.col("score")), g + 1).when(value(g) > F.col("score"), g - 1).otherwise(g)
    bins = placed.groupBy(step.cast("int").alias("bin")).agg(F.sum("y").alias("pos"), (F.count(F.lit(1)) - F.sum("y")).alias("neg"))
    every = Window.partitionBy(F.lit(0))
    up = every.orderBy(F.desc("step"))
    joined = grid.join(bins, grid["step"] == bins["bin"], "left").select("step", "threshold", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pos", "neg")])
    summed = joined.select(
        "step",
        "threshold",
        F.sum("pos").over(up).alias("tp"),
        F.sum("neg").over(up).alias("fp"),
        F.sum("pos").over(every).alias("n_pos"),
        F.sum("neg").over(every).alias("n_neg"),
    )
    return with_rates(summed.select("step", "threshold", (F.col("n_neg") - F.col("fp")).alias("tn"), "fp", (F.col("n_pos") - F.col("tp")).alias("fn"), "tp"))


def sweep_choices(sweep: DataFrame, target: float = 0.95) -> DataFrame:
    """Two rows: the best F1, and the best precision at a recall of ``target`` or more; the lowest threshold on ties."""
    best = sweep.orderBy(F.desc(F.round("f1", 12)), "threshold").limit(1).withColumn("choice", F.lit("best_f1"))
    high = sweep.where(F.col("recall") >= target).orderBy(F.desc(F.round("precision", 12)), "threshold").limit(1)
    return best.unionByName(high.withColumn("choice", F.lit("high_recall")))


def histogram_sweep(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """bin, threshold (its left edge), tp, fp, precision, recall, f1, iou, dice for equal bins of the score range.

    The last bin is closed. Denominators are at least 1. Bins without rows are left out, as their counts are those of
    the next bin above. One distinct score falls into one bin."""
    usable = rows.where(F.col("score").isNotNull() & F.col("y_true").isNotNull()).select("score", F.col("y_true").cast("int").alias("y"))
    ends = F.broadcast(usable.agg(F.min("score").alias("lo"), F.max("score").alias("hi")))
    span = F.col("hi") - F.col("lo")
    place = F.when(span > 0, F.least(F.floor((F.col("score") - F.col("lo")) / span * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = usable.crossJoin(ends).groupBy(place.cast("int").alias("bin"), "lo", "hi").agg(F.sum("y").alias("pos"), (F.count(F.lit(1)) - F.sum("y")).alias("neg"))
    return swept(counts, bins)


def swept(counts: DataFrame, bins: int) -> DataFrame:
    """The sweep of a histogram: bin, pos, neg, and the range lo, hi, of at most ``bins`` rows."""
    every = Window.partitionBy(F.lit(0))
    up = every.orderBy(F.desc("bin"))
    summed = counts.select(
        "bin",
        (F.col("lo") + (F.col("hi") - F.col("lo")) / F.lit(float(bins)) * F.col("bin")).alias("threshold"),
        F.sum("pos").over(up).alias("tp"),
        F.sum("neg").over(up).alias("fp"),
        F.sum("pos").over(every).alias("n_pos"),
    )
    tp, fp, n = F.col("tp"), F.col("fp"), F.col("n_pos")
    return summed.select(
        "bin",
        "threshold",
        "tp",
        "fp",
        floored_ratio(tp, tp + fp).alias("precision"),
        floored_ratio(tp, n).alias("recall"),
        floored_ratio(2 * tp, tp + fp + n).alias("dice"),
        floored_ratio(tp, fp + n).alias("iou"),
    )


def best_bin(sweep: DataFrame) -> DataFrame:
    """The row of the best Dice, the lowest threshold on ties."""
    return sweep.orderBy(F.desc(F.round("dice", 12)), "threshold").limit(1)


def best_overlap(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """Exact counts, IoU and Dice of ``score >= threshold`` at the histogram's best Dice (lowest threshold on ties)."""
    best = best_bin(histogram_sweep(rows, bins)).select("threshold")
    hit, bad = F.col("score") >= F.col("threshold"), F.col("y_true").cast("int") == 1
    total = lambda c: F.sum(F.when(c, 1).otherwise(0))
    usable = rows.where(F.col("score").isNotNull() & F.col("y_true").isNotNull()).crossJoin(F.broadcast(best))
    counts = usable.groupBy("threshold").agg(total(hit & bad).alias("tp"), total(hit & ~bad).alias("fp"), total(~hit & bad).alias("fn"), total(~hit & ~bad).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "iou": ratio(tp, tp + fp + fn), "dice": ratio(2 * tp, 2 * tp + fp + fn)})
