"""Ranking metrics over scored rows: curves, areas and threshold choices.

Every operator first adds up rows by distinct score, which is a map-side combined aggregate and the only read of the
rows. Running sums over the distinct scores are taken in two levels, within parts of equal depth of their order and over
the parts' totals, so that no task sees all scores even if every row has its own. Rows with a null score or truth take
no part; NaN counts as the highest score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlens.functions.rates import f1, ratio
from normlens.operators.percentiles import ranged, weighted, with_percentiles


def by_score(rows: DataFrame, score: str = "score", truth: str = "y_true", by: list[str] | None = None) -> DataFrame:
    """The ``by`` columns, and score, pos, neg: rows of each class at each distinct score."""
    usable = rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    pos = F.sum(F.when(F.col(truth).cast("int") == 1, 1).otherwise(0))
    return usable.groupBy(*by or [], F.col(score).alias("score")).agg(pos.alias("pos"), (F.count(F.lit(1)) - pos).alias("neg"))


def cumulative(rows: DataFrame, score: str = "score", truth: str = "y_true", by: list[str] | None = None) -> DataFrame:
    """The ``by`` columns, and score, pos, neg (rows at the score), tp, fp (rows at or above it), n_pos, n_neg, for each distinct score."""
    by = by or []
    marked = ranged(by_score(rows, score, truth, by), by, "score")
    every = Window.partitionBy(*by or [F.lit(0)])
    higher = every.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    tops = marked.groupBy(*by, "bin").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    tops = tops.select(
        *[F.col(k).alias(f"_{k}") for k in by],
        F.col("bin").alias("of_bin"),
        F.coalesce(F.sum("p").over(higher), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("neg_above"),
        F.sum("p").over(every).alias("n_pos"),
        F.sum("n").over(every).alias("n_neg"),
    )
    down = Window.partitionBy(*by, "bin").orderBy(F.desc("score"))
    match = F.col("bin") == F.col("of_bin")
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return marked.join(tops if by else F.broadcast(tops), match).select(
        *by,
        "score",
        "pos",
        "neg",
        (F.sum("pos").over(down) + F.col("pos_above")).alias("tp"),
        (F.sum("neg").over(down) + F.col("neg_above")).alias("fp"),
        "n_pos",
        "n_neg",
    )


def auroc(rows: DataFrame, by: list[str] | None = None, score: str = "score", truth: str = "y_true") -> DataFrame:
    """Probability that a positive scores above a negative, ties counting half; null with one class only.

    With ``by``, one row for each group (null groups included)."""
    keys = by or []
    area = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("won") / (F.col("n_pos") * F.col("n_neg")).cast("double"))
    won = F.col("pos") * (F.col("n_neg") - F.col("fp") + F.col("neg") / 2)
    sums = cumulative(rows, score, truth, keys).groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("pos", "n_pos"), ("neg", "n_neg"), (won, "won"))])
    return sums.select(*keys, "n_pos", "n_neg", area.alias("auroc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Sum over falling distinct scores of the gain in recall times the precision; null without positives."""
    curve = cumulative(rows)
    gain = F.col("pos") / F.col("n_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return curve.select(F.when(F.col("n_pos") > 0, gain).alias("gain")).agg(F.sum("gain").alias("average_precision"))


def roc_curve(rows: DataFrame) -> DataFrame:
    """threshold, fpr, tpr of each distinct score, after a first point (0, 0) with no threshold."""
    curve = cumulative(rows).select(
        F.col("score").alias("threshold"), ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), ratio(F.col("tp"), F.col("n_pos")).alias("tpr")
    )
    origin = rows.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return curve.unionByName(origin)


def roc_corners(rows: DataFrame) -> DataFrame:
    """``roc_curve`` without the points that lie within a straight run of equal steps: the area is the same.

    A point goes if the step to it (positives and negatives at its score) equals the step after it. The step after a part's
    last score is that of the next part's first, from a table of one row a part; the first and the last point stay."""
    marked = ranged(by_score(rows), [], "score")
    step = F.struct("pos", "neg")
    every = Window.partitionBy(F.lit(0)).orderBy(F.desc("bin"))
    tops = marked.groupBy("bin").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.max(F.struct("score", step.alias("step")))["step"].alias("head"))
    higher = every.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.sum(c).over(Window.partitionBy(F.lit(0)))
    tops = tops.select(
        F.col("bin").alias("of_bin"),
        F.lead("head").over(every).alias("after_part"),
        (F.row_number().over(every) == 1).alias("is_first"),
        F.coalesce(F.sum("p").over(higher), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("neg_above"),
        total("p").alias("n_pos"),
        total("n").alias("n_neg"),
    )
    down = Window.partitionBy("bin").orderBy(F.desc("score"))
    placed = marked.join(F.broadcast(tops), F.col("bin") == F.col("of_bin")).select(
        "score",
        step.alias("step"),
        F.coalesce(F.lead(step).over(down), F.col("after_part")).alias("next"),
        (F.col("is_first") & (F.row_number().over(down) == 1)).alias("head"),
        (F.sum("pos").over(down) + F.col("pos_above")).alias("tp"),
        (F.sum("neg").over(down) + F.col("neg_above")).alias("fp"),
        "n_pos",
        "n_neg",
    )
    kept = placed.where(F.col("head") | F.col("next").isNull() | (F.col("next") != F.col("step")))
    curve = kept.select(F.col("score").alias("threshold"), ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))
    origin = rows.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return curve.unionByName(origin)


def pr_curve(rows: DataFrame) -> DataFrame:
    """threshold, precision, recall of each distinct score (the closing point without a threshold is left out)."""
    return cumulative(rows).select(
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("n_pos")).alias("recall"),
    )


def best_f1_threshold(rows: DataFrame) -> DataFrame:
    """The curve point of the highest F1, the lowest threshold on ties; no row without scores."""
    points = pr_curve(rows).withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return points.orderBy(F.desc(F.round("f1", 12)), "threshold").limit(1)


def threshold_for_recall(rows: DataFrame, target: float = 0.95) -> DataFrame:
    """Among points with recall of at least ``target``, the highest precision, then the highest threshold."""
    points = pr_curve(rows).where(F.col("recall") >= target)
    return points.orderBy(F.desc(F.round("precision", 12)), F.desc("threshold")).limit(1)


def counts_at(rows: DataFrame, threshold: Column, by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp of ``score >= threshold``."""
    hit, bad = F.col("score") >= threshold, F.col("y_true").cast("int") == 1
    total = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias
    usable = rows.where(F.col("score").isNotNull() & F.col("y_true").isNotNull())
    return usable.groupBy(*by or []).agg(total(~hit & ~bad)("tn"), total(hit & ~bad)("fp"), total(~hit & bad)("fn"), total(hit & bad)("tp"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, fpr, fnr; each is 0.0 where its denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp)})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def threshold_metrics(rows: DataFrame, threshold: float) -> DataFrame:
    return with_rates(counts_at(rows, F.lit(threshold))).withColumn("threshold", F.lit(threshold))


def score_statistics(rows: DataFrame) -> DataFrame:
    """count, mean, median, min, max of the scores of each class."""
    s = F.col("score")
    usable = rows.where(s.isNotNull() & F.col("y_true").isNotNull()).select(F.col("y_true").cast("int").alias("y_true"), "score")
    return with_percentiles(usable, ["y_true"], "score", {"median": 0.5}, weighted("score")).select("y_true", "n", "mean", "median", "min", "max")
