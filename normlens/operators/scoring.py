"""Anomaly scores: distance of each patch to its nearest normal patch, the greatest of them for each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlens.functions.vectors import distance
from normlens.operators.nearest import nearest


def patch_scores(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """The query patches with bank_id, similarity and distance of their nearest bank vector.

    ``queries`` has id, v and what else is to be kept. Filter invalid patches first."""
    keep = tuple(c for c in queries.columns if c not in ("id", "v"))
    return nearest(queries, bank, keep=keep).withColumn("distance", distance(F.col("similarity"))).withColumnRenamed("query_id", "id")


def image_scores(patches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """image_id, score (greatest distance), n_patches."""
    return patches.groupBy("image_id", *keep).agg(F.max("distance").alias("score"), F.count(F.lit(1)).alias("n_patches"))


def score_then_filter(patches: DataFrame, least_ratio: float = 0.5) -> DataFrame:
    """image_id, score_all, score, n_patches, n_valid of scored patches: the greatest distance of all, and of the valid ones alone.

    The score is that of filtering first; it is null for an image without a valid patch."""
    valid = F.col("valid_ratio") >= least_ratio
    return patches.groupBy("image_id").agg(
        F.max("distance").alias("score_all"), F.max(F.when(valid, F.col("distance"))).alias("score"), F.count(F.lit(1)).alias("n_patches"), F.count(F.when(valid, 1)).alias("n_valid")
    )


def images_without_patches(images: DataFrame, scores: DataFrame) -> DataFrame:
    """Images for which no patch was valid, so that no score exists."""
    return images.join(scores.select("image_id"), "image_id", "left_anti")


def label_from_score(score: Column, threshold: Column) -> Column:
    """'defect' at or above the threshold, else 'good'; null without a score."""
    return F.when(score.isNull(), F.lit(None)).when(score >= threshold, "defect").otherwise("good")


def error_type(truth: Column, predicted: Column) -> Column:
    return F.when((truth == 1) & (predicted == 1), "TP").when((truth == 0) & (predicted == 1), "FP").when((truth == 1) & (predicted == 0), "FN").otherwise("TN")


def top_patches(patches: DataFrame, k: int = 10) -> DataFrame:
    """The k most distant patches of each image, the smaller patch id on ties."""
    order = Window.partitionBy("image_id").orderBy(F.desc("distance"), "id")
    return patches.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def pair_best_match(first: DataFrame, second: DataFrame) -> DataFrame:
    """For each patch of one image the best match in another, and its anomaly 1 - similarity."""
    found = nearest(second, first)
    return found.withColumn("anomaly", 1 - F.col("similarity"))


def search_consistency(first: DataFrame, second: DataFrame, threshold: float, tolerance: float = 1e-5) -> DataFrame:
    """One row that compares two score sets by image: images, greatest difference, share of equal labels, whether they agree."""
    a = first.select("image_id", F.col("score").alias("a"))
    b = second.select("image_id", F.col("score").alias("b"))
    both = a.join(b, "image_id").withColumn("gap", F.abs(F.col("a") - F.col("b")))
    equal = ((F.col("a") >= threshold) == (F.col("b") >= threshold)).cast("int")
    out = both.agg(F.count(F.lit(1)).alias("n_images"), F.max("gap").alias("max_difference"), F.avg(equal.cast("double")).alias("agreement"))
    return out.withColumn("consistent", F.coalesce((F.col("max_difference") <= tolerance) & (F.col("agreement") == 1), F.lit(False)))
