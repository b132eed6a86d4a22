"""Queries over anomaly maps and masks: patch scores against the bank, enlarged to maps, held against masks.

An embedding stands for an image of 4 x 4 patches of four components; the bank is the patches of the bank's images.
Defect images have a rectangle as mask, some an empty one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from normlens.functions.vectors import l2_normalize
from normlens.operators import maps, scoring
from normlens.plans.bindings import PATCHES_SQL, patches

SIDE, FACTOR = 4, 4
PIXELS = SIDE * FACTOR


def _cells(spark, sf_dir):
    """id, v (unit), image (vec_id), cell, defect_type, part of each patch of each image."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda k: F.struct(k.alias("cell"), l2_normalize(F.slice("v", k * 4 + 1, F.lit(4))).alias("p")))
    rows = patches(spark, sf_dir).select(F.col("id").alias("image"), "defect_type", "part", F.inline(cut))
    return rows.select((F.col("image") * 16 + F.col("cell")).alias("id"), F.col("p").alias("v"), "image", "cell", "defect_type", "part")


def _scored(spark, sf_dir):
    rows = _cells(spark, sf_dir)
    return scoring.patch_scores(rows.where("part <> 'bank'"), rows.where("part = 'bank'"))


def _stem(image):
    return F.lpad(image.cast("string"), 8, "0")


def _maps(spark, sf_dir):
    grids = maps.collect_grid(_scored(spark, sf_dir), ("image", "defect_type"))
    return maps.enlarge(grids, SIDE, FACTOR).withColumn("stem", _stem(F.col("image")))


def _masks(spark, sf_dir):
    i = F.col("id")
    inside = lambda p: ((p % PIXELS >= i * 7 % 12) & (p % PIXELS < i * 7 % 12 + i % 7) & (F.floor(p / PIXELS) >= i * 5 % 12) & (F.floor(p / PIXELS) <= i * 5 % 12 + i % 5))
    mask = F.transform(F.sequence(F.lit(0), F.lit(PIXELS * PIXELS - 1)), lambda p: inside(p).cast("tinyint"))
    return patches(spark, sf_dir).where("NOT normal").select("defect_type", _stem(i).alias("stem"), mask.alias("mask"))


def _pairs(spark, sf_dir):
    return maps.join_masks(_maps(spark, sf_dir), _masks(spark, sf_dir))


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def patch_score_map(spark, sf_dir):
    """The map of each image's patch scores: its peak, mean and the pixels at or above half of its range."""
    rows = _maps(spark, sf_dir)
    # Bound as one struct an image: inside the filter's function the ends would be sought again for each pixel.
    ends = F.array(F.struct(F.array_min("map").alias("low"), F.array_max("map").alias("high")))
    hot = F.transform(ends, lambda e: F.size(F.filter("map", lambda x: F.round((x - e["low"]) / (e["high"] - e["low"] + 1e-8), 6) >= 0.5)))[0]
    mean = F.aggregate("map", F.lit(0.0), lambda a, x: a + x) / F.size("map")
    return rows.select("image", "defect_type", F.round(F.array_max("map"), 6).alias("peak"), F.round(mean, 6).alias("mean"), hot.alias("n_hot"))


def pixel_map_sweep(spark, sf_dir):
    return _r(maps.pixel_sweep(_pairs(spark, sf_dir)), "threshold", "precision", "recall", "dice", "iou")


def pixel_map_overlap(spark, sf_dir):
    return _r(maps.best_pixel_overlap(_pairs(spark, sf_dir)), "threshold", "precision", "recall", "iou", "dice")


def pixel_map_auroc(spark, sf_dir):
    return _r(maps.image_auroc(_pairs(spark, sf_dir), ("image", "defect_type")), "auroc")


def pixel_auroc_summary(spark, sf_dir):
    return _r(maps.auroc_summary(maps.image_auroc(_pairs(spark, sf_dir).where("defect_type <> 'good'"), ("image",))), "mean_auroc", "median_auroc")


def score_then_filter(spark, sf_dir):
    """All patches are scored, and those that the image hardly covers are left out afterwards."""
    rows = _scored(spark, sf_dir).withColumn("valid_ratio", F.pmod(F.col("id") * 13, F.lit(100)) / 100)
    found = scoring.score_then_filter(rows.withColumnRenamed("image", "image_id"))
    return _r(found, "score_all", "score")


CELLS_SQL = f"""{PATCHES_SQL},
raw AS (SELECT id AS image, k::INT AS cell, defect_type, part, v[k * 4 + 1:k * 4 + 4] AS p FROM patches, range(16) t(k)),
cells AS (SELECT image, cell, defect_type, part, list_transform(p, lambda x: x / greatest(sqrt(list_sum(list_transform(p, lambda y: y * y))), 1e-12)) AS p FROM raw),
wide AS (SELECT image, cell, defect_type, part, p[1] AS a, p[2] AS b, p[3] AS c, p[4] AS d FROM cells),
scored AS (SELECT q.image, q.cell, q.defect_type, sqrt(greatest(2 - 2 * max(round(q.a * k.a + q.b * k.b + q.c * k.c + q.d * k.d, 9)), 0)) AS distance
           FROM wide q, wide k WHERE q.part <> 'bank' AND k.part = 'bank' GROUP BY ALL)"""
MAPS_SQL = f"""{CELLS_SQL},
axis AS (SELECT t::INT AS t, s::INT AS s, greatest(0.0, 1 - abs(greatest(0.0, least({SIDE - 1}.0, (t + 0.5) / {FACTOR} - 0.5)) - s)) AS w FROM range({PIXELS}) a(t), range({SIDE}) b(s)),
used AS (SELECT * FROM axis WHERE w > 0),
pixels AS (SELECT image, defect_type, r.t AS y, c.t AS x, round(sum(r.w * c.w * distance), 9) AS score
           FROM scored JOIN used r ON r.s = cell // {SIDE} JOIN used c ON c.s = cell % {SIDE} GROUP BY ALL),
marked AS (SELECT *, (defect_type <> 'good' AND x >= image * 7 % 12 AND x < image * 7 % 12 + image % 7 AND y >= image * 5 % 12 AND y <= image * 5 % 12 + image % 5)::INT AS y_true FROM pixels)"""
HISTOGRAM_SQL = f"""{MAPS_SQL}, ends AS (SELECT min(score) AS lo, max(score) AS hi FROM marked),
placed AS (SELECT least(floor((score - lo) / (hi - lo) * 4096), 4095)::INT AS bin, lo, hi, y_true FROM marked, ends),
hist AS (SELECT bin, lo + (hi - lo) / 4096.0 * bin AS threshold, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM placed GROUP BY bin, lo, hi),
swept AS (SELECT bin, threshold, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, (sum(pos) OVER ())::BIGINT AS n FROM hist WINDOW w AS (ORDER BY bin DESC)),
rated AS (SELECT bin, threshold, tp, fp, tp / greatest(tp + fp, 1) AS "precision", tp / greatest(n, 1) AS recall, 2 * tp / greatest(tp + fp + n, 1) AS dice, tp / greatest(fp + n, 1) AS iou FROM swept)"""
AREAS_SQL = f"""{MAPS_SQL},
ranks AS (SELECT image, defect_type, y_true, rank() OVER (PARTITION BY image ORDER BY score) + (count(*) OVER (PARTITION BY image, score) - 1) / 2 AS r FROM marked),
areas AS (SELECT image, defect_type, CASE WHEN sum(y_true) > 0 AND sum(1 - y_true) > 0 THEN (sum(r) FILTER (y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2) / (sum(y_true) * sum(1 - y_true)) END AS auroc FROM ranks GROUP BY ALL)"""

QUERIES = {
    "patch_score_map": (patch_score_map, f"""WITH {MAPS_SQL}, s AS (SELECT *, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-8), 6) AS scaled FROM pixels WINDOW w AS (PARTITION BY image))
SELECT image, defect_type, round(max(score), 6) AS peak, round(avg(score), 6) AS mean, (count(*) FILTER (scaled >= 0.5))::INT AS n_hot FROM s GROUP BY ALL"""),
    "pixel_map_sweep": (pixel_map_sweep, f'WITH {HISTOGRAM_SQL} SELECT bin, round(threshold, 6) AS threshold, tp, fp, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(dice, 6) AS dice, round(iou, 6) AS iou FROM rated'),
    "pixel_map_overlap": (pixel_map_overlap, f"""WITH {HISTOGRAM_SQL}, best AS (SELECT threshold AS t FROM rated ORDER BY round(dice, 12) DESC, threshold LIMIT 1),
c AS (SELECT t AS threshold, count(*) FILTER (score >= t AND y_true = 1) AS tp, count(*) FILTER (score >= t AND y_true = 0) AS fp, count(*) FILTER (score < t AND y_true = 1) AS fn, count(*) FILTER (score < t AND y_true = 0) AS tn FROM marked, best GROUP BY t)
SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp + fn), 6) AS iou, round(2 * tp / (2 * tp + fp + fn), 6) AS dice FROM c"""),
    "pixel_map_auroc": (pixel_map_auroc, f"WITH {AREAS_SQL} SELECT image, defect_type, round(auroc, 6) AS auroc FROM areas"),
    "pixel_auroc_summary": (pixel_auroc_summary, f"WITH {AREAS_SQL} SELECT count(auroc) AS n_images, count(*) - count(auroc) AS n_skipped, round(avg(auroc), 6) AS mean_auroc, round(median(auroc), 6) AS median_auroc FROM areas WHERE defect_type <> 'good'"),
    "score_then_filter": (score_then_filter, f"""WITH {CELLS_SQL}, v AS (SELECT image AS image_id, distance, ((image * 16 + cell) * 13 % 100) / 100 >= 0.5 AS valid FROM scored)
SELECT image_id, round(max(distance), 6) AS score_all, round(max(distance) FILTER (valid), 6) AS score, count(*) AS n_patches, count(*) FILTER (valid) AS n_valid FROM v GROUP BY image_id"""),
}
