"""Queries over scores and latency logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from normlens.operators import latency, metrics, sweeps
from normlens.plans.bindings import CURVE_SQL, SCORES_SQL, log, scores


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


RATES = ("precision", "recall", "f1", "fpr", "fnr")
RATES_SQL = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS fpr, round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 6) AS fnr"""
COUNTS_SQL = "count(*) FILTER (score < t AND y_true = 0) AS tn, count(*) FILTER (score >= t AND y_true = 0) AS fp, count(*) FILTER (score < t AND y_true = 1) AS fn, count(*) FILTER (score >= t AND y_true = 1) AS tp"


def auroc(spark, sf_dir):
    return _r(metrics.auroc(scores(spark, sf_dir)), "auroc")


def auroc_by_group(spark, sf_dir):
    return _r(metrics.auroc(scores(spark, sf_dir), ["grp"]), "auroc")


def mean_group_auroc(spark, sf_dir):
    rows = metrics.auroc(scores(spark, sf_dir), ["grp"]).where(F.col("auroc").isNotNull())
    return rows.agg(F.round(F.avg("auroc"), 6).alias("mean_auroc"), F.round(F.percentile("auroc", F.lit(0.5)), 6).alias("median_auroc"), F.count(F.lit(1)).alias("n_groups"))


def average_precision(spark, sf_dir):
    return _r(metrics.average_precision(scores(spark, sf_dir)), "average_precision")


def roc_curve(spark, sf_dir):
    return _r(metrics.roc_curve(scores(spark, sf_dir)), "threshold", "fpr", "tpr")


def roc_corners(spark, sf_dir):
    return _r(metrics.roc_corners(scores(spark, sf_dir)), "threshold", "fpr", "tpr")


def pr_curve(spark, sf_dir):
    return _r(metrics.pr_curve(scores(spark, sf_dir)), "threshold", "precision", "recall")


def best_f1_threshold(spark, sf_dir):
    return _r(metrics.best_f1_threshold(scores(spark, sf_dir)), "threshold", "precision", "recall", "f1")


def recall95_threshold(spark, sf_dir):
    return _r(metrics.threshold_for_recall(scores(spark, sf_dir)), "threshold", "precision", "recall")


def threshold_metrics(spark, sf_dir):
    return _r(metrics.threshold_metrics(scores(spark, sf_dir), 50.0), *RATES)


def score_statistics(spark, sf_dir):
    return _r(metrics.score_statistics(scores(spark, sf_dir)), "mean", "median", "min", "max")


def linear_sweep_500(spark, sf_dir):
    return _r(sweeps.linear_sweep(scores(spark, sf_dir), 500), "threshold", *RATES)


def linear_sweep_300(spark, sf_dir):
    return sweeps.sweep_choices(sweeps.linear_sweep(scores(spark, sf_dir), 300)).where("choice = 'best_f1'").select("step", F.round("threshold", 6).alias("threshold"), "tp", "fp", F.round("f1", 6).alias("f1"))


def sweep_high_recall(spark, sf_dir):
    rows = sweeps.sweep_choices(sweeps.linear_sweep(scores(spark, sf_dir), 500))
    return _r(rows.select("choice", "step", "threshold", "tp", "fp", "precision", "recall"), "threshold", "precision", "recall")


def histogram_sweep_4096(spark, sf_dir):
    return _r(sweeps.histogram_sweep(scores(spark, sf_dir)), "threshold", "precision", "recall", "dice", "iou")


def pixel_iou_dice(spark, sf_dir):
    return _r(sweeps.best_overlap(scores(spark, sf_dir)), "threshold", "precision", "recall", "iou", "dice")


def latency_summary(spark, sf_dir):
    return _r(latency.summarize(log(spark, sf_dir), ["stage"]), "mean", "median", "p95", "min", "max")


def throughput(spark, sf_dir):
    return _r(latency.throughput(log(spark, sf_dir), ["stage"]), "per_second")


def latency_stages(spark, sf_dir):
    """Wide timings of each event as stages, unpivoted and summarised after the warm-up."""
    ms = F.col("ms")
    wide = latency.skip_warm_up(log(spark, sf_dir), "event_id").select("event_id", (ms * 0.5).alias("preprocess"), (ms * 0.25).alias("features"), (ms * 0.25).alias("search"), ms.alias("total"))
    rows = latency.unpivot_stages(wide, ["event_id"], ["preprocess", "features", "search", "total"])
    return _r(latency.summarize(rows, ["stage"]), "mean", "median", "p95", "min", "max")


def _sweep_sql(steps: int) -> str:
    return f"""{SCORES_SQL}, ends AS (SELECT min(score) AS lo, max(score) AS hi FROM scores),
grid AS (SELECT i::INT AS step, CASE WHEN i = {steps - 1} THEN hi ELSE lo + i * ((hi - lo) / {steps - 1}.0::DOUBLE) END AS t FROM ends, range({steps}) r(i)),
sweep AS (SELECT step, t AS threshold, {COUNTS_SQL} FROM grid, scores GROUP BY ALL)"""


SUMMARY_SQL = "count(ms) AS n, round(avg(ms), 6) AS mean, round(median(ms), 6) AS median, round(quantile_cont(ms, 0.95), 6) AS p95, round(min(ms), 6) AS min, round(max(ms), 6) AS max"
AREA_SQL = """ranks AS (SELECT grp, y_true, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2 AS r FROM scores),
areas AS (SELECT grp, sum(y_true)::BIGINT AS n_pos, sum(1 - y_true)::BIGINT AS n_neg,
                 CASE WHEN sum(y_true) > 0 AND sum(1 - y_true) > 0 THEN (sum(r) FILTER (y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2) / (sum(y_true) * sum(1 - y_true)) END AS auroc FROM ranks GROUP BY grp)"""
HISTOGRAM_SQL = f"""{SCORES_SQL}, ends AS (SELECT min(score) AS lo, max(score) AS hi FROM scores),
placed AS (SELECT least(floor((score - lo) / (hi - lo) * 4096), 4095)::INT AS bin, lo, hi, y_true FROM scores, ends),
hist AS (SELECT bin, lo + (hi - lo) / 4096.0 * bin AS threshold, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM placed GROUP BY bin, lo, hi),
swept AS (SELECT bin, threshold, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, (sum(pos) OVER ())::BIGINT AS n FROM hist WINDOW w AS (ORDER BY bin DESC)),
rated AS (SELECT bin, threshold, tp, fp, tp / greatest(tp + fp, 1) AS "precision", tp / greatest(n, 1) AS recall, 2 * tp / greatest(tp + fp + n, 1) AS dice, tp / greatest(fp + n, 1) AS iou FROM swept)"""
POINTS_F1_SQL = f'{CURVE_SQL}, best AS (SELECT *, 2 * "precision" * recall / greatest("precision" + recall, 1e-12) AS f1 FROM points)'

QUERIES = {
    "auroc": (auroc, f"WITH {SCORES_SQL}, ranks AS (SELECT y_true, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM scores) SELECT sum(y_true)::BIGINT AS n_pos, sum(1 - y_true)::BIGINT AS n_neg, round((sum(r) FILTER (y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2) / (sum(y_true) * sum(1 - y_true)), 6) AS auroc FROM ranks"),
    "auroc_by_group": (auroc_by_group, f"WITH {SCORES_SQL}, {AREA_SQL} SELECT grp, n_pos, n_neg, round(auroc, 6) AS auroc FROM areas"),
    "mean_group_auroc": (mean_group_auroc, f"WITH {SCORES_SQL}, {AREA_SQL} SELECT round(avg(auroc), 6) AS mean_auroc, round(median(auroc), 6) AS median_auroc, count(auroc) AS n_groups FROM areas"),
    "average_precision": (average_precision, f"WITH {CURVE_SQL} SELECT round(sum((tp - before) / n_pos * tp / (tp + fp)), 6) AS average_precision FROM (SELECT *, lag(tp, 1, 0) OVER (ORDER BY score DESC) AS before FROM curve)"),
    "roc_curve": (roc_curve, f"WITH {CURVE_SQL} SELECT round(score, 6) AS threshold, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr FROM curve UNION ALL SELECT NULL, 0.0, 0.0"),
    "roc_corners": (roc_corners, f"""WITH {CURVE_SQL}, steps AS (SELECT c.*, pos, neg, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS place FROM curve c JOIN bins b ON c.score = b.score WINDOW w AS (ORDER BY c.score DESC))
SELECT round(score, 6) AS threshold, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr FROM steps WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg UNION ALL SELECT NULL, 0.0, 0.0"""),
    "pr_curve": (pr_curve, f'WITH {CURVE_SQL} SELECT round(threshold, 6) AS threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM points'),
    "best_f1_threshold": (best_f1_threshold, f'WITH {POINTS_F1_SQL} SELECT round(threshold, 6) AS threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM best ORDER BY round(best.f1, 12) DESC, best.threshold LIMIT 1'),
    "recall95_threshold": (recall95_threshold, f'WITH {CURVE_SQL} SELECT round(threshold, 6) AS threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM points WHERE recall >= 0.95 ORDER BY round(points."precision", 12) DESC, points.threshold DESC LIMIT 1'),
    "threshold_metrics": (threshold_metrics, f"WITH {SCORES_SQL}, c AS (SELECT 50.0::DOUBLE AS threshold, {COUNTS_SQL} FROM scores, (SELECT 50.0 AS t)) SELECT tn, fp, fn, tp, {RATES_SQL}, threshold FROM c"),
    "score_statistics": (score_statistics, f"WITH {SCORES_SQL} SELECT y_true, count(score) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(min(score), 6) AS min, round(max(score), 6) AS max FROM scores GROUP BY y_true"),
    "linear_sweep_500": (linear_sweep_500, f"WITH {_sweep_sql(500)} SELECT step, round(threshold, 6) AS threshold, tn, fp, fn, tp, {RATES_SQL} FROM sweep"),
    "linear_sweep_300": (linear_sweep_300, f"WITH {_sweep_sql(300)} SELECT step, round(threshold, 6) AS threshold, tp, fp, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM sweep ORDER BY round(2 * tp / (2 * tp + fp + fn), 12) DESC, sweep.threshold LIMIT 1"),
    "sweep_high_recall": (sweep_high_recall, f"""WITH {_sweep_sql(500)}, rated AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, tp / (tp + fn) AS r, 2 * tp / (2 * tp + fp + fn) AS f FROM sweep),
a AS (SELECT 'best_f1' AS choice, * FROM rated ORDER BY round(f, 12) DESC, threshold LIMIT 1), b AS (SELECT 'high_recall' AS choice, * FROM rated WHERE r >= 0.95 ORDER BY round(p, 12) DESC, threshold LIMIT 1)
SELECT choice, step, round(threshold, 6) AS threshold, tp, fp, round(p, 6) AS "precision", round(r, 6) AS recall FROM (FROM a UNION ALL FROM b)"""),
    "histogram_sweep_4096": (histogram_sweep_4096, f'WITH {HISTOGRAM_SQL} SELECT bin, round(threshold, 6) AS threshold, tp, fp, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(dice, 6) AS dice, round(iou, 6) AS iou FROM rated'),
    "pixel_iou_dice": (pixel_iou_dice, f"""WITH {HISTOGRAM_SQL}, best AS (SELECT threshold AS t FROM rated ORDER BY round(dice, 12) DESC, threshold LIMIT 1),
c AS (SELECT t AS threshold, {COUNTS_SQL} FROM scores, best GROUP BY t)
SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp + fn), 6) AS iou, round(2 * tp / (2 * tp + fp + fn), 6) AS dice FROM c"""),
    "latency_summary": (latency_summary, f"WITH log AS (SELECT event_type AS stage, value AS ms FROM events) SELECT stage, {SUMMARY_SQL} FROM log GROUP BY stage"),
    "throughput": (throughput, "SELECT event_type AS stage, round(CASE WHEN avg(value) > 0 THEN 1000 / avg(value) ELSE 0 END, 6) AS per_second FROM events GROUP BY event_type"),
    "latency_stages": (latency_stages, f"""WITH kept AS (SELECT value FROM events WHERE event_id NOT IN (SELECT DISTINCT event_id FROM events ORDER BY event_id LIMIT 20)),
log AS (SELECT stage, value * share AS ms FROM kept, (VALUES ('preprocess', 0.5::DOUBLE), ('features', 0.25::DOUBLE), ('search', 0.25::DOUBLE), ('total', 1.0::DOUBLE)) s(stage, share))
SELECT stage, {SUMMARY_SQL} FROM log GROUP BY stage"""),
}
