"""Queries over patches: normalisation, nearest normal patches, image scores, and the whole clean pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.functions.vectors import distance, dot, l2_normalize, norm
from normlens.operators import bank, cells, errors, metrics, nearest, scoring, timing
from normlens.plans.bindings import NEAREST_SQL, PATCHES_SQL, patches, units
from normlens.scratch import process_scratch

THRESHOLD = 1.1
MISSING = 1.2  # a threshold that misses some defects, for the queries about misses


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir)
    return scoring.patch_scores(rows.where("part <> 'bank'"), rows.where("part = 'bank'"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.image_scores(_scored(spark, sf_dir).withColumn("y_true", (~F.col("normal")).cast("int")), ("defect_type", "part", "y_true"))


def l2_normalized(spark, sf_dir):
    rows = patches(spark, sf_dir).withColumn("u", l2_normalize(F.col("v")))
    return rows.select("id", F.round(norm(F.col("v")), 6).alias("length"), F.round(norm(F.col("u")), 9).alias("unit_length"), F.round(F.element_at("u", 1), 6).alias("first"))


def nn_distance(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "bank_id", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"))


def anomaly_image_score(spark, sf_dir):
    return _images(spark, sf_dir).select("image_id", "defect_type", "part", "y_true", F.round("score", 6).alias("score"), "n_patches")


BUCKETS = 8


def stored_scores(spark, sf_dir):
    """Image scores from stored patch scores, and joined with stored images: buckets by image, so nothing is exchanged."""
    scratch = process_scratch(spark)
    scored = scratch.by_key(_scored(spark, sf_dir).select("image_id", "id", "distance"), "scored", "image_id", BUCKETS)
    known = patches(spark, sf_dir).groupBy("image_id", "defect_type", "part").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_stored"))
    known = scratch.by_key(known, "images", "image_id", BUCKETS)
    best = scored.groupBy("image_id").agg(F.max("distance").alias("score"), F.count(F.lit(1)).alias("n_patches"))
    return known.join(best.hint("merge"), "image_id").select("image_id", "defect_type", "part", F.round("score", 6).alias("score"), "n_patches", "n_stored")


def predict_label(spark, sf_dir):
    rows = _images(spark, sf_dir)
    return rows.select("image_id", F.round("score", 6).alias("score"), scoring.label_from_score(F.col("score"), F.lit(THRESHOLD)).alias("prediction"))


def topk_patches(spark, sf_dir):
    return scoring.top_patches(_scored(spark, sf_dir), 3).select("image_id", F.col("place").cast("int").alias("place"), "id", F.round("distance", 6).alias("distance"))


def nn_blocked(spark, sf_dir):
    rows = units(spark, sf_dir)
    found = nearest.blocked(rows.where("part <> 'bank'"), rows.where("part = 'bank'"), 64, 256)
    return found.select(F.col("query_id").alias("id"), "bank_id", F.round("similarity", 6).alias("similarity"))


CELLS, PROBES, CELL_ROUNDS = 8, 3, 3


def _index(spark, sf_dir):
    rows = units(spark, sf_dir)
    table = process_scratch(spark).table(rows.where("part = 'bank'").select("id", "v"), "bank")
    return rows.where("part <> 'bank'"), cells.build(table, CELLS, rounds=CELL_ROUNDS)


def nn_cells(spark, sf_dir):
    """The nearest vector of the three nearest of eight cells, which may miss some; see ``nn_distance`` for the exact one."""
    queries, index = _index(spark, sf_dir)
    found = cells.search(queries, index, PROBES)
    return found.select(F.col("query_id").alias("id"), "bank_id", F.round("similarity", 6).alias("similarity"))


def nn_pruned(spark, sf_dir):
    """The exact nearest vector, by cells whose bound admits it."""
    queries, index = _index(spark, sf_dir)
    return cells.exact(queries, index).select(F.col("query_id").alias("id"), "bank_id", F.round("similarity", 6).alias("similarity"))


def nn_cells_compared(spark, sf_dir):
    """Pairs that the probing search compares, of all."""
    queries, index = _index(spark, sf_dir)
    return cells.compared(queries, index, PROBES)


def search_variants(spark, sf_dir):
    """Stages of three exact searches: the queries, each one's nearest bank vector, and the images' scores."""
    rows = units(spark, sf_dir)

    def stages(search):
        return [
            ("prepare", lambda made: rows.where("part <> 'bank'").select("id", "v", "image_id")),
            ("search", lambda made: search(made["prepare"], rows.where("part = 'bank'").select("id", "v"))),
            ("score", lambda made: scoring.image_scores(made["search"].join(made["prepare"].select(F.col("id").alias("query_id"), "image_id"), "query_id").withColumn("distance", distance(F.col("similarity"))))),
        ]

    return {
        "broadcast": stages(nearest.nearest),
        "blocked": stages(lambda q, b: nearest.blocked(q, b, 64, 1024)),
        "pruned": stages(lambda q, b: cells.exact(q, cells.build(b, CELLS, rounds=CELL_ROUNDS))),
    }


def search_benchmark(spark, sf_dir):
    """Measured stages of three searches: runs and rows of each stage, and how far the variant's scores agree with the first one's.

    The times themselves are in ``timing.measure``'s log; they differ from run to run, so they are no part of this result."""
    log, results = timing.measure(spark, search_variants(spark, sf_dir), process_scratch(spark), runs=2)
    agree = timing.agreement(results, "image_id", "score").select("variant", F.round("agreement", 6).alias("agreement"))
    runs = log.groupBy("variant", "stage").agg(F.count("ms").alias("n_runs"), F.max("n_rows").alias("n_rows"), F.min(F.col("ms") > 0).alias("timed"))
    return runs.join(agree, "variant").select("variant", "stage", "n_runs", "n_rows", "timed", "agreement")


def pair_best_match(spark, sf_dir):
    rows = units(spark, sf_dir)
    found = scoring.pair_best_match(rows.where("label = 0 AND ordinal = 0"), rows.where("label = 3"))
    return found.orderBy("similarity", "query_id").limit(5).select("query_id", "bank_id", F.round("similarity", 6).alias("similarity"), F.round("anomaly", 6).alias("anomaly"))


def cosine_pairs(spark, sf_dir):
    """Every two patches of one image."""
    rows = units(spark, sf_dir).select("id", "image_id", "v")
    a, b = rows.select(F.col("id").alias("a"), F.col("image_id").alias("ia"), F.col("v").alias("va")), rows.select(F.col("id").alias("b"), F.col("image_id").alias("ib"), F.col("v").alias("vb"))
    return a.join(b, (F.col("ia") == F.col("ib")) & (F.col("a") < F.col("b"))).select("a", "b", F.round(dot(F.col("va"), F.col("vb")), 6).alias("cosine"))


def search_consistency(spark, sf_dir):
    rows = units(spark, sf_dir)
    queries, whole = rows.where("part <> 'bank'"), rows.where("part = 'bank'")
    first = scoring.image_scores(scoring.patch_scores(queries, whole))
    found = nearest.blocked(queries, whole, 64, 256).withColumnRenamed("query_id", "id")
    second = scoring.image_scores(queries.drop("v").join(found, "id").withColumn("distance", distance(F.col("similarity"))))
    return scoring.search_consistency(first, second, THRESHOLD).withColumn("max_difference", F.round("max_difference", 6))


def memory_bank_stats(spark, sf_dir):
    rows = patches(spark, sf_dir).withColumn("label", (~F.col("normal")).cast("int"))
    built = bank.build_bank(rows.where("part = 'bank'"))
    return bank.bank_statistics(rows, built).select("n_candidates", "n_kept", F.round("keep_ratio", 6).alias("keep_ratio"), "dims", F.round("size_mb", 6).alias("size_mb"))


def random_projection(spark, sf_dir):
    rows = bank.random_projection(units(spark, sf_dir).select("id", "v"), 64, 8)
    return rows.select("id", F.posexplode("v").alias("dim", "x")).select("id", "dim", F.round("x", 6).alias("x"))


def farthest_first(spark, sf_dir):
    rows = units(spark, sf_dir).where("part = 'bank'").select("id", "v")
    return bank.farthest_first(rows, 0.10).select("pick", "id", F.round("similarity", 6).alias("similarity"))


def farthest_first_seeded(spark, sf_dir):
    rows = units(spark, sf_dir).where("part = 'bank'").select("id", "v")
    return bank.farthest_first(rows, 0.10, start_seed=42).select("pick", "id", F.round("similarity", 6).alias("similarity"))


def coreset_distributed(spark, sf_dir):
    rows = units(spark, sf_dir).where("part = 'bank'").select("id", "v")
    return bank.distributed_coreset(rows, 0.10).select("pick", "id", F.round("similarity", 6).alias("similarity"))


def coreset_score(spark, sf_dir):
    rows = units(spark, sf_dir)
    whole = rows.where("part = 'bank'").select("id", "v")
    core = bank.gather(whole, bank.farthest_first(whole, 0.10))
    return scoring.image_scores(scoring.patch_scores(rows.where("part <> 'bank'"), core)).select("image_id", F.round("score", 6).alias("score"), "n_patches")


def clean_pipeline_report(spark, sf_dir):
    """Bank, scores, a threshold frozen on validation, and the report of both parts."""
    rows = _images(spark, sf_dir).withColumn("score", F.round("score", 6))
    rows = process_scratch(spark).table(rows.select("image_id", "part", "y_true", "score"), "scores")  # one row an image, read four times below
    frozen = metrics.best_f1_threshold(rows.where("part = 'validation'")).select("threshold")
    marked = rows.crossJoin(F.broadcast(frozen))
    counts = metrics.counts_at(marked, F.col("threshold"), ["part", "threshold"])
    areas = metrics.auroc(rows, ["part"]).select(F.col("part").alias("p"), "auroc")
    out = metrics.with_rates(counts).join(areas, F.col("part") == F.col("p"))
    return out.select("part", "threshold", "tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr", "fnr", "auroc")])


def error_types(spark, sf_dir):
    rows = errors.with_errors(_images(spark, sf_dir), THRESHOLD)
    return rows.groupBy("part", "error_type").agg(F.count(F.lit(1)).alias("n"))


def per_type_recall(spark, sf_dir):
    rows = errors.recall_by_type(errors.with_errors(_images(spark, sf_dir), THRESHOLD), "defect_type")
    return rows.select("defect_type", "total", "tp", "fn", F.round("recall", 6).alias("recall"), F.round("miss_rate", 6).alias("miss_rate"))


def fn_by_type(spark, sf_dir):
    return errors.misses_by_type(errors.with_errors(_images(spark, sf_dir), MISSING), "defect_type")


def _worst(kind, threshold):
    def run(spark, sf_dir):
        rows = errors.with_errors(_images(spark, sf_dir).withColumn("score", F.round("score", 6)), threshold)
        return errors.worst(rows, kind, 15, "image_id").select("image_id", "defect_type", "score")

    return run


IMAGE_ERRORS_SQL = f"""{NEAREST_SQL},
judged AS (SELECT *, (score >= {THRESHOLD})::INT AS y_pred, CASE WHEN y_true = 1 THEN CASE WHEN score >= {THRESHOLD} THEN 'TP' ELSE 'FN' END
                  WHEN score >= {THRESHOLD} THEN 'FP' ELSE 'TN' END AS error_type FROM images)"""
MISSED_SQL = IMAGE_ERRORS_SQL.replace(f">= {THRESHOLD}", f">= {MISSING}")
WORST_SQL = "WITH {}, rounded AS (SELECT image_id, defect_type, round(score, 6) AS score, error_type FROM judged) SELECT image_id, defect_type, score FROM rounded WHERE error_type = '{}' ORDER BY score {}, image_id LIMIT 15"
# The greedy selection as a recursive query: one picked vector in each step.
GREEDY_SQL = f"""{PATCHES_SQL},
bank AS (SELECT id, v FROM units WHERE part = 'bank'),
target AS (SELECT greatest(1, round_even(count(*) * 0.10, 0)::INT) AS k, min(id) AS first FROM bank),
near AS (SELECT a.id AS a, b.id AS b, round(list_inner_product(a.v, b.v), 9) AS s FROM bank a, bank b),
picks AS (
  SELECT 0 AS pick, [first] AS ids, [NULL::DOUBLE] AS sims FROM target
  UNION ALL
  SELECT pick + 1, list_append(ids, nxt.a), list_append(sims, nxt.m)
  FROM picks, LATERAL (SELECT n.a, max(n.s) AS m FROM near n WHERE list_contains(picks.ids, n.b) AND NOT list_contains(picks.ids, n.a)
                       GROUP BY n.a ORDER BY m, n.a LIMIT 1) nxt
  WHERE pick + 1 < (SELECT k FROM target)),
chosen AS (SELECT * FROM picks ORDER BY pick DESC LIMIT 1),
core AS (SELECT (i - 1)::INT AS pick, ids[i] AS id, sims[i] AS similarity FROM chosen, range(1, len(ids) + 1) t(i))"""
SEEDED_FIRST = "arg_min(id, md5('42|' || id)) AS first"
# One part: twice the share first, of which the share is chosen again, from the smallest id. Equal to greedy over those kept.
TWICE_SQL = GREEDY_SQL.replace("count(*) * 0.10", "count(*) * 0.20") + """,
kept AS (SELECT * FROM units WHERE id IN (SELECT id FROM core)),
target2 AS (SELECT greatest(1, round_even((SELECT count(*) FROM bank) * 0.10, 0)::INT) AS k, min(id) AS first FROM kept),
near2 AS (SELECT a.id AS a, b.id AS b, round(list_inner_product(a.v, b.v), 9) AS s FROM kept a, kept b),
picks2 AS (
  SELECT 0 AS pick, [first] AS ids, [NULL::DOUBLE] AS sims FROM target2
  UNION ALL
  SELECT pick + 1, list_append(ids, nxt.a), list_append(sims, nxt.m)
  FROM picks2, LATERAL (SELECT n.a, max(n.s) AS m FROM near2 n WHERE list_contains(picks2.ids, n.b) AND NOT list_contains(picks2.ids, n.a)
                        GROUP BY n.a ORDER BY m, n.a LIMIT 1) nxt
  WHERE pick + 1 < (SELECT k FROM target2)),
chosen2 AS (SELECT * FROM picks2 ORDER BY pick DESC LIMIT 1)
SELECT (i - 1)::INT AS pick, ids[i] AS id, round(sims[i], 6) AS similarity FROM chosen2, range(1, len(ids) + 1) t(i)"""



def _cells_sql() -> str:
    """Spherical k-means from the first bank vectors in MD5 order, one step after the other, and each query's nearest cells."""
    steps = [f"""bank AS (SELECT id, v FROM units WHERE part = 'bank'),
c0 AS (SELECT (row_number() OVER (ORDER BY md5('42|' || id), id) - 1)::INT AS cell, v FROM bank QUALIFY cell < {CELLS})"""]
    place = "SELECT * EXCLUDE s FROM (SELECT b.id, b.v, c.cell, round(list_inner_product(b.v, c.v), 9) AS s FROM bank b, c{} c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, cell) = 1"
    for k in range(CELL_ROUNDS):
        steps.append(f"""own{k} AS ({place.format(k)}),
sums{k} AS (SELECT cell, list(x ORDER BY i) AS v FROM (SELECT cell, i, sum(v[i]) AS x FROM own{k}, range(1, 65) t(i) GROUP BY cell, i) GROUP BY cell),
c{k + 1} AS (SELECT cell, coalesce(list_transform(s.v, lambda x: x / sqrt(list_sum(list_transform(s.v, lambda y: y * y)))), c.v) AS v FROM c{k} c LEFT JOIN sums{k} s USING (cell))""")
    steps.append(f"""placed AS ({place.format(CELL_ROUNDS)}),
probed AS (SELECT q.id, q.v, c.cell FROM units q, (SELECT * FROM c{CELL_ROUNDS} WHERE cell IN (SELECT cell FROM placed)) c WHERE q.part <> 'bank'
           QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(q.v, c.v), 9) DESC, c.cell) <= {PROBES})""")
    return PATCHES_SQL + ",\n" + ",\n".join(steps)


PROBED_SQL = _cells_sql()

QUERIES = {
    "l2_normalize": (l2_normalized, f"WITH {PATCHES_SQL} SELECT p.id, round(sqrt(list_inner_product(p.v, p.v)), 6) AS length, round(sqrt(list_inner_product(u.v, u.v)), 9) AS unit_length, round(u.v[1], 6) AS first FROM patches p JOIN units u ON p.id = u.id"),
    "nn_distance": (nn_distance, f"WITH {NEAREST_SQL} SELECT id, bank_id, round(similarity, 6) AS similarity, round(distance, 6) AS distance FROM distances"),
    "anomaly_image_score": (anomaly_image_score, f"WITH {NEAREST_SQL} SELECT image_id, defect_type, part, y_true, round(score, 6) AS score, n_patches FROM images"),
    "stored_scores": (stored_scores, f"WITH {NEAREST_SQL} SELECT image_id, defect_type, part, round(score, 6) AS score, n_patches, n_patches AS n_stored FROM images"),
    "predict_label": (predict_label, f"WITH {NEAREST_SQL} SELECT image_id, round(score, 6) AS score, CASE WHEN score >= {THRESHOLD} THEN 'defect' ELSE 'good' END AS prediction FROM images"),
    "topk_patches": (topk_patches, f"WITH {NEAREST_SQL} SELECT image_id, place2::INT AS place, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY distance DESC, id) AS place2 FROM distances) WHERE place2 <= 3"),
    "nn_blocked": (nn_blocked, f"WITH {NEAREST_SQL} SELECT id, bank_id, round(similarity, 6) AS similarity FROM nearest"),
    "nn_cells": (nn_cells, f"WITH {PROBED_SQL}, found AS (SELECT p.id, b.id AS bank_id, round(list_inner_product(p.v, b.v), 9) AS s FROM probed p JOIN placed b USING (cell)), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, bank_id) AS place FROM found) SELECT id, bank_id, round(s, 6) AS similarity FROM best WHERE place = 1"),
    "nn_pruned": (nn_pruned, f"WITH {NEAREST_SQL} SELECT id, bank_id, round(similarity, 6) AS similarity FROM nearest"),
    "nn_cells_compared": (nn_cells_compared, f"WITH {PROBED_SQL} SELECT (SELECT count(*) FROM placed) * (SELECT count(DISTINCT id) FROM probed) AS n_pairs, (SELECT count(*) FROM probed JOIN placed USING (cell)) AS n_compared"),
    "search_benchmark": (search_benchmark, f"""WITH {NEAREST_SQL}, n(stage, n_rows) AS (SELECT unnest(['prepare', 'search']), count(*) FROM nearest UNION ALL SELECT unnest(['score', 'total']), count(*) FROM images)
SELECT variant, stage, 2::BIGINT AS n_runs, n_rows, TRUE AS timed, 1.0::DOUBLE AS agreement FROM n, (VALUES ('broadcast'), ('blocked'), ('pruned')) v(variant)"""),
    "pair_best_match": (pair_best_match, f"""WITH {PATCHES_SQL}, pairs AS (SELECT q.id AS query_id, b.id AS bank_id, round(list_inner_product(q.v, b.v), 9) AS s FROM units q, units b WHERE q.label = 3 AND b.label = 0 AND b.ordinal = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, bank_id) AS place FROM pairs)
SELECT query_id, bank_id, round(s, 6) AS similarity, round(1 - s, 6) AS anomaly FROM best WHERE place = 1 ORDER BY s, query_id LIMIT 5"""),
    "cosine_pairs": (cosine_pairs, f"WITH {PATCHES_SQL} SELECT a.id AS a, b.id AS b, round(list_inner_product(a.v, b.v), 6) AS cosine FROM units a JOIN units b ON a.image_id = b.image_id AND a.id < b.id"),
    # The second search by differences of components, not by inner products.
    "search_consistency": (search_consistency, f"""WITH {NEAREST_SQL},
direct AS (SELECT q.id, q.image_id, min(sqrt(list_sum(list_transform(list_zip(q.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS d FROM units q, units b WHERE q.part <> 'bank' AND b.part = 'bank' GROUP BY ALL),
second AS (SELECT image_id, max(d) AS b FROM direct GROUP BY image_id),
both_scores AS (SELECT i.score AS a, s.b FROM images i JOIN second s USING (image_id))
SELECT count(*) AS n_images, round(max(abs(a - b)), 6) AS max_difference, avg(((a >= {THRESHOLD}) = (b >= {THRESHOLD}))::INT)::DOUBLE AS agreement,
       max(abs(a - b)) <= 1e-5 AND avg(((a >= {THRESHOLD}) = (b >= {THRESHOLD}))::INT) = 1 AS consistent FROM both_scores"""),
    "memory_bank_stats": (memory_bank_stats, f"WITH {PATCHES_SQL}, c AS (SELECT count(*) FILTER (normal) AS n_candidates, count(*) FILTER (part = 'bank') AS n_kept FROM patches) SELECT n_candidates, n_kept, round(n_kept / n_candidates, 6) AS keep_ratio, 64 AS dims, round(n_kept * 64 * 4 / 1048576, 6) AS size_mb FROM c"),
    "random_projection": (random_projection, f"""WITH {PATCHES_SQL},
signs AS (SELECT j, i, CASE WHEN ('0x' || substr(md5('42|' || i || '|' || j), 1, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM range(64) a(i), range(8) b(j)),
raw AS (SELECT id, j, sum(v[i + 1] * s) / sqrt(8.0) AS x FROM units, signs GROUP BY id, j)
SELECT id, j::INT AS dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY id)), 1e-12), 6) AS x FROM raw"""),
    "farthest_first": (farthest_first, f"WITH RECURSIVE {GREEDY_SQL} SELECT pick, id, round(similarity, 6) AS similarity FROM core"),
    "farthest_first_seeded": (farthest_first_seeded, f"WITH RECURSIVE {GREEDY_SQL.replace('min(id) AS first', SEEDED_FIRST)} SELECT pick, id, round(similarity, 6) AS similarity FROM core"),
    "coreset_distributed": (coreset_distributed, f"WITH RECURSIVE {TWICE_SQL}"),
    "coreset_score": (coreset_score, f"""WITH RECURSIVE {GREEDY_SQL},
best AS (SELECT q.id, q.image_id, max(round(list_inner_product(q.v, b.v), 9)) AS s FROM units q, units b WHERE q.part <> 'bank' AND b.id IN (SELECT id FROM core) GROUP BY ALL)
SELECT image_id, round(max(sqrt(greatest(2 - 2 * s, 0))), 6) AS score, count(*) AS n_patches FROM best GROUP BY image_id"""),
    "clean_pipeline_report": (clean_pipeline_report, f"""WITH {NEAREST_SQL},
rounded AS (SELECT image_id, part, y_true, round(score, 6) AS score FROM images),
curve AS (SELECT score, sum(sum(y_true)) OVER w AS tp, sum(sum(1 - y_true)) OVER w AS fp, sum(sum(y_true)) OVER () AS n FROM rounded WHERE part = 'validation' GROUP BY score WINDOW w AS (ORDER BY score DESC)),
points AS (SELECT score AS threshold, tp / (tp + fp) AS p, tp / n AS r FROM curve),
frozen AS (SELECT threshold FROM points ORDER BY round(2 * p * r / greatest(p + r, 1e-12), 12) DESC, threshold LIMIT 1),
counts AS (SELECT part, threshold, count(*) FILTER (score < threshold AND y_true = 0) AS tn, count(*) FILTER (score >= threshold AND y_true = 0) AS fp,
                  count(*) FILTER (score < threshold AND y_true = 1) AS fn, count(*) FILTER (score >= threshold AND y_true = 1) AS tp FROM rounded, frozen GROUP BY ALL),
ranks AS (SELECT part, y_true, rank() OVER (PARTITION BY part ORDER BY score) + (count(*) OVER (PARTITION BY part, score) - 1) / 2 AS r FROM rounded),
areas AS (SELECT part, (sum(r) FILTER (y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2) / (sum(y_true) * sum(1 - y_true)) AS auroc FROM ranks GROUP BY part)
SELECT part, threshold, tn, fp, fn, tp, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall,
       round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr, round(auroc, 6) AS auroc FROM counts JOIN areas USING (part)"""),
    "error_type": (error_types, f"WITH {IMAGE_ERRORS_SQL} SELECT part, error_type, count(*) AS n FROM judged GROUP BY ALL"),
    "per_type_recall": (per_type_recall, f"WITH {IMAGE_ERRORS_SQL}, t AS (SELECT defect_type, count(*) AS total, sum(y_pred)::BIGINT AS tp FROM judged WHERE y_true = 1 GROUP BY 1) SELECT defect_type, total, tp, total - tp AS fn, round(tp / total, 6) AS recall, round((total - tp) / total, 6) AS miss_rate FROM t"),
    "fn_by_type": (fn_by_type, f"WITH {MISSED_SQL} SELECT defect_type, count(*) AS n_missed FROM judged WHERE error_type = 'FN' GROUP BY 1"),
    "top_false_positives": (_worst("FP", THRESHOLD), WORST_SQL.format(IMAGE_ERRORS_SQL, "FP", "DESC")),
    "top_false_negatives": (_worst("FN", MISSING), WORST_SQL.format(MISSED_SQL, "FN", "ASC")),
}
