"""Queries over the file catalog: counts, duplicates, leakage, splits, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from normlens.functions import paths
from normlens.operators import files as ops
from normlens.operators import hamming, sieve
from normlens.plans.bindings import FILES_SQL, PATCHES_SQL, files, images, patches, IMAGES_SQL
from normlens.scratch import process_scratch


def path_parts(spark, sf_dir):
    rows, path = files(spark, sf_dir), F.col("path")
    return rows.select(
        "path",
        paths.extension(path).alias("extension"),
        paths.is_image(path).alias("is_image"),
        paths.split_of(path).alias("split"),
        paths.product_of(path).alias("product"),
        paths.parent_of(path).alias("parent"),
        paths.stem_of(path).alias("stem"),
        paths.relative_to(F.concat(F.lit("/data/"), path), "/data").alias("relative"),
    )


def count_images(spark, sf_dir):
    return files(spark, sf_dir).where(paths.is_image(F.col("path"))).groupBy("product").agg(F.count(F.lit(1)).alias("n_images"))


def catalog_counts(spark, sf_dir):
    rows = files(spark, sf_dir).where(paths.is_image(F.col("path")))
    return rows.rollup("product", "split", "defect_type").agg(F.count(F.lit(1)).alias("n"))


def split_pivot(spark, sf_dir):
    rows = files(spark, sf_dir).groupBy("product").pivot("split", ["train", "test"]).agg(F.count(F.lit(1)))
    return rows.select("product", F.coalesce("train", F.lit(0)).alias("train"), F.coalesce("test", F.lit(0)).alias("test"))


def attribute_counts(spark, sf_dir):
    """Counts by extension, resolution (20 commonest) and channel description."""
    rows = files(spark, sf_dir).select(paths.extension(F.col("path")).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("attribute", F.lit("extension"))
    sizes = images(spark, sf_dir).select(F.concat_ws("x", "width", "height").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.orderBy(F.desc("n"), "value").limit(20).withColumn("attribute", F.lit("resolution"))
    channels = images(spark, sf_dir).select(paths.channels_text(F.col("image_id") % 5).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("attribute", F.lit("channels"))
    return rows.unionByName(sizes).unionByName(channels).select("attribute", "value", "n")


def exact_duplicate_groups(spark, sf_dir):
    return ops.duplicate_groups(files(spark, sf_dir))


def leakage_groups(spark, sf_dir):
    return ops.leakage_groups(files(spark, sf_dir))


def cross_group_duplicates(spark, sf_dir):
    return ops.cross_product_groups(files(spark, sf_dir))


def duplicate_summary(spark, sf_dir):
    return ops.duplicate_summary(files(spark, sf_dir))


def canonical_rows(spark, sf_dir):
    return ops.canonical(files(spark, sf_dir).select("path", "sha256", "split", "defect_type")).select("sha256", "path", "split", "defect_type", "n_removed")


def _parts(spark, sf_dir):
    rows = files(spark, sf_dir).select("path", "sha256", "split", "defect_type", "stem")
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def leakage_anti_join(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    return ops.without_leaks(test, train).select("path", "sha256")


def leakage_sieved(spark, sf_dir):
    """The same by way of a stored filter of train's digests."""
    train, test = _parts(spark, sf_dir)
    stored = process_scratch(spark).table(sieve.build(train, "sha256"), "filter")
    return sieve.without_leaks_sieved(test, train, stored).select("path", "sha256")


def leakage_examples(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    return ops.leaked(test, train).select("path", "sha256").orderBy("path").limit(10)


def _clean(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    held = ops.canonical(ops.without_leaks(test, train)).drop("n_removed")
    return ops.canonical(train).drop("n_removed"), ops.stratified_split(held)


def overlap_check(spark, sf_dir):
    train, held = _clean(spark, sf_dir)
    return ops.overlap({"train": train, "validation": held.where("part = 'validation'"), "test": held.where("part = 'test'")})


def raw_overlap(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    return ops.overlap({"train": train, "test": test})


def stratified_split(spark, sf_dir):
    return _clean(spark, sf_dir)[1].select("path", "defect_type", "part")


def split_counts(spark, sf_dir):
    return ops.counts_by(_clean(spark, sf_dir)[1], "defect_type", "part")


def manifest(spark, sf_dir):
    """The test manifest, with a mask for every defect file but the good ones."""
    held = _clean(spark, sf_dir)[1]
    masks = files(spark, sf_dir).where("defect_type <> 'good'").select("defect_type", "stem", F.concat(F.lit("ground_truth/"), "defect_type", F.lit("/"), "stem", F.lit("_mask.png")).alias("mask_path"))
    return ops.make_manifest(held, masks)


def missing_masks(spark, sf_dir):
    """Defect files without a mask, when every third file has none."""
    held = _clean(spark, sf_dir)[1]
    masks = files(spark, sf_dir).where("defect_type <> 'good' AND doc_id % 3 <> 0").select("defect_type", "stem", F.lit("m").alias("mask_path"))
    return ops.make_manifest(held, masks, strict=False).where("mask_path IS NULL").select("image_path", "defect_type")


def _prints(spark, sf_dir):
    rows = patches(spark, sf_dir).select("id", "part", (F.col("id") % 7).alias("product"), hamming.median_fingerprint(F.col("v")).alias("fingerprint"))
    return rows.where("part = 'bank'"), rows.where("part <> 'bank'")


def _with_copies(spark, sf_dir):
    """The fingerprints, and among the others a copy of each of the bank's with up to 15 bits flipped in a row."""
    bank, others = _prints(spark, sf_dir)
    shift = lambda n, by: F.call_function("shiftleft", n.cast("long"), by.cast("int"))
    flips = shift(shift(F.lit(1), F.col("id") % 16) - 1, F.col("id") % 48)
    copies = bank.select((F.col("id") + COPY_IDS).alias("id"), "part", "product", F.col("fingerprint").bitwiseXOR(flips).alias("fingerprint"))
    return bank, others.unionByName(copies)


COPY_IDS = 1_000_000_000


def near_dup_hamming(spark, sf_dir):
    return hamming.theta_join(*_prints(spark, sf_dir), 20, ["product"])


def near_dup_strict(spark, sf_dir):
    return hamming.banded_join(*_with_copies(spark, sf_dir), 4, ["product"])


def near_dup_blocked(spark, sf_dir):
    return hamming.indexed_join(*_with_copies(spark, sf_dir), 14, ["product"])


def near_dup_planned(spark, sf_dir):
    """Over all products together, by the way that the counts suggest."""
    return hamming.join(*_with_copies(spark, sf_dir), 8)


def near_dup_histogram(spark, sf_dir):
    return hamming.histogram(hamming.theta_join(*_prints(spark, sf_dir), 20, ["product"]))


def near_dup_examples(spark, sf_dir):
    return hamming.theta_join(*_prints(spark, sf_dir), 22, ["product"]).orderBy("distance", "left_id", "right_id").limit(20)


def near_dup_candidates(spark, sf_dir):
    """What the substring tables of ``near_dup_blocked`` find, and what of it is near, by product."""
    found = hamming.candidates(*_with_copies(spark, sf_dir), 14, ["product"])
    return found.groupBy("product").agg(F.count(F.lit(1)).alias("n_candidates"), F.count(F.when(F.col("distance") <= 14, 1)).alias("n_near"))


def duplicate_paths(spark, sf_dir):
    return ops.duplicate_paths(files(spark, sf_dir)).select("sha256", "chunk", F.concat_ws("|", "paths").alias("paths"))


GROUPS_SQL = f"""{FILES_SQL},
groups AS (SELECT sha256, count(*) AS n_files, count(DISTINCT product) AS n_products, min(path) AS first_path, bool_or(split = 'train') AS in_train, bool_or(split = 'test') AS in_test
           FROM files GROUP BY sha256 HAVING count(*) > 1)"""
CLEAN_SQL = f"""{FILES_SQL},
train AS (SELECT sha256, min(path) AS path FROM files WHERE split = 'train' GROUP BY sha256),
held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS rn FROM files WHERE split = 'test' AND sha256 NOT IN (SELECT sha256 FROM train)) WHERE rn = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY defect_type ORDER BY md5('42|' || path), path) AS rank, count(*) OVER (PARTITION BY defect_type) AS n FROM held),
parted AS (SELECT *, CASE WHEN n > 1 AND rank <= least(greatest(round_even(n * 0.5, 0), 1), n - 1) THEN 'validation' ELSE 'test' END AS part FROM ranked)"""
PRINTS_SQL = f"""{PATCHES_SQL},
mids AS (SELECT id, part, v, (list_sort(v)[32] + list_sort(v)[33]) / 2 AS mid FROM patches),
prints AS (SELECT id, part, list_transform(v, lambda x: (x > mid)::INT) AS bits FROM mids),
dists AS (SELECT a.id % 7 AS product, a.id AS left_id, b.id AS right_id, list_sum(list_transform(list_zip(a.bits, b.bits), lambda p: xor(p[1], p[2])))::INT AS distance
          FROM prints a JOIN prints b ON a.id % 7 = b.id % 7 WHERE a.part = 'bank' AND b.part <> 'bank')"""

COPIES_SQL = PRINTS_SQL[: PRINTS_SQL.index("dists AS")] + f"""
flipped AS (SELECT id + {COPY_IDS} AS id, 'copy' AS part, id % 7 AS product, list_transform(bits, lambda x, i: xor(x, (i - 1 >= id % 48 AND i - 1 < id % 48 + id % 16)::INT)) AS bits FROM prints WHERE part = 'bank'),
others AS (SELECT id, id % 7 AS product, bits FROM prints WHERE part <> 'bank' UNION ALL SELECT id, product, bits FROM flipped),
dists AS (SELECT a.id % 7 AS product, a.id AS left_id, b.id AS right_id, list_sum(list_transform(list_zip(a.bits, b.bits), lambda p: xor(p[1], p[2])))::INT AS distance,
                 list_transform(list_zip(a.bits, b.bits), lambda p: xor(p[1], p[2])) AS diff, b.product AS other FROM prints a, others b WHERE a.part = 'bank')"""

QUERIES = {
    "path_parts": (path_parts, f"""WITH {FILES_SQL} SELECT path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension,
lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.png', '.jpg', '.jpeg', '.bmp', '.tif', '.tiff') AS is_image, split, product, defect_type AS parent, stem, path AS relative FROM files"""),
    "count_images": (count_images, f"WITH {FILES_SQL} SELECT product, count(*) AS n_images FROM files WHERE NOT ends_with(path, '.txt') GROUP BY product"),
    "catalog_counts": (catalog_counts, f"WITH {FILES_SQL} SELECT product, split, defect_type, count(*) AS n FROM files WHERE NOT ends_with(path, '.txt') GROUP BY ROLLUP (product, split, defect_type)"),
    "split_pivot": (split_pivot, f"WITH {FILES_SQL} SELECT product, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM files GROUP BY product"),
    "attribute_counts": (attribute_counts, f"""WITH {FILES_SQL}, {IMAGES_SQL},
e AS (SELECT 'extension' AS attribute, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS value, count(*) AS n FROM files GROUP BY ALL),
r AS (SELECT 'resolution' AS attribute, width || 'x' || height AS value, count(*) AS n FROM imgs GROUP BY ALL ORDER BY n DESC, value LIMIT 20),
c AS (SELECT 'channels' AS attribute, CASE image_id % 5 WHEN 1 THEN 'Grayscale' WHEN 3 THEN 'RGB/BGR' WHEN 4 THEN 'RGBA/BGRA' ELSE 'Other' END AS value, count(*) AS n FROM imgs GROUP BY ALL)
FROM e UNION ALL FROM r UNION ALL FROM c"""),
    "exact_duplicate_groups": (exact_duplicate_groups, f"WITH {GROUPS_SQL} FROM groups"),
    # Groups above 1,000 paths are dealt over runs of about 500 by the first 8 digits of their paths' MD5.
    "duplicate_paths": (duplicate_paths, f"""WITH {FILES_SQL}, sized AS (SELECT sha256, path, count(*) OVER (PARTITION BY sha256) AS n FROM files),
dealt AS (SELECT sha256, path, (CASE WHEN n <= 1000 THEN 0 ELSE ('0x' || substr(md5(path), 1, 8))::BIGINT % ceil(n / 500)::BIGINT END)::INT AS chunk FROM sized WHERE n > 1)
SELECT sha256, chunk, string_agg(path, '|' ORDER BY path) AS paths FROM dealt GROUP BY sha256, chunk"""),
    "leakage_groups": (leakage_groups, f"WITH {GROUPS_SQL} FROM groups WHERE in_train AND in_test"),
    "cross_group_duplicates": (cross_group_duplicates, f"WITH {GROUPS_SQL} FROM groups WHERE n_products > 1"),
    "duplicate_summary": (duplicate_summary, f"WITH {GROUPS_SQL} SELECT count(*) AS n_groups, coalesce(sum(n_files), 0)::BIGINT AS n_files, count(*) FILTER (in_train AND in_test) AS n_leaked, count(*) FILTER (n_products > 1) AS n_cross_product FROM groups"),
    "canonical_rows": (canonical_rows, f"WITH {FILES_SQL} SELECT sha256, path, split, defect_type, n - 1 AS n_removed FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS rn, count(*) OVER (PARTITION BY sha256) AS n FROM files) WHERE rn = 1"),
    "leakage_anti_join": (leakage_anti_join, f"WITH {FILES_SQL} SELECT path, sha256 FROM files WHERE split = 'test' AND sha256 NOT IN (SELECT sha256 FROM files WHERE split = 'train')"),
    "leakage_sieved": (leakage_sieved, f"WITH {FILES_SQL} SELECT path, sha256 FROM files WHERE split = 'test' AND sha256 NOT IN (SELECT sha256 FROM files WHERE split = 'train')"),
    "leakage_examples": (leakage_examples, f"WITH {FILES_SQL} SELECT path, sha256 FROM files WHERE split = 'test' AND sha256 IN (SELECT sha256 FROM files WHERE split = 'train') ORDER BY path LIMIT 10"),
    "overlap_check": (overlap_check, f"""WITH {CLEAN_SQL}, parts AS (SELECT 'train' AS p, sha256 FROM train UNION ALL SELECT part, sha256 FROM parted),
names(l, r) AS (VALUES ('test', 'train'), ('test', 'validation'), ('train', 'validation'))
SELECT l AS "left", r AS "right", (SELECT count(*) FROM (SELECT sha256 FROM parts WHERE p = l INTERSECT SELECT sha256 FROM parts WHERE p = r)) AS n_shared FROM names"""),
    "raw_overlap": (raw_overlap, f"""WITH {FILES_SQL} SELECT 'test' AS "left", 'train' AS "right", (SELECT count(*) FROM (SELECT sha256 FROM files WHERE split = 'test' INTERSECT SELECT sha256 FROM files WHERE split = 'train')) AS n_shared"""),
    "stratified_split": (stratified_split, f"WITH {CLEAN_SQL} SELECT path, defect_type, part FROM parted"),
    "split_counts": (split_counts, f"WITH {CLEAN_SQL} SELECT defect_type, part, count(*) AS n FROM parted GROUP BY ALL"),
    "manifest": (manifest, f"""WITH {CLEAN_SQL} SELECT path AS image_path, CASE WHEN defect_type = 'good' THEN 0 ELSE 1 END AS label, defect_type,
CASE WHEN defect_type = 'good' THEN '' ELSE 'ground_truth/' || defect_type || '/' || stem || '_mask.png' END AS mask_path, sha256, split AS source_split FROM parted"""),
    "missing_masks": (missing_masks, f"WITH {CLEAN_SQL} SELECT path AS image_path, defect_type FROM parted WHERE defect_type <> 'good' AND doc_id % 3 = 0"),
    "near_dup_hamming": (near_dup_hamming, f"WITH {PRINTS_SQL} FROM dists WHERE distance <= 20"),
    "near_dup_strict": (near_dup_strict, f"WITH {COPIES_SQL} SELECT product, left_id, right_id, distance FROM dists WHERE distance <= 4 AND product = other"),
    "near_dup_blocked": (near_dup_blocked, f"WITH {COPIES_SQL} SELECT product, left_id, right_id, distance FROM dists WHERE distance <= 14 AND product = other"),
    "near_dup_planned": (near_dup_planned, f"WITH {COPIES_SQL} SELECT left_id, right_id, distance FROM dists WHERE distance <= 8"),
    "near_dup_candidates": (near_dup_candidates, f"""WITH {COPIES_SQL} SELECT product, count(*) AS n_candidates, count(*) FILTER (distance <= 14) AS n_near FROM dists
WHERE product = other AND (list_sum(diff[1:16]) <= 3 OR list_sum(diff[17:32]) <= 3 OR list_sum(diff[33:48]) <= 3 OR list_sum(diff[49:64]) <= 2) GROUP BY product"""),
    "near_dup_histogram": (near_dup_histogram, f"WITH {PRINTS_SQL} SELECT distance, count(*) AS n_pairs FROM dists WHERE distance <= 20 GROUP BY distance"),
    "near_dup_examples": (near_dup_examples, f"WITH {PRINTS_SQL} FROM dists WHERE distance <= 22 ORDER BY distance, left_id, right_id LIMIT 20"),
}
