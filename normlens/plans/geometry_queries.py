"""Queries over image sizes, grids and masks, and the streaming scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from normlens.functions.vectors import concat_features, dot, l2_normalize
from normlens.operators import errors, geometry, maps, scoring
from normlens.plans.bindings import FILES_SQL, GRID_SQL, IMAGES_SQL, LETTERBOX_SQL, PATCHES_SQL, grid, image_files, images, units
from normlens.session import table
from normlens.sources import pixels
from normlens.streaming import scorer

CELLS = pixels.CellStatistics(4)


def letterbox_geometry(spark, sf_dir):
    rows = geometry.letterbox(images(spark, sf_dir))
    return rows.select("image_id", F.round("scale", 9).alias("scale"), "new_width", "new_height", "pad_left", "pad_top")


def valid_cells(spark, sf_dir):
    rows = geometry.cells(geometry.letterbox(images(spark, sf_dir)))
    return rows.groupBy("image_id").agg(F.sum((F.col("valid_ratio") >= 0.5).cast("int")).alias("n_valid"), F.round(F.sum("valid_ratio"), 6).alias("area"))


def cell_ratios(spark, sf_dir):
    """Cells of 8 x 8 pixels: a ratio is a number of 64ths, which six decimals hold, so there is nothing to round."""
    boxes = geometry.letterbox(images(spark, sf_dir)).select("image_id", "new_width", "new_height", "pad_left", "pad_top")
    # Dealt out first: the table is small and in few splits, but each of its rows becomes hundreds.
    rows = geometry.valid_cells(boxes.repartition(4 * spark.sparkContext.defaultParallelism, "image_id"))
    return rows.select("image_id", "row", "col", "valid_ratio")


def _crop(spark, sf_dir):
    """Defect pixels before and after resizing the shorter side and cropping the centre, on the resized canvas."""
    rows = geometry.resize_shorter(images(spark, sf_dir))
    at = lambda c, of, new: F.floor(F.col(c) * F.col(new) / F.col(of)).cast("int")
    rows = rows.withColumns({"x": at("box_left", "width", "new_width"), "y": at("box_top", "height", "new_height"), "w": at("box_w", "width", "new_width"), "h": at("box_h", "height", "new_height")})
    box = (F.col("crop_left"), F.col("crop_top"), F.lit(224), F.lit(224))
    rows = rows.withColumns({"original_pixels": F.col("w") * F.col("h"), "cropped_pixels": geometry.overlap_area(F.col("x"), F.col("y"), F.col("w"), F.col("h"), box)})
    return geometry.retention(rows, "original_pixels", "cropped_pixels")


def crop_retention(spark, sf_dir):
    return _crop(spark, sf_dir).select("image_id", "defect_type", "original_pixels", "cropped_pixels", F.round("retention_ratio", 6).alias("retention_ratio"), F.round("loss_ratio", 6).alias("loss_ratio"), "fully_lost")


SUMMARY = ("mean_retention", "median_retention", "min_retention", "lost_rate")


def crop_audit_summary(spark, sf_dir):
    return geometry.retention_summary(_crop(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in SUMMARY})


def crop_audit_by_type(spark, sf_dir):
    return geometry.retention_summary(_crop(spark, sf_dir), ["defect_type"]).withColumns({c: F.round(c, 6) for c in SUMMARY})


def _mask_files(spark, sf_dir):
    """A manifest, and its mask files: grey netpbm images with a white rectangle, a quarter of the size on either side; every 29th is missing."""
    part = lambda c, k: F.floor(F.col(c) * k / 100).cast("int")
    p = F.col("image_id")
    rows = images(spark, sf_dir).select("image_id", "defect_type", F.floor(F.col("width") / 4).cast("int").alias("w"), F.floor(F.col("height") / 4).cast("int").alias("h"))
    rows = rows.withColumns({"left": part("w", p * 17 % 90), "top": part("h", p * 29 % 90), "across": part("w", p % 12), "down": part("h", p % 9)})
    black, white = (lambda n: F.repeat(F.lit("00"), n)), (lambda n: F.repeat(F.lit("FF"), n))
    line = F.concat(black(F.col("left")), white(F.col("across")), black(F.col("w") - F.col("left") - F.col("across")))
    body = F.concat(black(F.col("w") * F.col("top")), F.repeat(line, F.col("down")), black(F.col("w") * (F.col("h") - F.col("top") - F.col("down"))))
    head = F.concat(F.lit("P5\n"), F.col("w").cast("string"), F.lit(" "), F.col("h").cast("string"), F.lit("\n255\n")).cast("binary")
    path = F.concat_ws("/", F.lit("ground_truth"), "defect_type", F.concat(p.cast("string"), F.lit("_mask.pgm")))
    manifest = rows.select(p.cast("string").alias("image_path"), F.lit(1).alias("label"), path.alias("mask_path"))
    # Dealt out first: the table is small and in few splits, but its masks are large.
    dealt = rows.where(p % 29 != 0).repartition(4 * spark.sparkContext.defaultParallelism, "image_id")
    return manifest, dealt.select(path.alias("path"), F.concat(head, F.unhex(body)).alias("content"))


def mask_retention(spark, sf_dir):
    """Pixels of each mask file, letterboxed and cropped, and what share of the whole image's defect the crop keeps."""
    areas = pixels.file_areas(*_mask_files(spark, sf_dir))
    return areas.select(F.col("image_path").cast("long").alias("image_id"), *pixels.AREAS, ((F.col("original_pixels") > 0) & (F.col("cropped_pixels") == 0)).alias("fully_lost"))


def letterbox_audit_summary(spark, sf_dir):
    rows = geometry.letterbox(images(spark, sf_dir))
    scaled = lambda c: F.floor(F.col(c) * F.col("scale")).cast("int")
    rows = rows.withColumns({"original_pixels": F.col("box_w") * F.col("box_h"), "kept_pixels": scaled("box_w") * scaled("box_h")})
    rows = geometry.retention(rows, "original_pixels", "kept_pixels")
    return rows.groupBy("defect_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fully_lost").cast("int")).alias("n_lost"), F.round(F.avg(F.col("fully_lost").cast("double")), 6).alias("lost_rate"))


def recovered_cases(spark, sf_dir):
    """Recall, overall and by type, over the images whose defect the crop lost altogether."""
    lost = _crop(spark, sf_dir)
    scores = images(spark, sf_dir).select("image_id", "defect_type", F.lit(1).alias("y_true"), (F.pmod(F.col("image_id") * 31, F.lit(100)) / 100).alias("score"))
    rows = errors.with_errors(errors.recovered(scores, lost, ["image_id"]), 0.5)
    out = errors.overall_and_by_type(rows, "defect_type")
    return out.withColumns({"recall": F.round("recall", 6), "miss_rate": F.round("miss_rate", 6)})


def average_pool(spark, sf_dir):
    return geometry.average_pool(grid(spark, sf_dir), 2).withColumn("value", F.round("value", 6))


def strided_sample(spark, sf_dir):
    return geometry.strided(grid(spark, sf_dir)).withColumn("value", F.round("value", 6))


def bilinear_upsample(spark, sf_dir):
    return geometry.bilinear_upsample(grid(spark, sf_dir), 8, 2).withColumn("value", F.round("value", 6))


def min_max_normalize(spark, sf_dir):
    rows = geometry.min_max(grid(spark, sf_dir), "image_id", "value")
    return geometry.peak_scaled(rows, "image_id", "value", out="overlay").select("image_id", "row", "col", F.round("scaled", 6).alias("scaled"), F.round("overlay", 6).alias("overlay"))


def pixel_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 256).alias("pixel"))
    return rows.select("image_id", *[F.round(geometry.normalized_pixel(F.col("pixel"), c), 6).alias(f"c{c}") for c in range(3)])


def _anomaly_map(grids, size):
    """Patch values (one array an image) enlarged to a pixel map, scaled to its range; how much of each image is at or above half of it."""
    rows = maps.enlarge(grids, size, 4, digits=None)
    low, high = F.array_min("map"), F.array_max("map")
    # Rounded to six decimals it is 0.5 or more from here on; to round each pixel takes longer than all the rest.
    hot = F.expr("aggregate(map, 0L, (n, x) -> n + IF((x - low) / (high - low + 1e-8D) >= 0.4999995D, 1L, 0L))")
    return rows.withColumns({"low": low, "high": high}).select("image_id", hot.alias("n_hot"), F.round("high", 6).alias("peak"))


def anomaly_map(spark, sf_dir):
    """The grid of an embedding is its array, row by row, so nothing is exchanged."""
    rows = table(spark, sf_dir, "embeddings")
    return _anomaly_map(rows.select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("grid")), 8)


def pair_anomaly_map(spark, sf_dir):
    """Each image against one reference: 1 - best similarity of its 4 x 4 patches to the reference's, enlarged to a map.

    The reference is one image of 16 patches, so its side of the join is of a fixed size."""
    rows = table(spark, sf_dir, "embeddings")
    patch = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.struct(k.alias("cell"), l2_normalize(F.slice("embedding", k * 4 + 1, F.lit(4))).alias("v")))
    cells = rows.select(F.col("vec_id").alias("image_id"), F.inline(patch))
    first = rows.orderBy("vec_id").limit(1).select(patch.alias("patches"))
    best = F.array_max(F.transform("patches", lambda p: F.round(dot(F.col("v"), p["v"]), 9)))
    scored = cells.join(F.broadcast(first)).select("image_id", "cell", (1 - best).alias("value"))
    return _anomaly_map(maps.collect_grid(scored, ("image_id",), value="value"), 4)


def patch_positions(spark, sf_dir):
    """Row and column of each patch number, and the length of two layers' descriptors together."""
    rows = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("patch", "x"), "vec_id", "embedding")
    row, col = geometry.row_col(F.col("patch"), 8)
    return rows.select("vec_id", "patch", row.alias("row"), col.alias("col"), F.size(concat_features(F.col("embedding"), F.col("embedding"))).alias("dims"))


def formatted_report(spark, sf_dir):
    rows = geometry.letterbox(images(spark, sf_dir))
    return rows.select("image_id", F.format_string("%.4f", F.round("scale", 4)).alias("scale"), F.format_string("%.6f", F.col("width").cast("double")).alias("width"))


def missed_recovered(spark, sf_dir):
    """Of the images whose defect the crop lost, the 20 missed ones with the lowest scores, ascending."""
    lost = _crop(spark, sf_dir)
    scores = images(spark, sf_dir).select("image_id", "defect_type", F.lit(1).alias("y_true"), (F.pmod(F.col("image_id") * 31, F.lit(100)) / 100).alias("score"))
    rows = errors.with_errors(errors.recovered(scores, lost, ["image_id"]), 0.5)
    return errors.worst(rows, "FN", 20, "image_id").select("image_id", "defect_type", "score")


def lost_examples(spark, sf_dir):
    """The first 20 images whose defect the crop lost altogether."""
    return _crop(spark, sf_dir).where("fully_lost").orderBy("image_id").limit(20).select("image_id", "defect_type", "original_pixels")


def image_attributes(spark, sf_dir):
    """Size of each image file, by decoding it, or that it is corrupt."""
    return pixels.attributes(image_files(spark, sf_dir))


def corrupt_examples(spark, sf_dir):
    return pixels.attributes(image_files(spark, sf_dir)).where("corrupt").orderBy("path").limit(20).select("path")


def image_hashes(spark, sf_dir):
    return pixels.fingerprints(image_files(spark, sf_dir))


def _image_bank(spark, sf_dir):
    good = image_files(spark, sf_dir).where("split = 'train' AND defect_type = 'good'")
    rows = pixels.extract_patches(good, CELLS, 4).where("error IS NULL")
    return rows.select(F.xxhash64("path", "patch").alias("id"), l2_normalize(F.col("v")).alias("v"))


def image_file_scores(spark, sf_dir):
    """From image files to scores: decoded, letterboxed, described by cells, and held against the normal ones' cells."""
    rows = pixels.extract_patches(image_files(spark, sf_dir).where("split = 'test'"), CELLS, 4).where("error IS NULL")
    queries = rows.select(F.col("patch").cast("long").alias("id"), F.col("path").alias("image_id"), l2_normalize(F.col("v")).alias("v"))
    scored = scoring.image_scores(scoring.patch_scores(queries, _image_bank(spark, sf_dir)))
    return scored.select(F.col("image_id").alias("path"), F.round("score", 6).alias("score"), "n_patches")


def predict_requests(spark, sf_dir):
    """Uploads of all kinds and the status that each gets."""
    kind = F.when(F.col("doc_id") % 17 == 0, F.lit(None)).when(F.col("doc_id") % 17 == 1, "text/plain").otherwise("image/x-portable-graymap")
    content = F.when(F.col("doc_id") % 19 == 0, F.lit("").cast("binary")).when(F.col("doc_id") % 19 == 1, F.lit(None)).otherwise(F.col("content"))
    rows = image_files(spark, sf_dir).where("split = 'test'").select(F.col("doc_id").alias("request_id"), kind.alias("content_type"), content.alias("content"))
    return scorer.predict(rows, _image_bank(spark, sf_dir), 0.2, CELLS, 4).select("request_id", "status", "detail", (F.col("prediction").isNotNull()).alias("has_prediction"))


def service_health(spark, sf_dir):
    return scorer.health(units(spark, sf_dir).where("part = 'bank'"), 1.1)


def streaming_scores(spark, sf_dir):
    return scorer.score_table_as_stream(spark, sf_dir)


# Pixels are the texts' bytes; rows shrink or grow to 32 with a Lanczos filter of reach 3, then come 8 x 8 cosine coefficients.
HASH_SQL = f"""{FILES_SQL},
raw AS (SELECT f.doc_id, f.path, greatest(1, f.n_bytes // 32)::INT AS h, regexp_extract_all(hex(encode(d.text)) || repeat('20', 32), '..') AS b
        FROM files f JOIN documents d USING (doc_id) WHERE doc_id % 23 <> 0),
bytes AS (SELECT doc_id, path, h, unnest(b) AS b, unnest(range(len(b))) AS i FROM raw),
grey AS (SELECT doc_id, path, h, (i // 32)::INT AS y, (i % 32)::INT AS x, ('0x' || b)::INT AS v FROM bytes WHERE i < h * 32),
centres AS (SELECT h, t::INT AS t, (t + 0.5::DOUBLE) * h / 32 AS c, greatest(1.0::DOUBLE, h / 32) AS wide FROM (SELECT DISTINCT h FROM raw), range(32) r(t)),
taps AS (SELECT h, t, c, wide, unnest(range(greatest(0, floor(c - 3 * wide + 0.5))::INT, least(h, floor(c + 3 * wide + 0.5))::INT))::INT AS s FROM centres),
bells AS (SELECT h, t, s, abs((s + 0.5::DOUBLE - c) / wide) * pi() AS a FROM taps),
kernel AS (SELECT h, t, s, CASE WHEN a = 0 THEN 1.0 WHEN a < 3 * pi() THEN sin(a) / a * sin(a / 3) / (a / 3) ELSE 0.0 END AS w FROM bells),
weights AS (SELECT h, t, s, w / sum(w) OVER (PARTITION BY h, t) AS w FROM kernel),
small AS (SELECT path, t, x, least(255, greatest(0, floor(round(sum(w * v), 9) + 0.5))) AS v FROM grey JOIN weights ON weights.h = grey.h AND s = y GROUP BY path, t, x),
across AS (SELECT path, t, k AS e, sum(v * cos(pi() * k * (2 * x + 1) / 64)) AS v FROM small, range(8) r(k) GROUP BY ALL),
low AS (SELECT path, k * 8 + e AS i, round(sum(v * cos(pi() * k * (2 * t + 1) / 64)), 6) AS v FROM across, range(8) r(k) GROUP BY ALL),
halves AS (SELECT path, i, v > median(v) OVER (PARTITION BY path) AS bit FROM low),
prints AS (SELECT path AS id, sum(CASE WHEN bit THEN 1::HUGEINT << (63 - i)::INT ELSE 0 END)::HUGEINT AS n FROM halves GROUP BY path)"""
CROP_SQL = f"""{IMAGES_SQL},
resized AS (SELECT *, CASE WHEN width <= height THEN 256 ELSE floor(256 * width / height)::INT END AS nw, CASE WHEN width <= height THEN floor(256 * height / width)::INT ELSE 256 END AS nh FROM imgs),
corners AS (SELECT *, round_even((nw - 224) / 2.0, 0)::INT AS cl, round_even((nh - 224) / 2.0, 0)::INT AS ct, floor(box_left * nw / width)::INT AS x, floor(box_top * nh / height)::INT AS y,
                   floor(box_w * nw / width)::INT AS w, floor(box_h * nh / height)::INT AS h FROM resized),
areas AS (SELECT *, w * h AS original_pixels, greatest(0, least(x + w, cl + 224) - greatest(x, cl)) * greatest(0, least(y + h, ct + 224) - greatest(y, ct)) AS cropped_pixels FROM corners),
crops AS (SELECT *, CASE WHEN original_pixels > 0 THEN cropped_pixels / original_pixels ELSE 0.0::DOUBLE END AS retention_ratio, original_pixels > 0 AND cropped_pixels = 0 AS fully_lost FROM areas)"""
SUMMARY_SQL = """count(*) AS n, count(*) FILTER (fully_lost) AS n_lost, count(*) FILTER (retention_ratio < 0.9) AS n_below_90, count(*) FILTER (retention_ratio < 0.5) AS n_below_50,
round(avg(retention_ratio), 6) AS mean_retention, round(median(retention_ratio), 6) AS median_retention, round(min(retention_ratio), 6) AS min_retention, round(avg(fully_lost::INT), 6) AS lost_rate"""
CELLS_SQL = f"""{LETTERBOX_SQL},
cells AS (SELECT image_id, r::INT AS "row", c::INT AS col,
                 greatest(0, least((r + 1) * 8, pad_top + new_height) - greatest(r * 8, pad_top)) * greatest(0, least((c + 1) * 8, pad_left + new_width) - greatest(c * 8, pad_left)) / 64.0::DOUBLE AS valid_ratio
          FROM boxed, range(32) a(r), range(32) b(c))"""
# Places in the source grid are clamped to its border, so that border cells repeat.
UPSAMPLE_SQL = f"""WITH {GRID_SQL},
axis AS (SELECT t::INT AS t, s::INT AS s, greatest(0.0, 1 - abs(greatest(0.0, least(7.0, (t + 0.5) / 2 - 0.5)) - s)) AS w FROM range(16) a(t), range(8) b(s)),
used AS (SELECT * FROM axis WHERE w > 0)
SELECT image_id, r.t AS "row", c.t AS col, round(sum(r.w * c.w * value), 6) AS value FROM grid JOIN used r ON r.s = grid."row" JOIN used c ON c.s = grid.col GROUP BY ALL"""

# Nearest pixels go by axis, so a rectangle's pixels are those of its columns times those of its rows.
MASKS_SQL = f"""{IMAGES_SQL},
small AS (SELECT image_id, width // 4 AS w, height // 4 AS h FROM imgs),
rects AS (SELECT *, floor(w * (image_id * 17 % 90) / 100)::INT AS l, floor(h * (image_id * 29 % 90) / 100)::INT AS t, floor(w * (image_id % 12) / 100)::INT AS across, floor(h * (image_id % 9) / 100)::INT AS down FROM small),
sized AS (SELECT *, greatest(1, round_even(w * least(256.0::DOUBLE / w, 256.0::DOUBLE / h), 0)::INT) AS bw, greatest(1, round_even(h * least(256.0::DOUBLE / w, 256.0::DOUBLE / h), 0)::INT) AS bh,
                 CASE WHEN w <= h THEN 256 ELSE 256 * w // h END AS cw, CASE WHEN w <= h THEN 256 * h // w ELSE 256 END AS ch FROM rects),
cornered AS (SELECT *, round_even((cw - 224) / 2, 0)::INT AS cl, round_even((ch - 224) / 2, 0)::INT AS ct FROM sized),
counted AS (SELECT image_id, across * down AS original_pixels,
                   len(list_filter(range(0, bw), lambda i: floor((i + 0.5) * w / bw) >= l AND floor((i + 0.5) * w / bw) < l + across)) * len(list_filter(range(0, bh), lambda i: floor((i + 0.5) * h / bh) >= t AND floor((i + 0.5) * h / bh) < t + down)) AS letterboxed_pixels,
                   len(list_filter(range(cl, cl + 224), lambda i: floor((i + 0.5) * w / cw) >= l AND floor((i + 0.5) * w / cw) < l + across)) * len(list_filter(range(ct, ct + 224), lambda i: floor((i + 0.5) * h / ch) >= t AND floor((i + 0.5) * h / ch) < t + down)) AS cropped_pixels
            FROM cornered)"""

QUERIES = {
    "letterbox_geometry": (letterbox_geometry, f"WITH {LETTERBOX_SQL} SELECT image_id, round(scale, 9) AS scale, new_width, new_height, pad_left, pad_top FROM boxed"),
    "valid_cells": (valid_cells, f"WITH {CELLS_SQL} SELECT image_id, count(*) FILTER (valid_ratio >= 0.5) AS n_valid, round(sum(valid_ratio), 6) AS area FROM cells GROUP BY image_id"),
    "cell_ratios": (cell_ratios, f'WITH {CELLS_SQL} SELECT image_id, "row", col, round(valid_ratio, 6) AS valid_ratio FROM cells WHERE valid_ratio >= 0.5'),
    "crop_retention": (crop_retention, f"WITH {CROP_SQL} SELECT image_id, defect_type, original_pixels, cropped_pixels, round(retention_ratio, 6) AS retention_ratio, round(1 - retention_ratio, 6) AS loss_ratio, fully_lost FROM crops"),
    "crop_audit_summary": (crop_audit_summary, f"WITH {CROP_SQL} SELECT {SUMMARY_SQL} FROM crops"),
    "crop_audit_by_type": (crop_audit_by_type, f"WITH {CROP_SQL} SELECT defect_type, {SUMMARY_SQL} FROM crops GROUP BY defect_type"),
    "letterbox_audit_summary": (letterbox_audit_summary, f"""WITH {LETTERBOX_SQL}, kept AS (SELECT *, box_w * box_h AS o, floor(box_w * scale)::INT * floor(box_h * scale)::INT AS k FROM boxed)
SELECT defect_type, count(*) AS n, count(*) FILTER (o > 0 AND k = 0) AS n_lost, round(avg((o > 0 AND k = 0)::INT), 6) AS lost_rate FROM kept GROUP BY defect_type"""),
    "mask_retention": (mask_retention, f"""WITH {MASKS_SQL} SELECT image_id, CASE WHEN image_id % 29 <> 0 THEN original_pixels END::BIGINT AS original_pixels, CASE WHEN image_id % 29 <> 0 THEN letterboxed_pixels END::BIGINT AS letterboxed_pixels,
CASE WHEN image_id % 29 <> 0 THEN cropped_pixels END::BIGINT AS cropped_pixels, CASE WHEN image_id % 29 <> 0 THEN original_pixels > 0 AND cropped_pixels = 0 END AS fully_lost FROM counted"""),
    "recovered_cases": (recovered_cases, f"""WITH {CROP_SQL}, s AS (SELECT defect_type, ((image_id * 31) % 100) / 100.0::DOUBLE >= 0.5 AS hit FROM crops WHERE fully_lost),
g AS (SELECT defect_type, hit FROM s UNION ALL SELECT '(all)', hit FROM s)
SELECT defect_type, count(*) AS total, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn, round(avg(hit::INT), 6) AS recall, round(avg((NOT hit)::INT), 6) AS miss_rate FROM g GROUP BY defect_type"""),
    "avg_pool": (average_pool, f'WITH {GRID_SQL} SELECT image_id, ("row" // 2)::INT AS "row", (col // 2)::INT AS col, round(avg(value), 6) AS value FROM grid GROUP BY ALL'),
    "strided_sample": (strided_sample, f'WITH {GRID_SQL} SELECT image_id, "row", col, round(value, 6) AS value FROM grid WHERE "row" % 2 = 0 AND col % 2 = 0'),
    "bilinear_upsample": (bilinear_upsample, UPSAMPLE_SQL),
    "min_max_normalize": (min_max_normalize, f"""WITH {GRID_SQL}, e AS (SELECT *, value - min(value) OVER w AS low, max(value) OVER w - min(value) OVER w AS span FROM grid WINDOW w AS (PARTITION BY image_id))
SELECT image_id, "row", col, round(low / (span + 1e-8), 6) AS scaled, round(low / (span + 1e-8), 6) AS overlay FROM e"""),
    "pixel_normalize": (pixel_normalize, "SELECT p_partkey AS image_id, round(((p_partkey % 256) / 255.0::DOUBLE - 0.485) / 0.229, 6) AS c0, round(((p_partkey % 256) / 255.0::DOUBLE - 0.456) / 0.224, 6) AS c1, round(((p_partkey % 256) / 255.0::DOUBLE - 0.406) / 0.225, 6) AS c2 FROM part"),
    "anomaly_map": (anomaly_map, f"""WITH {GRID_SQL},
axis AS (SELECT t::INT AS t, s::INT AS s, greatest(0.0, 1 - abs(greatest(0.0, least(7.0, (t + 0.5) / 4 - 0.5)) - s)) AS w FROM range(32) a(t), range(8) b(s)),
used AS (SELECT * FROM axis WHERE w > 0),
pixels AS (SELECT image_id, r.t AS y, c.t AS x, sum(r.w * c.w * value) AS value FROM grid JOIN used r ON r.s = grid."row" JOIN used c ON c.s = grid.col GROUP BY ALL),
scaled AS (SELECT image_id, value, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-8), 6) AS scaled FROM pixels WINDOW w AS (PARTITION BY image_id))
SELECT image_id, count(*) FILTER (scaled >= 0.5) AS n_hot, round(max(value), 6) AS peak FROM scaled GROUP BY image_id"""),
    "patch_positions": (patch_positions, "SELECT vec_id, (i - 1)::INT AS patch, ((i - 1) // 8)::INT AS row, ((i - 1) % 8)::INT AS col, 2 * len(embedding) AS dims FROM embeddings, range(1, 65) t(i)"),
    "formatted_report": (formatted_report, f"WITH {LETTERBOX_SQL} SELECT image_id, printf('%.4f', round(scale, 4)) AS scale, printf('%.6f', width::DOUBLE) AS width FROM boxed"),
    "pair_anomaly_map": (pair_anomaly_map, f"""WITH raw AS (SELECT vec_id AS image_id, k::INT AS cell, list_transform(embedding[k * 4 + 1:k * 4 + 4], lambda x: x::DOUBLE) AS v FROM embeddings, range(16) t(k)),
unit AS (SELECT image_id, cell, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS v FROM raw),
grid AS (SELECT a.image_id, (a.cell // 4)::INT AS "row", (a.cell % 4)::INT AS col, 1 - max(round(list_inner_product(a.v, b.v), 9)) AS value
         FROM unit a, unit b WHERE b.image_id = (SELECT min(vec_id) FROM embeddings) GROUP BY ALL),
axis AS (SELECT t::INT AS t, s::INT AS s, greatest(0.0, 1 - abs(greatest(0.0, least(3.0, (t + 0.5) / 4 - 0.5)) - s)) AS w FROM range(16) a(t), range(4) b(s)),
used AS (SELECT * FROM axis WHERE w > 0),
pixels AS (SELECT image_id, r.t AS y, c.t AS x, sum(r.w * c.w * value) AS value FROM grid JOIN used r ON r.s = grid."row" JOIN used c ON c.s = grid.col GROUP BY ALL),
scaled AS (SELECT image_id, value, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-8), 6) AS scaled FROM pixels WINDOW w AS (PARTITION BY image_id))
SELECT image_id, count(*) FILTER (scaled >= 0.5) AS n_hot, round(max(value), 6) AS peak FROM scaled GROUP BY image_id"""),
    "missed_recovered": (missed_recovered, f"WITH {CROP_SQL} SELECT image_id, defect_type, ((image_id * 31) % 100) / 100.0::DOUBLE AS score FROM crops WHERE fully_lost AND ((image_id * 31) % 100) / 100.0::DOUBLE < 0.5 ORDER BY score, image_id LIMIT 20"),
    "lost_examples": (lost_examples, f"WITH {CROP_SQL} SELECT image_id, defect_type, original_pixels FROM crops WHERE fully_lost ORDER BY image_id LIMIT 20"),
    "image_attributes": (image_attributes, f"WITH {FILES_SQL} SELECT path, CASE WHEN doc_id % 23 <> 0 THEN 32 END AS width, CASE WHEN doc_id % 23 <> 0 THEN greatest(1, n_bytes // 32)::INT END AS height, doc_id % 23 = 0 AS corrupt FROM files"),
    "corrupt_examples": (corrupt_examples, f"WITH {FILES_SQL} SELECT path FROM files WHERE doc_id % 23 = 0 ORDER BY path LIMIT 20"),
    "image_hashes": (image_hashes, f"WITH {HASH_SQL} SELECT id, (CASE WHEN n >= 1::HUGEINT << 63 THEN n - (1::HUGEINT << 64) ELSE n END)::BIGINT AS fingerprint FROM prints"),
    "image_file_scores": (image_file_scores, None),
    # A patch is valid if the letterboxed image covers half of some cell of 64 x 64 pixels.
    "predict_requests": (predict_requests, f"""WITH {FILES_SQL}, tall AS (SELECT *, greatest(1, n_bytes // 32) AS h FROM files WHERE split = 'test'),
fitted AS (SELECT *, greatest(1, round_even(32 * least(8.0::DOUBLE, 256.0::DOUBLE / h), 0)::INT) AS nw, greatest(1, round_even(h * least(8.0::DOUBLE, 256.0::DOUBLE / h), 0)::INT) AS nh FROM tall),
covered AS (SELECT *, list_max(list_transform([0, 64, 128, 192], lambda a: greatest(0, least(a + 64, (256 - nw) // 2 + nw) - greatest(a, (256 - nw) // 2)))) *
                      list_max(list_transform([0, 64, 128, 192], lambda a: greatest(0, least(a + 64, (256 - nh) // 2 + nh) - greatest(a, (256 - nh) // 2)))) AS most FROM fitted),
kinds AS (SELECT doc_id AS request_id, CASE WHEN doc_id % 17 < 2 THEN 'not an image' WHEN doc_id % 19 < 2 THEN 'empty' WHEN doc_id % 23 = 0 THEN 'undecodable'
                 WHEN most < 2048 THEN 'failed: no valid patch' ELSE '' END AS detail FROM covered)
SELECT request_id, CASE WHEN detail = '' THEN 200 WHEN detail LIKE 'failed%' THEN 500 ELSE 400 END AS status, detail, detail = '' AS has_prediction FROM kinds"""),
    "service_health": (service_health, f"WITH {PATCHES_SQL} SELECT 'ok' AS status, 200 AS code, 'cpu' AS device, TRUE AS model_loaded, count(*) AS coreset_size, max(len(v))::INT AS dims, 1.1::DOUBLE AS threshold FROM units WHERE part = 'bank'"),
    "streaming_scores": (streaming_scores, f"""WITH {PATCHES_SQL}, best AS (SELECT q.id, max(round(list_inner_product(q.v, b.v), 9)) AS s FROM units q, units b WHERE b.part = 'bank' GROUP BY q.id),
away AS (SELECT id, sqrt(greatest(2 - 2 * s, 0)) AS d FROM best)
SELECT id AS request_id, 200 AS status, CASE WHEN d >= 1.1 THEN 'defect' ELSE 'good' END AS prediction, round(d, 6) AS anomaly_score, 1.1::DOUBLE AS threshold FROM away"""),
}
