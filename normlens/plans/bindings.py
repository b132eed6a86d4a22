"""How the test tables stand in for image data, on both sides: DataFrames here, SQL fragments beside them.

Patches are embeddings, files are documents, scores are events, image sizes derive from part keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.functions.vectors import as_double, l2_normalize
from normlens.session import table

BANK_LABELS = (0, 1, 2)
IMAGE_IDS = 50
LABEL_STEP = 10_000_000_000


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, v (doubles), label, ordinal, image_id, defect_type, normal, part (bank, validation, test).

    Fifty neighbouring ids hold one image of each label, of about five patches: a projection, without any exchange."""
    rows = table(spark, sf_dir, "embeddings")
    normal = F.col("label").isin(*BANK_LABELS)
    out = rows.select(
        F.col("vec_id").alias("id"),
        as_double(F.col("embedding")).alias("v"),
        "label",
        F.floor(F.col("vec_id") / IMAGE_IDS).cast("long").alias("ordinal"),
    ).withColumns(
        {
            "image_id": F.col("label").cast("long") * LABEL_STEP + F.col("ordinal"),
            "normal": normal,
            "defect_type": F.when(normal, "good").otherwise(F.concat(F.lit("type_"), F.col("label").cast("string"))),
        }
    )
    part = F.when(normal & (F.col("ordinal") % 2 == 0), "bank").when(F.col("ordinal") % 4 < 2, "validation").otherwise("test")
    return out.withColumn("part", part)


PATCHES_SQL = f"""
ordered AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label, (vec_id // {IMAGE_IDS})::BIGINT AS ordinal FROM embeddings),
patches AS (SELECT *, label::BIGINT * {LABEL_STEP} + ordinal AS image_id, label IN (0, 1, 2) AS normal,
                   CASE WHEN label IN (0, 1, 2) THEN 'good' ELSE 'type_' || label END AS defect_type,
                   CASE WHEN label IN (0, 1, 2) AND ordinal % 2 = 0 THEN 'bank' WHEN ordinal % 4 < 2 THEN 'validation' ELSE 'test' END AS part
            FROM ordered),
units AS (SELECT * REPLACE (list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS v) FROM patches)"""

# Nearest bank vector of each query patch; similarities are rounded before they are compared.
NEAREST_SQL = f"""{PATCHES_SQL},
pairs AS (SELECT q.id, q.image_id, q.defect_type, q.normal, q.part, q.label, b.id AS bank_id, round(list_inner_product(q.v, b.v), 9) AS similarity
          FROM units q, units b WHERE q.part <> 'bank' AND b.part = 'bank'),
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, bank_id) AS place FROM pairs) WHERE place = 1),
distances AS (SELECT *, sqrt(greatest(2 - 2 * similarity, 0)) AS distance FROM nearest),
images AS (SELECT image_id, defect_type, part, CASE WHEN normal THEN 0 ELSE 1 END AS y_true, max(distance) AS score, count(*) AS n_patches
           FROM distances GROUP BY ALL)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches(spark, sf_dir).withColumn("v", l2_normalize(F.col("v")))


def files(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """A catalog: path, product (source), split, defect_type, stem, sha256 of the text's bytes, n_bytes; with the bytes (raw) if ``content``."""
    docs = table(spark, sf_dir, "documents")
    split = F.when(F.col("doc_id") % 10 < 6, "train").otherwise("test")
    kind = F.when(F.col("doc_id") % 10 < 6, "good").when(F.col("doc_id") % 10 == 6, "good").otherwise(F.concat(F.lit("type_"), (F.col("doc_id") % 7).cast("string")))
    stem = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    out = docs.select("doc_id", F.col("source").alias("product"), split.alias("split"), kind.alias("defect_type"), stem.alias("stem"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"), "lang", *([F.coalesce("text", F.lit("")).cast("binary").alias("raw")] if content else []))
    suffix = F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))
    return out.withColumn("path", F.concat_ws("/", "product", "split", "defect_type", F.concat("stem", suffix)))


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with contents: grey netpbm images 32 pixels wide, of the texts' bytes; every 23rd is broken."""
    rows = files(spark, sf_dir, content=True)
    height = F.greatest(F.lit(1), F.floor(F.length("raw") / 32)).cast("string")
    head = F.concat(F.lit("P5\n32 "), height, F.lit("\n255\n")).cast("binary")
    content = F.when(F.col("doc_id") % 23 == 0, F.lit("P5 broken").cast("binary")).otherwise(F.concat(head, F.col("raw"), F.repeat(F.lit(" "), 32).cast("binary")))
    return rows.withColumn("content", content).drop("raw")


SUFFIXES = (".png", ".JPG", ".jpeg", ".bmp", ".tif", ".tiff", ".txt")

FILES_SQL = """
base AS (SELECT doc_id, source AS product, CASE WHEN doc_id % 10 < 6 THEN 'train' ELSE 'test' END AS split,
                CASE WHEN doc_id % 10 <= 6 THEN 'good' ELSE 'type_' || (doc_id % 7) END AS defect_type,
                lpad(doc_id::VARCHAR, 8, '0') AS stem, sha256(text) AS sha256, strlen(text)::BIGINT AS n_bytes, lang FROM documents),
files AS (SELECT *, product || '/' || split || '/' || defect_type || '/' || stem ||
                 ['.png', '.JPG', '.jpeg', '.bmp', '.tif', '.tiff', '.txt'][(doc_id % 7 + 1)::INT] AS path FROM base)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, group (user_id % 7), y_true, score."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", (F.col("user_id") % 7).alias("grp"), (F.col("event_type") == "error").cast("int").alias("y_true"), F.col("value").alias("score"))


SCORES_SQL = "scores AS (SELECT event_id, user_id % 7 AS grp, (event_type = 'error')::INT AS y_true, value AS score FROM events)"
# Cumulative counts at each distinct score.
CURVE_SQL = f"""{SCORES_SQL},
bins AS (SELECT score, sum(y_true)::BIGINT AS pos, (count(*) - sum(y_true))::BIGINT AS neg FROM scores WHERE score IS NOT NULL GROUP BY score),
curve AS (SELECT score, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, (sum(pos) OVER ())::BIGINT AS n_pos, (sum(neg) OVER ())::BIGINT AS n_neg
          FROM bins WINDOW w AS (ORDER BY score DESC)),
points AS (SELECT score AS threshold, tp / (tp + fp) AS "precision", CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 0.0 END AS recall FROM curve)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.col("event_type").alias("stage"), F.col("value").alias("ms"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sizes with a defect rectangle (left, top, w, h) inside, from part keys."""
    p = F.col("p_partkey")
    out = table(spark, sf_dir, "part").select(
        p.alias("image_id"),
        F.concat(F.lit("type_"), (p % 5).cast("string")).alias("defect_type"),
        (64 + F.pmod(p * 37, F.lit(1200))).cast("int").alias("width"),
        (64 + F.pmod(p * 53, F.lit(900))).cast("int").alias("height"),
    )
    part = lambda c, k: F.floor(F.col(c) * k / 100).cast("int")
    return out.withColumns(
        {
            "box_left": part("width", F.col("image_id") * 17 % 90),
            "box_top": part("height", F.col("image_id") * 29 % 90),
            "box_w": F.greatest(F.lit(0), part("width", F.col("image_id") % 12) - 1),
            "box_h": F.greatest(F.lit(0), part("height", F.col("image_id") % 9)),
        }
    )


IMAGES_SQL = """
sizes AS (SELECT p_partkey AS image_id, 'type_' || (p_partkey % 5) AS defect_type,
                 (64 + (p_partkey * 37) % 1200)::INT AS width, (64 + (p_partkey * 53) % 900)::INT AS height FROM part),
imgs AS (SELECT *, floor(width * (image_id * 17 % 90) / 100)::INT AS box_left, floor(height * (image_id * 29 % 90) / 100)::INT AS box_top,
                greatest(0, floor(width * (image_id % 12) / 100)::INT - 1) AS box_w, greatest(0, floor(height * (image_id % 9) / 100)::INT) AS box_h FROM sizes)"""
LETTERBOX_SQL = f"""{IMAGES_SQL},
scaled AS (SELECT *, least(256.0::DOUBLE / width, 256.0::DOUBLE / height) AS scale FROM imgs),
fitted AS (SELECT *, greatest(1, round_even(width * scale, 0)::INT) AS new_width, greatest(1, round_even(height * scale, 0)::INT) AS new_height FROM scaled),
boxed AS (SELECT *, ((256 - new_width) // 2)::INT AS pad_left, ((256 - new_height) // 2)::INT AS pad_top FROM fitted)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 grid of values for each embedding."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "x"))
    return rows.select("image_id", F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).cast("int").alias("col"), F.col("x").cast("double").alias("value"))


GRID_SQL = """
grid AS (SELECT vec_id AS image_id, ((i - 1) // 8)::INT AS "row", ((i - 1) % 8)::INT AS col, embedding[i]::DOUBLE AS value
         FROM embeddings, range(1, 65) t(i))"""
