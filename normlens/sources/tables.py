"""Typed readers and sinks for manifests, scores, audits, vectors and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The column sets of the CSV formats.
MANIFEST = "image_path STRING, label INT, defect_type STRING, mask_path STRING, sha256 STRING, source_split STRING"
SCORES = "image_path STRING, defect_type STRING, true_label INT, score DOUBLE, valid_patches INT"
ERRORS = "image_path STRING, defect_type STRING, true_label INT, score DOUBLE, predicted_label INT, error_type STRING"
CROP_AUDIT = (
    "defect_type STRING, image_name STRING, original_width INT, original_height INT, original_defect_pixels INT, "
    "cropped_defect_pixels INT, retention_ratio DOUBLE, loss_ratio DOUBLE, fully_lost STRING"
)
NEAR_DUPLICATES = "product STRING, train_image STRING, test_image STRING, phash_distance INT"
LATENCY = "image_path STRING, label INT, defect_type STRING, score DOUBLE, preprocessing_ms DOUBLE, feature_ms DOUBLE, patch_ms DOUBLE, search_ms DOUBLE, total_ms DOUBLE, valid_patches INT"


def text_flag(c: Column) -> Column:
    """Whether a text says true, 1 or yes, in any case and with spaces around."""
    return F.lower(F.trim(c)).isin("true", "1", "yes")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str, root: str = "", limit: int | None = None) -> DataFrame:
    """image_path (below ``root``), label, defect_type, sha256; at most ``limit`` rows, by path."""
    rows = read_csv(spark, path, MANIFEST).select("image_path", "label", "defect_type", "sha256")
    if root:
        rows = rows.withColumn("image_path", F.concat(F.lit(root.rstrip("/") + "/"), "image_path"))
    return rows if limit is None else rows.orderBy("image_path").limit(limit)


def read_crop_audit(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CROP_AUDIT).withColumn("fully_lost", text_flag(F.col("fully_lost")))


def write_csv(rows: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """CSV with a header; the columns of ``decimals`` are written with so many places."""
    fixed = {c: F.format_string(f"%.{n}f", F.col(c).cast("double")) for c, n in (decimals or {}).items()}
    rows.withColumns(fixed).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_threshold(spark: SparkSession, path: str, field: str = "threshold_selection.selected_threshold") -> float:
    """A number in a nested JSON report; an error names the field if it is not there."""
    rows = spark.read.option("multiLine", True).json(path)
    try:
        value = rows.select(F.col(field).cast("double")).first()
    except Exception as error:
        raise ValueError(f"{path} has no field {field}") from error
    if value is None or value[0] is None:
        raise ValueError(f"{path} has no value in {field}")
    return float(value[0])


def save_vectors(rows: DataFrame, path: str, **facts: object) -> None:
    """Vectors as Parquet, with a one-row table of facts about them beside it."""
    rows.write.mode("overwrite").parquet(f"{path}/vectors")
    facts = facts or {"kind": "vectors"}
    rows.sparkSession.createDataFrame([tuple(facts.values())], list(facts)).write.mode("overwrite").parquet(f"{path}/facts")


def load_vectors(spark: SparkSession, path: str, normalize: bool = True) -> tuple[DataFrame, dict]:
    from normlens.functions.vectors import l2_normalize

    rows = spark.read.parquet(f"{path}/vectors")
    if normalize:
        rows = rows.withColumn("v", l2_normalize(F.col("v")))
    return rows, spark.read.parquet(f"{path}/facts").first().asDict()


def save_by_key(rows: DataFrame, name: str, key: str, buckets: int, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """``rows`` as a table of the catalog in ``buckets`` by ``key``, each one file, sorted by key and ``order``.

    Aggregates by the key, and joins with another table of as many buckets by the same key, then need no exchange and no
    sort. Choose the number by the table's size: a bucket is what one task reads."""
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *order).saveAsTable(name)
    return rows.sparkSession.table(name)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path`` if it is complete, else what ``make`` returns, written there first."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
