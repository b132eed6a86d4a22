"""Image catalogs from folders. Tasks list the folders and open the files, not the driver."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.functions import paths
from normlens.scratch import process_scratch
from normlens.session import qualified

LISTED = 10_000  # files a batch of a listing


def list_files(spark: SparkSession, root: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """path (below ``root``) and length of each file, those without bytes too, which Spark's own source leaves out.

    Folders are listed level by level, each by one task; a level's folders are dealt over all tasks. Names that begin with
    '.' or '_' are left out, as Spark does. ``pattern`` is of '*', '?' and '[...]'. A root that is not there is an error."""
    address = qualified(spark, root)

    def run(folders: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(address)
        for folder in (f for batch in folders for f in batch.column(0).to_pylist()):
            infos = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/") or "/"))
            infos = [i for i in infos if i.base_name[0] not in "._" and (i.type == fs.FileType.Directory or pattern is None or fnmatchcase(i.base_name, pattern))]
            for at in range(0, len(infos), LISTED):
                some = infos[at : at + LISTED]
                kept = [pa.array([f"{folder}/{i.base_name}".lstrip("/") for i in some]), pa.array([i.size for i in some], pa.int64()), pa.array([i.type == fs.FileType.Directory for i in some])]
                yield pa.RecordBatch.from_arrays(kept, names=["path", "length", "folder"])

    level = spark.createDataFrame([("",)], "path string")
    found = []
    while not found or (recursive and not level.isEmpty()):
        dealt = level if not found else level.repartition(spark.sparkContext.defaultParallelism)
        found.append(process_scratch(spark).table(dealt.mapInArrow(run, "path string, length long, folder boolean"), "listing"))
        level = found[-1].where("folder").select("path")
    return reduce(DataFrame.unionByName, found).where("NOT folder").drop("folder")


def read_images(spark: SparkSession, root: str, pattern: str | None = None, recursive: bool = True, content: bool = True) -> DataFrame:
    """path (below ``root``), product, split, defect_type, stem, extension, length and content of each image below ``root``.

    ``pattern`` restricts names (such as '*.png'); hashes can be taken from content with ``files.sha256_hex``. Without
    ``content`` the files are listed only. Files without bytes are rows too: images that no decoder reads."""
    out = list_files(spark, root, pattern, recursive)
    if content:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        rows = reader.load(root)
        plain = root.split("://", 1)[-1].split(":", 1)[-1]
        path = paths.relative_to(F.regexp_replace(F.col("path"), r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", ""), plain.rstrip("/"))
        empty = out.where("length = 0").withColumn("content", F.lit("").cast("binary"))
        out = rows.select(path.alias("path"), "length", "content").unionByName(empty)
    p = F.col("path")
    out = out.withColumns({"product": paths.product_of(p), "split": paths.split_of(p), "defect_type": paths.parent_of(p), "stem": paths.stem_of(p), "extension": paths.extension(p)})
    return out.where(paths.is_image(p))


def product_images(images: DataFrame) -> DataFrame:
    """The catalog without ground-truth masks, whatever other split their paths name."""
    return images.where(~paths.is_mask(F.col("path")))


def labelled(images: DataFrame) -> DataFrame:
    """Adds label: 0 for the class 'good', else 1."""
    return images.withColumn("label", F.when(F.col("defect_type") == "good", 0).otherwise(1))


def listed(images: DataFrame) -> DataFrame:
    """The catalog in the order of its paths, sorted by ranges: no task sorts all of it."""
    return images.orderBy("path")


def inventory(images: DataFrame) -> DataFrame:
    """product, split, defect_type, n; with totals by product and split (nulls) as rollup rows."""
    return images.rollup("product", "split", "defect_type").agg(F.count(F.lit(1)).alias("n"))


def masks(images: DataFrame, suffix: str = "_mask") -> DataFrame:
    """defect_type, stem of the image that each mask belongs to, and mask_path."""
    rows = images.where(paths.is_mask(F.col("path")))
    return rows.select("defect_type", F.regexp_replace("stem", suffix + "$", "").alias("stem"), F.col("path").alias("mask_path"))
