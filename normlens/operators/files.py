"""Content hashes, exact duplicates, train/test leakage and clean splits of a file catalog.

A catalog has path, product, split and sha256 (and what else the caller keeps). Groups are only ever reduced to
counts and minima, or to ranks within a bounded list of examples, so a digest that a third of all files share
is one combined row. All joins are on the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def duplicate_groups(files: DataFrame) -> DataFrame:
    """sha256, n_files, n_products, first_path, in_train, in_test of each digest with more than one file."""
    has = lambda s: F.max(F.when(F.col("split") == s, True).otherwise(False))
    groups = files.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.countDistinct("product").alias("n_products"),
        F.min("path").alias("first_path"),
        has("train").alias("in_train"),
        has("test").alias("in_test"),
    )
    return groups.where("n_files > 1")


def duplicate_paths(files: DataFrame, most: int = 1_000) -> DataFrame:
    """sha256, chunk, paths: the sorted paths of each group, as arrays of at most ``most``; large groups have several rows.

    A group is dealt over runs of its paths' MD5, so that no task and no array holds a group of any size."""
    groups = files.groupBy("sha256").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    runs = F.ceil(F.col("_n") / F.lit(most / 2)).cast("long")
    run = F.when(F.col("_n") <= most, F.lit(0)).otherwise(F.conv(F.substring(F.md5("path"), 1, 8), 16, 10).cast("long") % runs)
    same = F.col("sha256").eqNullSafe(F.col("_digest"))  # files without a digest are a group, as for ``duplicate_groups``
    rows = files.select("sha256", "path").join(groups.withColumnRenamed("sha256", "_digest"), same).withColumn("chunk", run.cast("int"))
    return rows.groupBy("sha256", "chunk").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def leakage_groups(files: DataFrame) -> DataFrame:
    """Digests present in both train and test."""
    return duplicate_groups(files).where("in_train AND in_test")


def cross_product_groups(files: DataFrame) -> DataFrame:
    """Digests that files of more than one product share."""
    return duplicate_groups(files).where("n_products > 1")


def duplicate_summary(files: DataFrame) -> DataFrame:
    """One row: number of groups, files in them, leakage groups, cross-product groups."""
    total = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return duplicate_groups(files).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"),
        total(F.col("in_train") & F.col("in_test")).alias("n_leaked"),
        total(F.col("n_products") > 1).alias("n_cross_product"),
    )


def canonical(files: DataFrame) -> DataFrame:
    """One row for each digest: its smallest path and that row's other columns, and how many others it stands for."""
    rest = [c for c in files.columns if c not in ("sha256", "path")]
    groups = files.groupBy("sha256").agg(F.min(F.struct("path", *rest)).alias("first"), (F.count(F.lit(1)) - 1).alias("n_removed"))
    return groups.select("sha256", "first.*", "n_removed")


def without_leaks(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose content does not occur in train."""
    return test.join(train.select("sha256").distinct(), "sha256", "left_anti")


def leaked(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose content occurs in train."""
    return test.join(train.select("sha256").distinct(), "sha256", "left_semi")


def overlap(parts: dict[str, DataFrame]) -> DataFrame:
    """left, right, n_shared for each pair of parts: all zero in a clean split."""
    names = sorted(parts)
    marked = None
    for name in names:
        part = parts[name].select("sha256").distinct().withColumn("part", F.lit(name))
        marked = part if marked is None else marked.unionByName(part)
    has = [F.max(F.when(F.col("part") == n, 1).otherwise(0)).alias(n) for n in names]
    held = marked.groupBy("sha256").agg(*has)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sums = held.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}|{b}").alias("n_shared")) for a, b in pairs])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def assert_no_overlap(parts: dict[str, DataFrame]) -> None:
    bad = overlap(parts).where("n_shared > 0").collect()
    if bad:
        raise ValueError("content shared between parts: " + ", ".join(f"{r['left']} and {r['right']} ({r['n_shared']})" for r in bad))


def assert_all_normal(rows: DataFrame) -> None:
    n = rows.where(F.col("label") != 0).count()
    if n:
        raise ValueError(f"{n} training rows are not normal")


def seeded_order(seed: int, key: Column) -> Column:
    """A reproducible shuffle key that SQL engines share: the MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def seeded_rank(rows: DataFrame, by: str, seed: int, key: str) -> DataFrame:
    """Adds _rank and _n: each row's place in its group's seeded order, and the group's size.

    The order's hash is uniform, so its first digits cut a group of any size into 4096 even runs: ranks are
    places within a run plus the sizes of the runs before. No task sorts a whole group."""
    ordered = rows.withColumn("_order", seeded_order(seed, F.col(key))).withColumn("_run", F.substring("_order", 1, 3))
    sizes = ordered.groupBy(F.col(by).alias("_by"), F.col("_run").alias("_at")).agg(F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy("_by")
    before = F.coalesce(F.sum("_size").over(group.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_by", "_at", before.alias("_before"), F.sum("_size").over(group).alias("_n"))
    joined = ordered.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_run") == F.col("_at")))
    place = F.row_number().over(Window.partitionBy(by, "_run").orderBy("_order", key))
    return joined.withColumn("_rank", place + F.col("_before")).drop("_order", "_run", "_by", "_at", "_before")


def stratified_split(files: DataFrame, by: str = "defect_type", fraction: float = 0.5, seed: int = 42, key: str = "path") -> DataFrame:
    """Adds part: 'validation' or 'test', a seeded draw within each type.

    A type of n files gives round(n * fraction) of them (half to even), at least 1 and at most n - 1, to
    validation; a type of one file goes to test."""
    ranked = seeded_rank(files, by, seed, key)
    wanted = F.least(F.greatest(F.bround(F.col("_n") * F.lit(fraction)), F.lit(1)), F.col("_n") - 1)
    part = F.when((F.col("_n") > 1) & (F.col("_rank") <= wanted), "validation").otherwise("test")
    return ranked.withColumn("part", part).drop("_rank", "_n")


def make_manifest(files: DataFrame, masks: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """image_path, label, defect_type, mask_path, sha256, source_split; the mask is joined by type and name.

    Good files have label 0 and the mask ''. A defect without a mask raises when the row is read, if ``strict``."""
    good = F.col("defect_type") == "good"
    rows = files
    if masks is not None:
        names = masks.select(F.col("defect_type").alias("_type"), F.col("stem").alias("_stem"), "mask_path").groupBy("_type", "_stem").agg(F.min("mask_path").alias("mask_path"))
        rows = files.join(names, (F.col("defect_type") == F.col("_type")) & (F.col("stem") == F.col("_stem")), "left")
    else:
        rows = rows.withColumn("mask_path", F.lit(None).cast("string"))
    missing = F.raise_error(F.concat(F.lit("no mask for "), F.col("path"))).cast("string") if strict else F.lit(None).cast("string")
    mask = F.when(good, F.lit("")).when(F.col("mask_path").isNotNull(), F.col("mask_path")).otherwise(missing)
    return rows.select(
        F.col("path").alias("image_path"), F.when(good, 0).otherwise(1).alias("label"), "defect_type", mask.alias("mask_path"), "sha256", F.col("split").alias("source_split")
    )


def counts_by(files: DataFrame, *columns: str) -> DataFrame:
    return files.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
