"""Letterbox, crop and grid geometry as expressions: whole images stay four numbers until pixels are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlens.operators.percentiles import weighted, with_percentiles

TARGET = 256
# Channel means and deviations of the usual natural-image normalisation.
MEAN = (0.485, 0.456, 0.406)
DEVIATION = (0.229, 0.224, 0.225)


def half_even(x: Column) -> Column:
    return F.bround(x).cast("int")


def letterbox(images: DataFrame, target: int = TARGET) -> DataFrame:
    """Adds scale, new_width, new_height, pad_left, pad_top for columns width and height; null sizes give nulls."""
    w, h = F.col("width"), F.col("height")
    scale = F.least(F.lit(float(target)) / w, F.lit(float(target)) / h)
    out = images.withColumn("scale", scale)
    out = out.withColumns({"new_width": F.greatest(F.lit(1), half_even(w * F.col("scale"))), "new_height": F.greatest(F.lit(1), half_even(h * F.col("scale")))})
    pad = lambda c: F.floor((F.lit(target) - F.col(c)) / 2).cast("int")
    return out.withColumns({"pad_left": pad("new_width"), "pad_top": pad("new_height")})


def resize_shorter(images: DataFrame, shorter: int = 256, crop: int = 224) -> DataFrame:
    """Adds the size after resizing the shorter side to ``shorter``, and the corner of the centred ``crop`` square."""
    w, h = F.col("width"), F.col("height")
    out = images.withColumns(
        {
            "new_width": F.when(w <= h, F.lit(shorter)).otherwise(F.floor(F.lit(shorter) * w / h)).cast("int"),
            "new_height": F.when(w <= h, F.floor(F.lit(shorter) * h / w)).otherwise(F.lit(shorter)).cast("int"),
        }
    )
    corner = lambda c: half_even((F.col(c) - F.lit(crop)) / 2.0)
    return out.withColumns({"crop_left": corner("new_width"), "crop_top": corner("new_height")})


def cells(boxes: DataFrame, grid: int = 32, target: int = TARGET) -> DataFrame:
    """One row for each grid cell: row, col and valid_ratio, the share of the cell that the pasted image covers.

    The overlap of two intervals in each direction equals average-pooling the 0/1 mask. ``target`` is a multiple of ``grid``."""
    rows = boxes.select("*", _axis("row", grid)).select("*", _axis("col", grid))
    covered = _covered("row", "pad_top", "new_height", target // grid) * _covered("col", "pad_left", "new_width", target // grid)
    return rows.withColumn("valid_ratio", covered / F.lit(float((target // grid) ** 2)))


def _axis(name: str, grid: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias(name)


def _covered(at: str, start: str, length: str, size: int) -> Column:
    """How many of the ``size`` pixels from ``at`` * size the interval shares."""
    return F.greatest(F.lit(0), F.least((F.col(at) + 1) * size, F.col(start) + F.col(length)) - F.greatest(F.col(at) * size, F.col(start)))


def valid_cells(boxes: DataFrame, grid: int = 32, target: int = TARGET, least: float = 0.5) -> DataFrame:
    """The ``cells`` with a valid_ratio of at least ``least``. A row of cells that the image covers less than that has none, whatever
    their columns, and goes before it becomes ``grid`` cells."""
    size = target // grid
    rows = boxes.select("*", _axis("row", grid)).withColumn("_down", _covered("row", "pad_top", "new_height", size)).where(F.col("_down") >= least * size)
    rows = rows.select("*", _axis("col", grid)).withColumn("valid_ratio", F.col("_down") * _covered("col", "pad_left", "new_width", size) / F.lit(float(size * size)))
    return rows.where(F.col("valid_ratio") >= least).drop("_down")


def overlap_area(left: Column, top: Column, width: Column, height: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Pixels that a rectangle shares with another (left, top, width, height)."""
    x, y, w, h = box
    across = F.greatest(F.lit(0), F.least(left + width, x + w) - F.greatest(left, x))
    return across * F.greatest(F.lit(0), F.least(top + height, y + h) - F.greatest(top, y))


def retention(rows: DataFrame, original: str, kept: str) -> DataFrame:
    """Adds retention_ratio (0.0 for an empty original), loss_ratio and fully_lost."""
    o, k = F.col(original), F.col(kept)
    out = rows.withColumn("retention_ratio", F.when(o > 0, k.cast("double") / o).otherwise(F.lit(0.0)))
    return out.withColumns({"loss_ratio": 1 - F.col("retention_ratio"), "fully_lost": (o > 0) & (k == 0)})


def retention_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of all, fully lost, below 0.9 and below 0.5; mean, median and least retention."""
    r, lost, times = F.col("retention_ratio"), F.col("fully_lost"), F.col("times")
    total = lambda c: F.coalesce(F.sum(F.when(c, times)), F.lit(0))
    known = weighted("retention_ratio")
    sums = {
        "n": F.coalesce(F.sum(times), F.lit(0)),
        "n_lost": total(lost),
        "n_below_90": total(r < 0.9),
        "n_below_50": total(r < 0.5),
        "mean_retention": known["mean"],
        "min_retention": known["min"],
        "lost_rate": F.sum(lost.cast("double") * times) / F.nullif(total(lost.isNotNull()), F.lit(0)),
    }
    return with_percentiles(rows, by or [], "retention_ratio", {"median_retention": 0.5}, sums, ("fully_lost",))


def average_pool(grid: DataFrame, factor: int, key: str = "image_id", value: str = "value") -> DataFrame:
    """Means of ``factor`` x ``factor`` cells."""
    cell = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return grid.groupBy(key, cell("row"), cell("col")).agg(F.avg(value).alias(value))


def strided(grid: DataFrame, step: int = 2) -> DataFrame:
    return grid.where((F.col("row") % step == 0) & (F.col("col") % step == 0))


def bilinear_upsample(grid: DataFrame, size: int, factor: int, key: str = "image_id", value: str = "value") -> DataFrame:
    """A ``size`` x ``size`` grid enlarged ``factor`` times, pixel centres aligned, borders repeated.

    Each source cell is sent to the target cells that it weighs in (a bounded number), and weights are summed:
    one exchange on the target cell, no self join. Every cell of the source grid must be present."""
    out = size * factor

    def targets(at: str) -> Column:
        place = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(size - 1.0), (t + 0.5) / factor - 0.5))
        near = F.sequence(F.greatest(F.lit(0), (F.col(at) - 1) * factor), F.least(F.lit(out - 1), (F.col(at) + 2) * factor - 1))
        weighed = F.transform(near, lambda t: F.struct(t.cast("int").alias("at"), F.greatest(F.lit(0.0), 1 - F.abs(place(t) - F.col(at))).alias("w")))
        return F.explode(F.filter(weighed, lambda s: s["w"] > 0))

    spread = grid.select("*", targets("row").alias("r")).select("*", targets("col").alias("c"))
    part = F.col("r.w") * F.col("c.w") * F.col(value)
    return spread.groupBy(key, F.col("r.at").alias("row"), F.col("c.at").alias("col")).agg(F.sum(part).alias(value))


def min_max(rows: DataFrame, key: str, value: str, eps: float = 1e-8, out: str = "scaled") -> DataFrame:
    """(x - min) / (max - min + eps) within each key."""
    each = Window.partitionBy(key)
    low = F.min(value).over(each)
    return rows.withColumn(out, (F.col(value) - low) / (F.max(value).over(each) - low + eps))


def peak_scaled(rows: DataFrame, key: str, value: str, eps: float = 1e-8, out: str = "scaled") -> DataFrame:
    """The overlay's variant: shift to 0, then divide by the greatest shifted value + eps."""
    each = Window.partitionBy(key)
    shifted = rows.withColumn("_shifted", F.col(value) - F.min(value).over(each))
    return shifted.withColumn(out, F.col("_shifted") / (F.max("_shifted").over(each) + eps)).drop("_shifted")


def row_col(index: Column, width: int) -> tuple[Column, Column]:
    return F.floor(index / width).cast("int"), (index % width).cast("int")


def normalized_pixel(value: Column, channel: int) -> Column:
    """A 0..255 pixel value scaled, less the channel's mean, over its deviation."""
    return (value / F.lit(255.0) - MEAN[channel]) / DEVIATION[channel]
