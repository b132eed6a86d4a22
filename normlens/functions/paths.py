"""Expressions over file paths of a dataset tree ``product/split/class/name``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image suffixes, matched in any case.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff")
# The split names, in the order in which they are looked for.
SPLITS = ("train", "test", "ground_truth")


def segments(path: Column) -> Column:
    return F.split(path, "/")


def extension(path: Column) -> Column:
    """The lower-case suffix with its dot; '' without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def split_of(path: Column) -> Column:
    """The first of ``SPLITS`` that is a segment, else 'unknown'."""
    out = F
    for name in SPLITS:
        out = out.when(F.array_contains(segments(path), name), name)
    return out.otherwise("unknown")


def product_of(path: Column) -> Column:
    return F.element_at(segments(path), 1)


def parent_of(path: Column) -> Column:
    """Name of the folder that holds the file; null for a bare name."""
    return F.try_element_at(segments(path), F.lit(-2))


def name_of(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"\.[^.]*$", "")


def relative_to(path: Column, root: str) -> Column:
    """``path`` without the leading ``root/``, with forward slashes."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(clean, F.lit(prefix)), F.substring(clean, F.lit(len(prefix) + 1), F.length(clean))).otherwise(clean)


def is_mask(path: Column) -> Column:
    """Whether any folder of the path holds ground truth."""
    return F.array_contains(segments(path), "ground_truth")


# Descriptions of channel counts, and that of all others.
CHANNELS = {1: "Grayscale", 3: "RGB/BGR", 4: "RGBA/BGRA"}
OTHER_CHANNELS = "Other"


def channels_text(n: Column) -> Column:
    """Description of a channel count."""
    out = F
    for count, name in CHANNELS.items():
        out = out.when(n == count, name)
    return out.otherwise(OTHER_CHANNELS)
