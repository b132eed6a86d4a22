"""Image files in batches, in the order of their paths, read by tasks of about equal bytes.

The listing is a table like any other: its rows are placed by two-level running sums, and only they are exchanged. Each task
then opens its own files and gives one Arrow batch for each batch of images, so contents are read once and never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlens.operators.percentiles import ranged
from normlens.scratch import process_scratch
from normlens.session import qualified

SPLIT_BYTES = 128 << 20
RUN = 4096  # batches whose offsets one task adds up


def placed(files: DataFrame, key: str = "path") -> DataFrame:
    """``files`` with ``place``: 0, 1, ... in the order of ``key``, whose values differ. No task sorts all of them."""
    dealt = ranged(files, [], key)
    before = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select("bin", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("bin").orderBy(key))
    return dealt.join(F.broadcast(starts), "bin").withColumn("place", F.col("start") + place - 1).drop("bin", "start")


def planned(files: DataFrame, size: int = 16, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, int]:
    """``files`` (path, length) with place, batch and split, and the number of splits.

    ``size`` neighbours in the order of paths are a batch. Splits are runs of whole batches that begin in equal shares of all
    bytes: each has its share, but for a batch at either end. A file without a length counts as empty."""
    rows = process_scratch(files.sparkSession).table(placed(files).withColumn("batch", F.floor(F.col("place") / size)), "placed")
    batches = rows.groupBy("batch").agg(F.sum(F.coalesce("length", F.lit(0))).alias("bytes")).withColumn("run", F.floor(F.col("batch") / RUN))
    runs = batches.groupBy("run").agg(F.sum("bytes").alias("held"))
    total = runs.agg(F.sum("held")).first()[0] or 0
    n = max(1, round(total / split_bytes))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("run", earlier("held", Window.orderBy("run")).alias("start"))
    begin = F.col("start") + earlier("bytes", Window.partitionBy("run").orderBy("batch"))
    split = F.least(F.floor(begin.cast("double") * n / max(total, 1)), F.lit(n - 1)).cast("int")
    return rows.join(batches.join(runs, "run").select("batch", split.alias("split")), "batch"), n


def read_batches(files: DataFrame, root: str, size: int = 16, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """split, batch, place, path, content of each file of ``files`` (path below ``root``, length), in order within a split.

    ``root`` is a folder whose file system pyarrow knows and all executors see. A file that has gone since it was
    listed has null content, so that it is a row like a broken one. Empty listings give no rows."""
    address = qualified(files.sparkSession, root)
    rows, n = planned(files.select("path", "length"), size, split_bytes)
    dealt = rows.repartitionById(n, F.col("split")).sortWithinPartitions("place").select("split", "batch", "place", "path")

    def run(listed: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(address)
        held: list[dict] = []

        def opened() -> pa.RecordBatch:
            contents = []
            for row in held:
                try:
                    with system.open_input_stream(f"{base}/{row['path']}", compression=None) as stream:
                        contents.append(stream.read())
                except FileNotFoundError:
                    contents.append(None)
            columns = [[row[c] for row in held] for c in ("split", "batch", "place", "path")]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*columns, contents], kinds, strict=True)], names=["split", "batch", "place", "path", "content"])

        for part in listed:
            for row in part.to_pylist():
                if held and held[0]["batch"] != row["batch"]:
                    yield opened()
                    held = []
                held.append(row)
        if held:
            yield opened()

    return dealt.mapInArrow(run, "split int, batch long, place long, path string, content binary")
