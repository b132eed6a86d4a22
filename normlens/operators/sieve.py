"""A stored membership filter: a Bloom filter in blocks, built and asked by built-in bitmap functions.

Each key belongs to one block of 32,768 bits, chosen by a hash, and sets ``HASHES`` bits in it. Blocks are rows of a table, so a
filter of any size is built by one aggregate and asked by one join. What the filter does not know is certainly absent; of
what it knows about one in a few hundred is absent too, so only these keys need the exact table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlens.operators.files import without_leaks
from normlens.scratch import process_scratch

BLOCK_BITS = 32_768  # of the bitmaps that the aggregate makes
KEY_BITS, HASHES = 16, 6


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks))


def _places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(1, HASHES + 1)]


def build(keys: DataFrame, column: str) -> DataFrame:
    """block, blocks (their number), bits: the filter of the non-null values of ``column``; no row without any."""
    keys = keys.select(F.col(column).alias("key")).where(F.col("key").isNotNull())
    blocks = max(1, -(-keys.count() * KEY_BITS // BLOCK_BITS))
    placed = keys.select(_block(F.col("key"), blocks).alias("block"), F.explode(F.array(*_places(F.col("key")))).alias("place"))
    return placed.groupBy("block").agg(F.lit(blocks).alias("blocks"), F.bitmap_construct_agg("place").alias("bits"))


def ask(rows: DataFrame, column: str, stored: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false if ``column`` is certainly none of the filter's keys (null never is one)."""
    first = stored.select("blocks").first()
    if first is None:
        return rows.withColumn("maybe", F.lit(False))
    key = F.col(column)
    asked = rows.withColumn("_block", _block(key, first["blocks"]))
    joined = asked.join(stored.select(F.col("block").alias("_of"), F.col("bits").alias("_bits")), F.col("_block") == F.col("_of"), "left")
    known = key.isNotNull() & F.col("_bits").isNotNull()
    for place in _places(key):
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        known = known & (F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1)
    return joined.withColumn("maybe", F.coalesce(known, F.lit(False))).drop("_block", "_of", "_bits")


def without_leaks_sieved(test: DataFrame, train: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of ``files.without_leaks``: ``train`` is read for the digests that its stored filter knows, and not at all without any."""
    marked = process_scratch(test.sparkSession).table(ask(test, "sha256", stored), "marked")
    clean = marked.where(~F.col("maybe")).drop("maybe")
    doubtful = marked.where("maybe").drop("maybe")
    if doubtful.isEmpty():
        return clean
    return clean.unionByName(without_leaks(doubtful, train).select(*clean.columns))
