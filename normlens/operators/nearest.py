"""Exact nearest neighbours by inner product of unit vectors: matrix products over Arrow batches.

``nearest`` holds each batch of queries against the whole bank when the bank is counted to be small, which is laid out by cells
and broadcast once; a larger bank is stored by cells that queries visit (see ``cells``), or, if its vectors have no structure to
prune by, dealt over blocks, each met by blocks of queries; the winners of cells or blocks are reduced by a combinable maximum. Similarities are rounded to 9 digits before they are compared, so that
the order of summation cannot decide between ties; the smaller bank id wins them. See ``layout`` for the kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlens.operators.layout import DIGITS, SAMPLE_OF_CELL, ROUNDS, Layout, cells_for, laid_out, lloyd, own_cells, placed, plain
from normlens.scratch import process_scratch

BROADCAST_BYTES = 64 << 20
BANK_ROWS = 8_192
BLOCK_ROWS = BANK_ROWS * 8  # vectors that a task holds
SPREAD = 4  # blocks a side that are made for the sake of parallel tasks alone: each copies the other side once
QUERY_ROWS = 1_048_576
CELL_ROWS = 8_192  # vectors in a cell of a bank that is not broadcast, about; more in banks of millions
CELLS_SHARE, SAMPLE_QUERIES = 0.1, 1_000
FLOOR_BYTES = 24 << 20  # of such a bank, the vectors that are broadcast to give each query a first value
OUT_SCHEMA = "query_id long, bank_id long, similarity double"


def matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def first_by(rows: DataFrame, order: Column, bound: Callable[[float], object], n: int, total: int) -> DataFrame:
    """The first ``n`` of ``total`` rows by ``order``, an even hash of the id, and by the id; ``bound`` gives the value that a share lies below.

    Only values below a bound that suffices are sorted: else each task would send ``n`` rows to a single one."""
    share = 2 * n / max(total, 1)
    some = rows if share >= 1 else rows.where(order < F.lit(bound(share)))
    if share < 1 and some.count() < n:
        some = rows
    return some.orderBy(order, "id").limit(n)


def below(share: float) -> int:
    """What a share of all values of ``xxhash64`` lies below."""
    return int(share * 2**64) - 2**63


def shared_layout(bank: DataFrame, rows: int, units: bool) -> Layout:
    """A small bank on the driver, by cells; they are assigned in Spark's tasks, by centroids of a bounded sample."""
    cells = cells_for(rows) if units else 0
    if not cells:
        found = bank.toArrow().sort_by("id")
        return plain(found["id"].to_numpy(), matrix(found["v"].combine_chunks()))
    sample = first_by(bank, F.xxhash64("id"), below, cells * SAMPLE_OF_CELL, rows).toArrow()
    vectors = matrix(sample["v"].combine_chunks())
    centroids = lloyd(vectors, vectors[:cells], ROUNDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, angle = own_cells(matrix(batch.column(1)), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(cell), pa.array(angle)], names=["id", "v", "cell", "angle"])

    found = bank.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "id long, v array<double>, cell long, angle double").toArrow().sort_by("id")
    return placed(found["id"].to_numpy(), matrix(found["v"].combine_chunks()), centroids, found["cell"].to_numpy(), found["angle"].to_numpy())


def nearest(queries: DataFrame, bank: DataFrame, limit_bytes: int = BROADCAST_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """query_id, bank_id, similarity, and the columns ``keep`` of the query: the bank vector with the greatest inner product.

    Both sides have id and v (arrays of doubles of one length); rows with a null vector are left out. An empty bank
    gives no rows. Against a broadcast bank the queries are not exchanged at all."""
    queries = queries.select("id", "v", *keep).where(F.col("v").isNotNull())
    bank = bank.select("id", "v").where(F.col("v").isNotNull()).persist()  # measured first, then collected or dealt
    size, rows, units = bank.agg(F.coalesce(F.sum(F.size("v") * 8 + 8), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.min(has_unit_length()), F.lit(False))).first()
    if 0 < size <= limit_bytes:
        layout = shared_layout(bank, rows, units)
        bank.unpersist()
        shared = bank.sparkSession.sparkContext.broadcast(layout)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    where, best = shared.value.best(matrix(batch.column(1)))
                    columns = [batch.column(0).cast(pa.int64()), pa.array(where), pa.array(best), *(batch.column(2 + k) for k in range(len(keep)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "bank_id", "similarity", *keep])

        kinds = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in keep)
        return queries.mapInArrow(run, f"{OUT_SCHEMA}, {kinds}" if keep else OUT_SCHEMA)
    if size == 0:
        found = queries.sparkSession.createDataFrame([], OUT_SCHEMA)
        found = found.join(queries.select(F.col("id").alias("query_id"), *keep), "query_id") if keep else found
    else:
        found = against_large(queries, bank, rows, units, keep, FLOOR_BYTES / size)
    bank.unpersist()
    return found


def has_unit_length() -> Column:
    return F.abs(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) - 1) < 1e-9


def cell_count(rows: int) -> int:
    """Cells of ``CELL_ROWS``; of a very large bank fewer, as each query meets every centroid."""
    return min(-(-rows // CELL_ROWS), 64 + int(rows**0.5 / 8))


def against_large(queries: DataFrame, bank: DataFrame, rows: int, units: bool, keep: tuple[str, ...], share: float) -> DataFrame:
    """``nearest`` for a bank that is not broadcast: by cells, which queries visit as far as bounds admit, or by blocks.

    A query's first value, from which bounds are taken, is the best of a ``share`` of the bank that is broadcast. Cells are taken if
    a sample of the queries would be compared with at most ``CELLS_SHARE`` of the bank. Queries get numbers of their own, as an id
    may stand for several of them (patch 3 of every image)."""
    from normlens.operators import cells  # it is built on this module

    scratch = process_scratch(bank.sparkSession)
    bank = scratch.table(bank, "bank")
    asked = scratch.table(queries.withColumn("_row", F.monotonically_increasing_id()), "queries")
    numbered, found = asked.select(F.col("_row").alias("id"), "v"), None
    n_asked, asked_units = asked.agg(F.count(F.lit(1)), F.min(has_unit_length())).first()
    if units and asked_units:
        index = cells.build(bank, cell_count(rows), scratch.folder("index"), rounds=ROUNDS, rows=rows)
        part = bank if share >= 1 else bank.where(F.xxhash64("id") < below(share))
        n_part = part.count()
        floors = bank.sparkSession.sparkContext.broadcast(shared_layout(part if n_part else bank.limit(1), n_part or 1, True))
        # Of some rows, for the choice of the way alone; both ways are exact and take all queries.
        some = cells.compared(first_by(numbered, F.xxhash64("id"), below, SAMPLE_QUERIES, n_asked), index, floors=floors).first()
        if some["n_compared"] <= CELLS_SHARE * some["n_pairs"]:
            found = cells.exact(numbered, index, floors)
    if found is None:
        found = blocked(numbered, bank)
    own = asked.select(F.col("_row").alias("_query"), F.col("id").alias("_id"), *keep)
    return found.join(own, F.col("query_id") == F.col("_query")).select(F.col("_id").alias("query_id"), "bank_id", "similarity", *keep)


def block_count(n: int, rows: int, held: int) -> int:
    """Blocks of ``rows``, but no more than ``SPREAD``, unless blocks of ``held`` rows are more."""
    parts = lambda each: max(1, -(-n // each))
    return min(parts(rows), max(SPREAD, parts(max(rows, held))))


def blocked(queries: DataFrame, bank: DataFrame, bank_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``nearest`` for banks of any size: every block of the bank meets every block of queries in one group of rows.

    A group's bank vectors come first and are held; its queries pass by in batches. So a task holds one bank block,
    whatever the number of queries. Each block of one side is a copy of the other side, so blocks of ``bank_rows`` and ``query_rows``
    become larger where there would be more than ``SPREAD`` of them, up to what a task can hold."""
    n_bank, n_query = block_count(bank.count(), bank_rows, BLOCK_ROWS), block_count(queries.count(), query_rows, QUERY_ROWS)
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    kept = bank.select((part(n_bank) * n_query).alias("block"), every(n_query).alias("group"), F.lit(0).alias("kind"), "id", "v")
    asked = queries.select(every(n_bank).alias("block"), part(n_query).alias("group"), F.lit(1).alias("kind"), "id", "v")
    kept = kept.select((F.col("block") + F.col("group")).alias("pair"), "kind", "id", "v")
    asked = asked.select((F.col("block") * n_query + F.col("group")).alias("pair"), "kind", "id", "v")
    rows = kept.unionByName(asked).repartition(n_bank * n_query, "pair").sortWithinPartitions("pair", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vectors, layout = None, [], [], None
        for batch in batches:
            pair, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((pair[1:] != pair[:-1]) | (kind[1:] != kind[:-1])) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pair)], strict=True):
                if at == to:
                    continue
                some = batch.slice(at, to - at)
                if pair[at] != current:
                    current, ids, vectors, layout = pair[at], [], [], None
                if kind[at] == 0:
                    ids.append(some.column(2).to_numpy())
                    vectors.append(matrix(some.column(3)))
                elif ids or layout:
                    if layout is None:
                        layout, ids, vectors = laid_out(np.concatenate(ids), np.concatenate(vectors)), [], []
                    where, best = layout.best(matrix(some.column(3)))
                    yield pa.RecordBatch.from_arrays([some.column(2), pa.array(where), pa.array(best)], names=["query_id", "bank_id", "similarity"])

    found = rows.mapInArrow(run, OUT_SCHEMA)
    best = found.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("bank_id")).alias("minus"))).alias("best"))
    return best.select("query_id", (-F.col("best.minus")).alias("bank_id"), F.col("best.similarity").alias("similarity"))
