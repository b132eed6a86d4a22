"""An inverted file of unit vectors: k-means cells, stored by cell, searched by probing near cells or exactly by pruning.

Cells are fitted on a bounded sample of the bank, but every vector is indexed. Each vector lies in the cell of its nearest
centroid; cells above ``BLOCK_ROWS`` vectors are blocks by a hash, so a task holds one block whatever the cell's size.
Queries go to the blocks of the cells that they probe, and stream past the block's vectors; winners are reduced by a
combinable maximum. Nothing but the centroids (``cells`` times the dimensions) is broadcast.

Exact search prunes by balls and planes (see ``layout.reaching``): after the nearest cell, or a broadcast part of the bank, has
given a first value, only cells whose bound reaches it are visited.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.operators.layout import DIGITS, TILE_QUERIES, laid_out, lloyd, own_cells, reaching
from normlens.operators.nearest import OUT_SCHEMA, first_by, matrix

SAMPLE_ROWS = 20_000  # the cells are fitted on about so many vectors at most
ROUNDS = 10
BLOCK_ROWS = 65_536


@dataclass
class Cells:
    """``table``: cell, id, v, angle (to the centroid), nearest cell first. ``sizes`` and ``radii`` are those of the cells."""

    centroids: np.ndarray
    table: DataFrame
    sizes: np.ndarray
    radii: np.ndarray

    @property
    def blocks(self) -> np.ndarray:
        return np.maximum(1, -(-self.sizes // BLOCK_ROWS))


def fit_centroids(bank: DataFrame, cells: int, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, seed: int = 42, rows: int = 0) -> np.ndarray:
    """Centroids of a sample of the bank, those first in the order of MD5 of seed and id; they start at its first vectors.

    The bank's ``rows``, if they are known, spare the sorting of most of them."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")))
    whole = bank.where(F.col("v").isNotNull()).select("id", "v")
    sample = first_by(whole, order, lambda share: f"{int(share * 16**8):08x}", max(cells, sample_rows), rows).toArrow()
    vectors = matrix(sample["v"].combine_chunks()) if sample.num_rows else np.zeros((0, 1))
    return lloyd(vectors, vectors[:cells], rounds)


def _nearest_cell(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, angle = own_cells(matrix(batch.column(1)), centroids)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0).cast(pa.int64()), batch.column(1), pa.array(angle)], names=["cell", "id", "v", "angle"])

    return run


CELL_SCHEMA = "cell int, id long, v array<double>, angle double"


def build(bank: DataFrame, cells: int, folder: str | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, rows: int = 0) -> Cells:
    """The index of ``bank`` (id, unit vectors v; null vectors are left out), stored in ``folder`` if one is given.

    Without a folder the assignment is computed again for each search. An empty bank has no cells. ``rows``: see ``fit_centroids``."""
    spark = bank.sparkSession
    centroids = fit_centroids(bank, cells, sample_rows, rounds, rows=rows)
    if not len(centroids):
        return Cells(centroids, spark.createDataFrame([], CELL_SCHEMA), np.zeros(0, dtype=np.int64), np.zeros(0))
    table = bank.where(F.col("v").isNotNull()).select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(_nearest_cell(centroids), CELL_SCHEMA)
    if folder is not None:
        table.sortWithinPartitions("cell", "id").write.parquet(f"{folder}/cells")
        lines = [(j, c.tolist()) for j, c in enumerate(centroids)]
        spark.createDataFrame(lines, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
        return load(spark, folder)
    return _measured(centroids, table)


def load(spark: SparkSession, folder: str) -> Cells:
    """An index that ``build`` stored."""
    centroids = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()
    return _measured(np.array([r["centroid"] for r in centroids]), spark.read.schema(CELL_SCHEMA).parquet(f"{folder}/cells"))


def _measured(centroids: np.ndarray, table: DataFrame) -> Cells:
    sizes, radii = np.zeros(len(centroids), dtype=np.int64), np.zeros(len(centroids))
    for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect():
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    return Cells(centroids, table, sizes, radii)


def _visits(queries: DataFrame, index: Cells, choose: Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]], layout: Broadcast | None = None) -> DataFrame:
    """block, id, v: each query once for every block of the cells that ``choose`` (vectors, floors: rows and cells) gives.

    Floors are the queries' third column, or what they find in ``layout``."""
    blocks = index.blocks
    first = np.cumsum([0, *blocks[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                floors = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else None
                vectors, found = matrix(batch.column(1)), []
                floors = floors if layout is None else layout.value.best(vectors)[1]
                for at in range(0, len(vectors), TILE_QUERIES):
                    tile = slice(at, at + TILE_QUERIES)
                    row, cell = choose(vectors[tile], None if floors is None else floors[tile])
                    found.append((at + row, cell))
                row, cell = (np.concatenate(x) for x in zip(*found, strict=True))
                times = blocks[cell]
                block = np.repeat(first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(np.repeat(row, times))
                yield pa.RecordBatch.from_arrays([pa.array(block), batch.column(0).cast(pa.int64()).take(take), batch.column(1).take(take)], names=["block", "id", "v"])

    return queries.mapInArrow(run, "block long, id long, v array<double>")


def _meet(visits: DataFrame, index: Cells) -> DataFrame:
    """query_id, bank_id, similarity: the best vector of each block for each of its visitors."""
    blocks = index.blocks
    first = np.cumsum([0, *blocks[:-1]])
    at = F.element_at(F.lit(first.tolist()), F.col("cell") + 1) + F.pmod(F.xxhash64("id"), F.element_at(F.lit(blocks.tolist()), F.col("cell") + 1).cast("long"))
    held = index.table.select(at.cast("long").alias("block"), F.lit(0).alias("kind"), "id", "v")
    rows = held.unionByName(visits.select("block", F.lit(1).alias("kind"), "id", "v"))
    rows = rows.repartition(int(min(blocks.sum(), 4_096)), "block").sortWithinPartitions("block", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vectors, layout = None, [], [], None
        for batch in batches:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if block[a] != current:
                    current, ids, vectors, layout = block[a], [], [], None
                if kind[a] == 0:
                    ids.append(some.column(2).to_numpy())
                    vectors.append(matrix(some.column(3)))
                elif ids or layout:
                    if layout is None:
                        layout, ids, vectors = laid_out(np.concatenate(ids), np.concatenate(vectors)), [], []
                    where, best = layout.best(matrix(some.column(3)))
                    yield pa.RecordBatch.from_arrays([some.column(2), pa.array(where), pa.array(best)], names=["query_id", "bank_id", "similarity"])

    return rows.mapInArrow(run, OUT_SCHEMA)


def _best(found: DataFrame) -> DataFrame:
    best = found.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("bank_id")).alias("minus"))).alias("best"))
    return best.select("query_id", (-F.col("best.minus")).alias("bank_id"), F.col("best.similarity").alias("similarity"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.where(F.col("v").isNotNull()).select("id", F.col("v").cast("array<double>").alias("v"))


def _closest(probes: int, index: Cells) -> Callable:
    centroids, live = index.centroids, index.sizes > 0

    def choose(v: np.ndarray, _: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        s = np.where(live, np.round(v @ centroids.T, DIGITS), -np.inf)
        order = np.argsort(-s, axis=1, kind="stable")[:, :probes]
        out = np.zeros(s.shape, dtype=bool)
        np.put_along_axis(out, order, True, axis=1)
        return np.nonzero(out & live)

    return choose if probes > 1 or not live.any() else _own(index)


def _own(index: Cells) -> Callable:
    """``_closest`` of one cell, without sorting them."""
    live = np.flatnonzero(index.sizes)
    centroids = index.centroids[live]
    return lambda v, _: (np.arange(len(v)), live[own_cells(v, centroids)[0]])


def search(queries: DataFrame, index: Cells, probes: int) -> DataFrame:
    """query_id, bank_id, similarity of the best vector in the ``probes`` nearest cells that hold any: it may miss the best of all."""
    return _best(_meet(_visits(_asked(queries), index, _closest(probes, index)), index))


def _reaching(index: Cells, nearest: bool = False) -> Callable:
    """The cells, besides the nearest or with it, that may hold what reaches a query's floor."""
    live = np.flatnonzero(index.sizes)
    centroids, radii = index.centroids[live], index.radii[live]

    def choose(v: np.ndarray, floors: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        own = own_cells(v, centroids)[0]
        row, cell = reaching(v, own, centroids, radii, floors)
        if nearest:
            row, cell = np.append(np.arange(len(v)), row), np.append(own, cell)
        return row, live[cell]

    return choose


def first_winners(queries: DataFrame, index: Cells) -> DataFrame:
    """query_id, bank_id, similarity: the best vector of each query's nearest cell."""
    return _best(_meet(_visits(_asked(queries), index, _closest(1, index)), index))


def floored(queries: DataFrame, first: DataFrame) -> DataFrame:
    """The queries with the similarity of their ``first_winners`` as ``floor``."""
    floors = first.select(F.col("query_id").alias("_id"), F.col("similarity").alias("floor"))
    return _asked(queries).join(floors, F.col("id") == F.col("_id")).select("id", "v", "floor")


def exact(queries: DataFrame, index: Cells, floors: Broadcast | None = None) -> DataFrame:
    """The result of ``nearest``, for unit vectors and a bank of any size: the nearest cell first, then those that the bound admits.

    On vectors without structure the bounds admit nearly every cell, and the work is that of ``blocked``. An id stands
    for one query; an empty bank gives no rows. With ``floors``, a layout of some of the bank's vectors, bounds are taken from
    what queries find there, and all cells are visited in one pass."""
    if not index.sizes.sum():
        return queries.sparkSession.createDataFrame([], OUT_SCHEMA)
    if floors is not None:
        return _best(_meet(_visits(_asked(queries), index, _reaching(index, nearest=True), floors), index))
    first = first_winners(queries, index)
    return _best(first.unionByName(_meet(_visits(floored(queries, first), index, _reaching(index)), index)))


def compared(queries: DataFrame, index: Cells, probes: int | None = None, floors: Broadcast | None = None) -> DataFrame:
    """One row: n_pairs, and n_compared, the pairs whose inner product the search takes (exact, or with ``probes``).

    ``floors`` as for ``exact``: then the bank is not read."""
    asked = _asked(queries)
    if probes is not None:
        visits = _visits(asked, index, _closest(probes, index))
    elif floors is not None:
        visits = _visits(asked, index, _reaching(index, nearest=True), floors)
    else:
        visits = _visits(asked, index, _closest(1, index)).unionByName(_visits(floored(queries, first_winners(queries, index)), index, _reaching(index)))
    of_block = np.repeat(index.sizes / index.blocks, index.blocks)
    size = F.element_at(F.lit(of_block.tolist()), F.col("block").cast("int") + 1)
    total = asked.agg((F.count(F.lit(1)) * F.lit(int(index.sizes.sum()))).alias("n_pairs"))
    return total.crossJoin(visits.agg(F.coalesce(F.sum(size), F.lit(0.0)).cast("long").alias("n_compared")))
