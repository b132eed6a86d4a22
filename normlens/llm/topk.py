"""Exact top-k by inner product: the threshold algorithm over sorted per-dimension lists.

Vectors are dealt over shards of bounded size. A shard's task reads its vectors once, sorts them by each
component into lists, and then takes the queries, all of them, as a stream. So candidates move once, and the
copies of a query are as many as shards. For one query the lists are read from their favourable end, in rounds
of doubling depth; vectors seen for the first time are scored in full; reading stops when the bound, the sum over
dimensions of query times the component at the current depth, cannot beat the k-th score (nor tie with it).
Shards' winners meet by query, k rows from each shard. Above ``GROUP_QUERIES`` queries a shard is read by several tasks,
each with a group of the queries, so neither a task's rows nor its time grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlens.llm.common import give_back

K = 5
SCALE = 256
EVERY = 50
SHARD_ROWS = 131_072
GROUP_QUERIES = 8_192
FEW_ROWS, SPREAD = 2_048, 16  # smaller tables take a shard for every FEW_ROWS, up to SPREAD
FIRST_DEPTH = 16
PAIR_SCHEMA = "query_id long, vec_id long, score long, depth long"


class Shard:
    """Sorted lists of a shard's vectors, smaller ids first among equal components."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, whole = ids[order], vectors[order]
        self.most = int(np.abs(whole).max(initial=0))
        self.exact32 = whole.astype(np.float32)
        self.whole = whole.astype(np.int32) if self.most < 1 << 31 else whole
        self.lists = np.ascontiguousarray(np.argsort(whole, axis=0, kind="stable").T.astype(np.int32))

    def top(self, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows of the k best other vectors (ties to the smaller id), their scores, and the depth read."""
        n, dims = self.whole.shape
        # 32-bit floats hold these sums exactly below 2**24, 64-bit integers otherwise.
        small = int(np.abs(query).sum()) * self.most < 1 << 24
        table, q = (self.exact32, query.astype(np.float32)) if small else (self.whole.astype(np.int64), query)
        used = np.flatnonzero(query)
        rising = query[used] < 0  # such lists are read from their smallest component
        seen = np.zeros(n, dtype=bool)
        best, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            to = min(n, depth + step)
            before = seen.copy()
            seen[self.lists[used[rising], depth:to]] = True
            seen[self.lists[used[~rising], n - to : n - depth]] = True
            if not len(used):
                seen[:] = True
            new = np.flatnonzero(seen & ~before)
            new = new[self.ids[new] != own_id]
            best = np.concatenate([best, new])
            scores = np.concatenate([scores, (table[new] @ q).astype(np.int64)])
            if len(best) > k:
                floor = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = np.flatnonzero(scores >= floor)
                keep = keep[np.lexsort((self.ids[best[keep]], -scores[keep]))][:k]
                best, scores = best[keep], scores[keep]
            depth, step = to, step * 2
            if depth == n or seen.all():
                break
            at_depth = np.where(rising, self.whole[self.lists[used, depth - 1], used], self.whole[self.lists[used, n - depth], used])
            if len(best) == k and int(query[used] @ at_depth) < scores.min():
                break
        order = np.lexsort((self.ids[best], -scores))
        return best[order], scores[order], depth


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as long; null unless all components are finite numbers."""
    good = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def search(vectors: DataFrame, is_query: Column, k: int = K, shard_rows: int = SHARD_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score (and depth, the most list entries read in any shard) for each query row.

    ``vectors`` has vec_id and an integer array ``v``; ``is_query`` picks the queries. Every row but those with
    the query's own id is a candidate. Rows with a null id or vector take no part; an empty table gives no rows.
    Vectors of different lengths have no inner product: that is an error. Those without components score 0 with each
    other. A query id that occurs on several rows is searched once, by its smallest vector. Repeated candidate rows
    each count as a candidate.
    Comparisons grow with queries times vectors, as they must; rows moved are the vectors once for each group of
    ``group_queries`` queries, and each query once for each shard. A task holds about ``shard_rows`` vectors; nothing is
    broadcast or collected.
    """
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select("vec_id", "v", is_query.alias("asks"))
    sizes = usable.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("dims"), F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking")).first()
    dims, n = sizes["dims"] or 0, sizes["n"]
    if n and sizes["least"] != dims:
        raise ValueError(f"vectors of {sizes['least']} and of {dims} dimensions have no inner product")
    shards = max(1, -(-n // shard_rows), min(SPREAD, n // FEW_ROWS))

    groups = max(1, -(-sizes["asking"] // group_queries))

    # A task's number is its shard's times the groups, and its group of queries.
    shard, group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(groups))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = usable.select((shard * groups).alias("first"), every(groups).alias("group"), "vec_id", "v")
    candidates = candidates.select((F.col("first") + F.col("group")).alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    queries = usable.where("asks").groupBy("vec_id").agg(F.min("v").alias("v")).select(every(shards).alias("number"), group.alias("group"), "vec_id", "v")
    queries = queries.select((F.col("number") * groups + F.col("group")).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, lists = None, [], None
        for number, kind, ids, v in blocks(batches, dims):
            if number != current:
                current, held, lists = number, [], None
            if kind == 0:
                held.append((ids, v))
                continue
            if held:
                lists = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            if lists is not None:
                found = [lists.top(q, own, k) for own, q in zip(ids.tolist(), v, strict=True)]
                many = [len(best) for best, _, _ in found]
                columns = [np.repeat(ids, many), lists.ids[np.concatenate([f[0] for f in found])], np.concatenate([f[1] for f in found]), np.repeat([f[2] for f in found], many)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score", "depth"])

    rows = candidates.unionByName(queries).repartition(shards * groups, "shard").sortWithinPartitions("shard", "kind")
    found = rows.mapInArrow(run, PAIR_SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "depth")


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """shard, kind, ids and vectors of each run of rows with the same shard and kind, batch by batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, kind, ids = (batch.column(i).to_numpy() for i in range(3))
        vectors = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
        starts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)], strict=True):
            yield int(shard[a]), int(kind[a]), ids[a:b], vectors[a:b]
    give_back()


def query_of(vec_id: Column) -> Column:
    return vec_id % EVERY == 0
