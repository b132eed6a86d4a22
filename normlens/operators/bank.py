"""Memory bank and coreset: normal patches, random projection, farthest-first selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlens.functions.vectors import l2_normalize
from normlens.operators.nearest import BANK_ROWS, DIGITS, matrix
from normlens.scratch import Scratch

PICKS_SCHEMA = "pick int, id long, similarity double"
STATE_SCHEMA = "id long, v array<double>, near double"
CANDIDATES = 4_096  # vectors that the driver holds in a round of the exact selection
PART_ROWS = 65_536


def build_bank(patches: DataFrame, least_ratio: float = 0.5) -> DataFrame:
    """Unit descriptors of the valid patches of normal images (label 0)."""
    rows = patches.where((F.col("label") == 0) & F.col("v").isNotNull())
    if "valid_ratio" in patches.columns:
        rows = rows.where(F.col("valid_ratio") >= least_ratio)
    return rows.withColumn("v", l2_normalize(F.col("v")))


def bank_statistics(patches: DataFrame, bank: DataFrame) -> DataFrame:
    """One row: candidate and kept vectors, their share, dimensions, and the bank's size in MB of 32-bit floats."""
    a = patches.where("label = 0").agg(F.count(F.lit(1)).alias("n_candidates"))
    b = bank.agg(F.count(F.lit(1)).alias("n_kept"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims"))
    rows = a.crossJoin(b)
    return rows.select(
        "n_candidates",
        "n_kept",
        F.when(F.col("n_candidates") > 0, F.col("n_kept") / F.col("n_candidates")).otherwise(F.lit(0.0)).alias("keep_ratio"),
        "dims",
        size_mb(F.col("n_kept"), F.col("dims")).alias("size_mb"),
    )


def size_mb(rows: Column, dims: Column, item: int = 4) -> Column:
    return rows * dims * F.lit(item) / F.lit(1024.0 * 1024.0)


def target_size(n: Column, share: float = 0.10) -> Column:
    return F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("int"))


def projection_sign(seed: int, i: Column, j: Column) -> Column:
    """Entry (i, j) of a random sign matrix: the parity of the first hex digit of md5('seed|i|j').

    Sign matrices keep distances as Gaussian ones do, and any engine can make the same one."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), i.cast("string"), j.cast("string")))
    return F.when(F.conv(F.substring(digest, 1, 1), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def random_projection(rows: DataFrame, dims: int, out_dims: int, seed: int = 42) -> DataFrame:
    """``v`` projected to ``out_dims`` dimensions, over sqrt(out_dims), at unit length.

    The sign matrix is one literal-sized row of arrays, made once and broadcast."""
    spark = rows.sparkSession
    grid = spark.range(dims * out_dims).select(F.floor(F.col("id") / dims).alias("j"), (F.col("id") % dims).alias("i"))
    lines = grid.groupBy("j").agg(F.array_sort(F.collect_list(F.struct("i", projection_sign(seed, F.col("i"), F.col("j")).alias("s")))).alias("line"))
    signs = lines.select("j", F.transform("line", lambda x: x["s"]).alias("line"))
    table = signs.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "line"))), lambda x: x["line"]).alias("signs"))
    dot = lambda line: F.aggregate(F.zip_with(F.col("v"), line, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    projected = F.transform(F.col("signs"), lambda line: dot(line) / F.lit(float(out_dims) ** 0.5))
    return rows.crossJoin(F.broadcast(table)).withColumn("v", l2_normalize(projected)).drop("signs")


def greedy(ids: np.ndarray, vectors: np.ndarray, picks: int, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Farthest-first order of unit vectors: positions picked, and each one's greatest similarity to those before.

    The next pick is the least similar to its nearest pick, the smaller position on ties (at 9 digits). A picked
    vector is never picked again, even if all that remain are its copies."""
    n = len(ids)
    picks = min(picks, n)
    nearest = np.full(n, -np.inf)
    taken = np.zeros(n, dtype=bool)
    order, similarity = np.empty(picks, dtype=np.int64), np.full(picks, np.nan)
    at = start
    for k in range(picks):
        order[k] = at
        taken[at] = True
        if k:
            similarity[k] = nearest[at]
        nearest = np.maximum(nearest, np.round(vectors @ vectors[at], 9))
        at = int(np.where(taken, np.inf, nearest).argmin())
    return order, similarity


def closer(rows: DataFrame, picked: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """``rows`` (id, v, near) without the ``picked``, with ``near`` raised to the greatest similarity to any of their vectors."""
    shared = rows.sparkSession.sparkContext.broadcast((np.sort(picked), vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone, new = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v, near = matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).copy()
            for at in range(0, len(new), BANK_ROWS):
                near = np.maximum(near, np.round(v @ new[at : at + BANK_ROWS].T, DIGITS).max(axis=1))
            left = pa.array(~np.isin(batch.column(0).to_numpy(), gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], names=["id", "v", "near"]).filter(left)

    return rows.mapInArrow(run, STATE_SCHEMA)


def safe_picks(ids: np.ndarray, vectors: np.ndarray, near: np.ndarray, limit: tuple[float, int] | None, most: int) -> tuple[list[int], list[float]]:
    """Places picked among candidates in turn, as long as none but a candidate can be next, and the similarity of each.

    ``limit`` is (near, id) of the first row that is no candidate. As similarities to the picks only rise, a candidate that
    comes before it comes before all such rows."""
    near, taken = near.copy(), np.zeros(len(ids), dtype=bool)
    places, similarity = [], []
    while len(places) < min(most, len(ids)):
        open_near = np.where(taken, np.inf, near)
        at = int(np.flatnonzero(open_near == open_near.min())[0])  # ids rise
        if limit is not None and (near[at], ids[at]) > limit:
            break
        places.append(at)
        similarity.append(float(near[at]))
        taken[at] = True
        near = np.maximum(near, np.round(vectors @ vectors[at], DIGITS))
    return places, similarity


def farthest_first(bank: DataFrame, share: float = 0.10, picks: int | None = None, start_seed: int | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """pick, id, similarity of a coreset of round(share * n) vectors of ``bank`` (id, unit vectors v), exactly as one task would pick.

    Each round raises every vector's greatest similarity to the picks, by the picks of the round before, and takes the
    ``candidates`` least similar vectors to the driver. There picks go on as long as only a candidate can be next, so a
    round makes many. The bank stays in tables of the shared folder, one at a time; the driver holds the candidates and the
    ids of the picks. It starts at the smallest id, or at the first in the order of MD5 of ``start_seed`` and id. Rows with a
    null vector are left out; an empty bank gives no rows."""
    spark = bank.sparkSession
    rows = bank.select("id", F.col("v").cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    order = [F.col("id")] if start_seed is None else [F.md5(F.concat_ws("|", F.lit(str(start_seed)), F.col("id").cast("string"))), F.col("id")]
    found: list[tuple[int, int, float | None]] = []
    with Scratch(spark) as scratch:
        state = scratch.table(rows.withColumn("near", F.lit(float("-inf"))), "bank")
        n = state.count()
        wanted = min(n, max(1, int(round(n * share))) if picks is None else picks)
        first = state.orderBy(*order).first() if wanted else None
        if first is not None:
            found.append((0, first["id"], None))
            new_ids, new = np.array([first["id"]]), np.array([first["v"]])
        while len(found) < wanted:
            last, state = list(scratch.paths), scratch.table(closer(state, new_ids, new), "bank")
            for path in last:
                scratch.remove(path)
            top = state.orderBy("near", "id").limit(candidates + 1).toArrow().sort_by([("near", "ascending"), ("id", "ascending")])
            limit = (top["near"][candidates].as_py(), top["id"][candidates].as_py()) if top.num_rows > candidates else None
            top = top.slice(0, candidates).sort_by("id")
            ids, vectors = top["id"].to_numpy(), matrix(top["v"].combine_chunks())
            places, similarity = safe_picks(ids, vectors, top["near"].to_numpy(), limit, wanted - len(found))
            found += [(len(found) + k, int(ids[at]), s) for k, (at, s) in enumerate(zip(places, similarity, strict=True))]
            new_ids, new = ids[places], vectors[places]
    return spark.createDataFrame(found, PICKS_SCHEMA)


def distributed_coreset(bank: DataFrame, share: float = 0.10, part_rows: int = PART_ROWS) -> DataFrame:
    """pick, id, similarity of an approximate coreset of round(share * n) vectors of a bank of any size.

    Greedy within hash parts of about ``part_rows`` vectors, of which each keeps twice its share; then again over what
    was kept, dealt anew, for the wanted number. A part's picks come in turn with those of the other parts, and a
    similarity is to the picks before it in its part. What fits in one part is selected as ``farthest_first`` does."""

    def greedy_by(rows: DataFrame, parts: int, salt: str, picks: Column) -> DataFrame:
        def local(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("id")
            ids, vectors = rows["id"].to_numpy(), np.stack(rows["v"].to_numpy())
            order, similarity = greedy(ids, vectors, int(rows["_picks"].iloc[0]))
            return pd.DataFrame({"pick": np.arange(len(order)), "_part": rows["_part"].iloc[0], "id": ids[order], "similarity": similarity, "v": list(vectors[order])})

        digest = F.md5(F.concat_ws("|", F.lit(salt), F.col("id").cast("string")))
        dealt = rows.select("id", "v", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % parts).alias("_part"))
        sizes = dealt.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        sized = dealt.join(sizes, F.col("_part") == F.col("_p")).withColumn("_picks", picks)
        return sized.groupBy("_part").applyInPandas(local, "pick long, _part long, id long, similarity double, v array<double>")

    usable = bank.select("id", "v").where(F.col("v").isNotNull())
    n = usable.count()
    wanted, parts = max(1, round(n * share)), max(1, -(-n // part_rows))
    first = greedy_by(usable, parts, "1", F.least(F.col("_n"), F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(2 * share))))).select("id", "v")
    kept = max(1, min(n, round(2 * share * n)))
    last = max(1, -(-kept // part_rows))
    second = greedy_by(first, last, "2", F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(wanted) / F.lit(kept))))
    return second.select((F.col("pick") * last + F.col("_part")).cast("int").alias("pick"), "id", "similarity")


def gather(bank: DataFrame, picks: DataFrame) -> DataFrame:
    """The bank's rows that were picked, at unit length, with their place in the order."""
    return bank.join(picks.select("id", "pick"), "id").withColumn("v", l2_normalize(F.col("v")))
