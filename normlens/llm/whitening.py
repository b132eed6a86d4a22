"""Whitening of embeddings: covariance by upper-triangle column aggregates, decomposed by LAPACK.

Vectors become whole numbers, floor(256 c). Each different vector counts once in the fit: the list of them is a table
of its own. Sums by dimension are exact; then one aggregation with generated SQL expressions sums the products of
centred components for every pair of dimensions i <= j. Only those d (d + 1) / 2 sums reach the driver, which puts the
covariance together and calls LAPACK's symmetric solver. Rows are projected where they are, without an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import forget, give_back, materialise, row_batches
from normlens.llm.topk import quantised

COMPONENTS = 4
OUT_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double"
LONG_END = 1 << 63


@dataclass
class Whitening:
    """What the fit found: ``axes`` has a column for each component, null components (no variance) as NaN."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """(x - S / n) on each component, over the root of its eigenvalue."""
        mean = np.array([s / self.n for s in self.sums])
        return ((x - mean) @ self.axes) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S) ** 2 of each row, exactly."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0)) * 2
        if most * most * max(1, x.shape[1]) < LONG_END:
            d = x * self.n - np.array(self.sums, dtype=np.int64)
            return (d * d).sum(axis=1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def pair_expressions(dims: int) -> list[str]:
    """SQL sums of centred products for every pair of dimensions i <= j, folded into rows of equal length.

    Row g of the triangle has dims - g pairs, row dims - 1 - g has g + 1: together they fill ``dims + 1`` columns for each
    ``fold`` g. So one aggregation by fold holds each pair exactly once, in code short enough to be compiled well."""
    last = dims - 1
    second = f"CASE WHEN 2 * fold < {last} THEN y[{last} - fold] * y[{{k}} - 1] END"
    return [f"sum(CASE WHEN {k} < {dims} - fold THEN y[fold] * y[fold + {k}] ELSE {second.format(k=k)} END) AS c{k}" for k in range(dims + 1)]


def covariance(fit_list: DataFrame, sums: list[int], n: int) -> np.ndarray:
    """Covariance (divisor n) of the integer vectors ``x``, centred before they are multiplied."""
    dims = len(sums)
    centred = ", ".join(f"CAST(x[{i}] AS DOUBLE) - CAST('{s / n!r}' AS DOUBLE)" for i, s in enumerate(sums))
    folded = fit_list.selectExpr(f"array({centred}) AS y").selectExpr("y", f"explode(sequence(0, {(dims - 1) // 2})) AS fold")
    found = folded.groupBy("fold").agg(*[F.expr(e) for e in pair_expressions(dims)])
    out = np.zeros((dims, dims))
    for fold, *row in found.collect():
        out[fold, fold:] = row[: dims - fold]
        if 2 * fold < dims - 1:
            out[dims - 1 - fold, dims - 1 - fold :] = row[dims - fold :]
    return (out + np.triu(out, 1).T) / n


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fits on each different ``x`` (array of long; null takes no part) once; None without vectors or dimensions.

    Vectors of different lengths have no covariance: that is an error. A component whose eigenvalue is nil, to double
    precision, has no direction to whiten: its ``values`` are NaN. The identity error is measured over the same list."""
    fit_list = materialise(vectors.where(F.col("x").isNotNull()).select("x").distinct(), "distinct")
    try:
        head = fit_list.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("dims")).first()
        if not head["n"] or not head["dims"]:
            return None
        if head["least"] != head["dims"]:
            raise ValueError(f"vectors of {head['least']} and of {head['dims']} dimensions have no common covariance")
        n, dims = head["n"], head["dims"]
        sums = [int(s) for s in fit_list.select(*[F.sum(F.col("x")[i].cast("decimal(19,0)")) for i in range(dims)]).first()]
        v = covariance(fit_list, sums, n)
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        trace = float(np.trace(v))
        values = np.where(values > trace * dims * np.finfo(float).eps, values, np.nan)
        model = Whitening(n, sums, axes, values, [float(e) / trace if trace > 0 and e == e else (0.0 if trace > 0 else None) for e in values])
        model.identity_error = identity_error(fit_list, model)
        return model
    finally:
        forget(fit_list)


def identity_error(fit_list: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list, minus the identity."""
    live = np.flatnonzero(~np.isnan(model.values)).tolist()
    if not live:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in matrices(batches, 0):
            w = model.project(x)[:, live]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in w.T], names=[f"w{i}" for i in live])

    whitened = fit_list.mapInArrow(run, ", ".join(f"w{i} double" for i in live))
    pairs = [(i, j) for i in live for j in live if i <= j]
    found = whitened.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))


def matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in row_batches(batches):
        yield as_matrix(batch.column(column))


def as_matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component.

    ``vectors`` has vec_id and ``x``, an array of long; rows whose x is null take no part. There are as many components as
    dimensions, ``components`` at most. Repeated rows and null ids are rows like any other. ``whitened`` is null for a
    component without variance, ``explained`` is then 0 (null if there is none at all), ``deviation`` is null beyond the
    range of a long. No vectors, or vectors without dimensions, give no rows; mixed lengths are an error."""
    model = fit(vectors, components)
    rows = vectors.where(F.col("x").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    if model is None:
        rows = rows.where(F.lit(False))
    k = 0 if model is None else len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            x = as_matrix(batch.column(1))
            deviations = pa.array([d if d < LONG_END else None for d in model.deviations(x)], pa.int64())
            take = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                batch.column(0).take(take),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, model.n, dtype=np.int64)),
                deviations.take(take),
                pa.array(model.project(x).ravel(), from_pandas=True),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened"])
        give_back()

    explained = F.lit(None).cast("double")
    for i, e in enumerate(model.explained if model else []):
        explained = F.when(F.col("component") == i + 1, F.lit(e).cast("double")).otherwise(explained)
    error = F.lit(model.identity_error if model else None).cast("double")
    return rows.mapInArrow(run, OUT_SCHEMA).withColumn("explained", explained).withColumn("identity_error", error)


def integer_vector(embedding: Column) -> Column:
    """floor(256 c) of each component, as long; null unless all components are finite numbers."""
    return quantised(embedding)
