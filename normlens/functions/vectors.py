"""Vector expressions over ARRAY<DOUBLE> columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once a row: inside a lambda a plain column is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(v: Column, eps: float = EPS) -> Column:
    """v / max(|v|, eps), in double."""
    d = as_double(v)
    return let(F.greatest(norm(d), F.lit(eps)), lambda n: F.transform(d, lambda x: x / n))


def distance(similarity: Column) -> Column:
    """Euclidean distance of unit vectors from their inner product, never below 0."""
    return F.sqrt(F.greatest(2 - 2 * similarity, F.lit(0.0)))


def concat_features(a: Column, b: Column) -> Column:
    """Two layers' descriptors of one patch as one vector."""
    return F.concat(a, b)
