"""Near-duplicates by Hamming distance of 64-bit fingerprints.

``join`` picks the way by counts: equality of bands (``banded_join``) is the case of radius 0 of the multi-index join
(``indexed_join``), which probes tables of substrings within a small radius; where probes and candidates together are no
fewer than pairs, all pairs of a group are compared (``theta_join``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlens.functions.vectors import as_double, let


def median_fingerprint(v: Column) -> Column:
    """64-bit fingerprint of a 64-component vector: bit i is set where component i is above the median."""
    bit = lambda d, m: lambda i: F.when(F.get(d, i) > m, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    middle = lambda d: let(F.array_sort(d), lambda s: (F.element_at(s, 32) + F.element_at(s, 33)) / 2)
    bits = lambda d: let(middle(d), lambda m: F.transform(F.sequence(F.lit(0), F.lit(63)), bit(d, m)))
    return F.aggregate(let(as_double(v), bits), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def theta_join(left: DataFrame, right: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """left_id, right_id, distance of pairs within ``most`` bits; rows have id and fingerprint (and the ``by`` keys).

    All pairs of a ``by`` group are compared, so this form is for groups of a bounded size; see ``banded_join``."""
    keys = by or []
    a = left.select(*[F.col(k).alias(f"l_{k}") for k in keys], F.col("id").alias("left_id"), F.col("fingerprint").alias("l_fp"))
    b = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("id").alias("right_id"), F.col("fingerprint").alias("r_fp"))
    d = distance(F.col("l_fp"), F.col("r_fp"))
    condition = d <= most
    for k in keys:
        condition = condition & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    return a.join(b, condition).select(*[F.col(f"l_{k}").alias(k) for k in keys], "left_id", "right_id", d.cast("int").alias("distance"))


def bands(fingerprint: Column, n: int) -> Column:
    """``n`` structs (band number, its bits): the 64 bits cut into ``n`` runs as even as can be."""
    edges = [64 * i // n for i in range(n + 1)]
    cut = [
        F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)).alias("bits"))
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    return F.array(*cut)


def banded_join(left: DataFrame, right: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """The result of ``theta_join`` by equality joins: pairs within ``most`` bits agree in at least one of ``most`` + 1 bands.

    A pair is reported from the first band in which it agrees, so no distinct is needed. Bands of few bits have so few
    values that they would join more than all pairs; then ``theta_join`` compares all pairs of a ``by`` group once."""
    keys, n = by or [], most + 1
    if n >= 2 ** (64 // n):
        return theta_join(left, right, most, by)
    side = lambda df, p: df.select(*[F.col(k).alias(f"{p}{k}") for k in keys], F.col("id").alias(f"{p}id"), F.col("fingerprint").alias(f"{p}fp"), F.inline(bands(F.col("fingerprint"), n)).alias(f"{p}band", f"{p}bits"))
    a, b = side(left, "l_"), side(right, "r_")
    condition = (F.col("l_band") == F.col("r_band")) & (F.col("l_bits") == F.col("r_bits"))
    for k in keys:
        condition = condition & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    d = distance(F.col("l_fp"), F.col("r_fp"))
    edges = [64 * i // n for i in range(n + 1)]
    differing = F.col("l_fp").bitwiseXOR(F.col("r_fp"))
    first = F.lit(None).cast("int")
    for i in reversed(range(n)):
        width = edges[i + 1] - edges[i]
        mask = F.shiftrightunsigned(differing, edges[i]).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        first = F.when(mask == 0, i).otherwise(first)
    pairs = a.join(b, condition).where((d <= most) & (F.col("l_band") == first))
    return pairs.select(*[F.col(f"l_{k}").alias(k) for k in keys], F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), d.cast("int").alias("distance"))


@dataclass(frozen=True)
class Index:
    """Substring tables of the 64 bits, each with the radius within which it is probed.

    With a bits in each of m tables and b left over (a, b = divmod(most, m)), a pair within ``most`` bits differs by at
    most a bits in one of the first b + 1 substrings, or by at most a - 1 in one of the others. So these radii lose nothing."""

    most: int
    edges: tuple[int, ...]
    radii: tuple[int, ...]

    @classmethod
    def of(cls, most: int, tables: int) -> Index:
        a, b = divmod(most, tables)
        return cls(most, tuple(64 * i // tables for i in range(tables + 1)), tuple(a if i <= b else a - 1 for i in range(tables)))

    @property
    def balls(self) -> list[int]:
        """Values that each table is probed with, for one fingerprint; 0 for tables that need no probe."""
        return [sum(comb(b - a, k) for k in range(r + 1)) for a, b, r in zip(self.edges, self.edges[1:], self.radii, strict=False)]

    @property
    def probes(self) -> int:
        return sum(self.balls)

    @property
    def share(self) -> float:
        """Part of all pairs that are candidates, if bits are even."""
        return sum(n / 2 ** (b - a) for n, a, b in zip(self.balls, self.edges, self.edges[1:], strict=False))

    def masks(self) -> list[tuple[int, int]]:
        """(table, bits to flip) of every probe."""
        out = []
        for t, (a, b, r) in enumerate(zip(self.edges, self.edges[1:], self.radii, strict=False)):
            out += [(t, sum(-(1 << i) if i == 63 else 1 << i for i in flip)) for k in range(r + 1) for flip in combinations(range(b - a), k)]
        return out

    def piece(self, fingerprint: Column, t: int) -> Column:
        width = self.edges[t + 1] - self.edges[t]
        return F.shiftrightunsigned(fingerprint, self.edges[t]).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


MOST_PROBES = 20_000  # of one fingerprint
PROBE_COST = 2.0  # of a probe or a candidate, in comparisons of a pair that needs no exchange


def best_index(most: int, left: int, right: int, pairs: int) -> Index | None:
    """The tables with the least cost for so many rows and pairs (of equal keys); None if comparing all pairs is cheaper."""
    live = [x for x in (Index.of(most, m) for m in range(1, min(65, most + 2))) if x.probes <= MOST_PROBES]
    cost = lambda x: PROBE_COST * (left * x.probes + right * sum(n > 0 for n in x.balls) + pairs * x.share)
    best = min(live, key=cost, default=None)
    return best if best and cost(best) < pairs else None


def candidates(left: DataFrame, right: DataFrame, most: int, by: list[str] | None = None, index: Index | None = None) -> DataFrame:
    """left_id, right_id, distance of the pairs that some substring table finds, once each: ``left``'s probes equal ``right``'s substrings.

    The probes' flips are a broadcast table of ``index.probes`` rows, ``MOST_PROBES`` at most. A pair is reported from the
    first table that finds it, so no distinct is needed. ``left`` should be the smaller side."""
    keys, index = by or [], index or Index.of(most, 4)
    if index.probes > MOST_PROBES:
        raise ValueError(f"{index.probes} probes for each fingerprint are more than {MOST_PROBES}; use join")
    used = [t for t, n in enumerate(index.balls) if n]

    def side(df: DataFrame, p: str) -> DataFrame:
        pieces = F.array(*[F.struct(F.lit(t).alias("t"), index.piece(F.col("fingerprint"), t).alias("value")) for t in used])
        return df.select(*[F.col(k).alias(f"{p}{k}") for k in keys], F.col("id").alias(f"{p}id"), F.col("fingerprint").alias(f"{p}fp"), F.inline(pieces).alias(f"{p}t", f"{p}value"))

    masks = F.broadcast(left.sparkSession.createDataFrame(index.masks(), "mask_t int, mask long"))
    a = side(left, "l_").join(masks, F.col("l_t") == F.col("mask_t")).withColumn("probe", F.col("l_value").bitwiseXOR(F.col("mask")))
    b = side(right, "r_")
    same = [F.col("l_t") == F.col("r_t"), F.col("probe") == F.col("r_value"), *[F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys]]
    differing = F.col("l_fp").bitwiseXOR(F.col("r_fp"))
    first = F.lit(None).cast("int")
    for t in reversed(used):
        first = F.when(F.bit_count(index.piece(differing, t)) <= index.radii[t], t).otherwise(first)
    d = distance(F.col("l_fp"), F.col("r_fp"))
    pairs = a.join(b, reduce(lambda x, y: x & y, same)).where(F.col("l_t") == first)
    return pairs.select(*[F.col(f"l_{k}").alias(k) for k in keys], F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), d.cast("int").alias("distance"))


def indexed_join(left: DataFrame, right: DataFrame, most: int, by: list[str] | None = None, index: Index | None = None) -> DataFrame:
    """The result of ``theta_join``, from the candidates of a multi-index join."""
    return candidates(left, right, most, by, index).where(F.col("distance") <= most)


def join(left: DataFrame, right: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """left_id, right_id, distance (and the ``by`` keys) of pairs within ``most`` bits, by the cheapest way for the counted rows.

    The counts are by key: one small job. Null keys meet nothing. The larger side is never the one that is probed from."""
    keys = by or []
    one = F.lit(0).alias("one")
    n = lambda df, name: df.groupBy(*keys or [one]).agg(F.count(F.lit(1)).alias(name))
    sizes = n(left, "l").join(n(right, "r"), keys or "one", "full")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    total = sizes.agg(count(F.col("l")).alias("l"), count(F.col("r")).alias("r"), count(F.col("l").cast("double") * F.col("r")).alias("pairs")).first()
    swap = total["l"] > total["r"]
    index = best_index(most, int(min(total["l"], total["r"])), int(max(total["l"], total["r"])), int(total["pairs"]))
    if index is None:
        return theta_join(left, right, most, by)
    found = indexed_join(right, left, most, by, index) if swap else indexed_join(left, right, most, by, index)
    return found.select(*keys, F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), "distance") if swap else found


def histogram(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("distance").agg(F.count(F.lit(1)).alias("n_pairs"))
