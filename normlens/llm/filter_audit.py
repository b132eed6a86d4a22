"""Audit of how five text filters act together, by a Walsh-Hadamard transform.

Each document has a mask of the filters that it fails. For each part and label the 32 signed parity sums

    W[S] = sum over documents of (-1) ** |mask & S|

are taken in one aggregation, so that what leaves a task is 96 numbers a part. The transform is its own inverse
but for a factor of 32: the number of documents with mask m is sum over S of (-1) ** |m & S| * W[S] / 32, exactly.
From these cells follow all 120 orders of the filters. A document that fails k filters is removed by each of them
first in 120 / k orders, which gives the Shapley sums in closed form.

Whether a text repeats that of a smaller id is found on digests: equal rows are counted first, then rows of a text
within a part, so a text that a third of the table shares is a few rows when the texts meet.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlens.llm.common import WORD

FILTERS = "ABCDE"
FEW_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
SIGNS = "[#$%&*|]"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
NULL_SPREAD = 1_024  # null ids match no label; they are dealt out over so many values


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D, which need the text alone: few words, repeated words, capitals, signs."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [
        n < FEW_WORDS,
        100 * distinct < DISTINCT_PERCENT * n,
        100 * capitals > CAPITAL_PERCENT * F.length(text),
        text.rlike(SIGNS),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: the number of documents of each kind.

    Repeated rows of a text with one id are each a document, and none repeats the other. A null id is not comparable, so
    it neither fails E nor makes another fail; it has no label. A document is good or toxic if any label of its id says so."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text).alias("mask"))
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    says = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)
    labels = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(says("quality"), says("toxic"))
    labels = labels.where("quality OR toxic").withColumn("label_salt", F.lit(0).cast("long"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_SPREAD))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("salt", salt).join(labels, (F.col("doc_id") == F.col("label_id")) & (F.col("salt") == F.col("label_salt")), "left")
    kind = [F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    same = rows.groupBy("digest", "part", "mask", *kind).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    originals = F.col("without_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    same = same.withColumn("first", first).withColumn("originals", originals)
    repeat = 1 << FILTERS.index("E")
    both = F.array(
        F.struct(F.col("mask"), F.col("originals").alias("n")),
        F.struct((F.col("mask") + repeat).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
    )
    return same.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", "good", "toxic", "x.n").where("n > 0")


def parity_sums(counts: DataFrame) -> DataFrame:
    """part and the arrays all, good, toxic of its 32 signed parity sums."""

    def signed(weight: Column) -> Column:
        sign = lambda s: 1 - 2 * F.pmod(F.bit_count(F.col("mask").bitwiseAND(F.lit(s))), F.lit(2))
        return F.array(*[F.sum(weight * sign(s)) for s in range(MASKS)])

    n = F.col("n")
    return counts.groupBy("part").agg(
        signed(n).alias("all"),
        signed(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        signed(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"),
    )


def _over_masks(term) -> Column:
    """The sum of ``term(mask)`` over all masks."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda total, m: total + term(m))


def _for_masks(term) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), term)


def cells(sums: Column) -> Column:
    """The number of documents of each mask, from the parity sums: the same transform, divided by 32."""
    sign = lambda m, s: 1 - 2 * F.pmod(F.bit_count(m.bitwiseAND(s)), F.lit(2))
    return _for_masks(lambda m: F.shiftright(_over_masks(lambda s: F.get(sums, s) * sign(m, s)), len(bin(MASKS)) - 3))


def passing(cell: Column) -> Column:
    """For each set of filters, the number of documents that pass all of them."""
    return _for_masks(lambda m: _over_masks(lambda x: F.when(m.bitwiseAND(x) == 0, F.get(cell, x)).otherwise(F.lit(0).cast("long"))))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part, each of the 120 orders and each of its 5 steps. ``part`` is the source, null as ''. A null
    text is an empty one: it fails A, and is the same text as any other empty one. Texts of any length are read whole.
    An empty table gives no rows; without labels nothing is lost that was good or toxic. Other columns are not read."""
    found = parity_sums(masked(docs, labels))
    found = found.select("part", *[cells(F.col(c)).alias(c) for c in ("all", "good", "toxic")])
    fails = lambda i: _over_masks(lambda m: F.when(m.bitwiseAND(F.lit(1 << i)) != 0, F.get("all", m)).otherwise(F.lit(0).cast("long")))
    orders = len(ORDERS)
    share = lambda i: _over_masks(
        lambda m: F.when(m.bitwiseAND(F.lit(1 << i)) != 0, F.get("all", m) * F.floor(F.lit(orders) / F.greatest(F.lit(1), F.bit_count(m)))).otherwise(F.lit(0).cast("long"))
    )
    each = range(len(FILTERS))
    found = found.select(
        "part",
        *[passing(F.col(c)).alias(f"pass_{c}") for c in ("all", "good", "toxic")],
        F.array(*[fails(i) for i in each]).alias("fails"),
        F.array(*[F.get("all", F.lit(1 << i)) for i in each]).alias("unique"),
        F.array(*[share(i) for i in each]).alias("shapley"),
    )
    bit = lambda letter: F.element_at(F.array(*[F.lit(1 << i) for i in each]), F.instr(F.lit(FILTERS), letter))
    order = F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order")
    rows = found.select("*", order).select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter"))
    earlier = F.slice(F.split("filter_order", ""), F.lit(1), F.col("place"))
    rows = rows.withColumn("step", F.col("place") + 1).withColumn("at", F.instr(F.lit(FILTERS), F.col("letter")) - 1)
    rows = rows.withColumn("before", F.aggregate(earlier, F.lit(0), lambda a, x: a + bit(x)))
    rows = rows.withColumn("after", F.col("before") + bit(F.col("letter")))
    gone = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("pass_all", F.col("after")).alias("kept"),
        gone("pass_all").alias("removed"),
        (F.get("fails", F.col("at")) - gone("pass_all")).alias("redundant"),
        F.get("unique", F.col("at")).alias("unique_fails"),
        gone("pass_good").alias("good_lost"),
        gone("pass_toxic").alias("toxic_lost"),
        F.get("shapley", F.col("at")).alias("shapley"),
    )
