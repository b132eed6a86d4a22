"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

Everything here is DataFrame expressions. Sizes are summed by source and by shard of a source; targets
come from the weights by water-filling; whole blocks go to sources, then to each source's shards, by the
highest quotients v / (2 s + 1); last, each shard takes its quota from its documents in a seeded order.
Only (document, size) rows move, and the only windows are over a shard's documents, a source's shards
and the list of sources. A source of n documents is dealt over shards of 2,000 or, if that is more, the root of n,
so neither a shard's documents nor a source's shards are ever more than one task sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlens.llm.common import WORD, materialise

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # the mix holds 3/2 of all words
MOST = 2  # times a document's or a source's size
BLOCK = 64  # words, or fewer if the smallest source has not
BLOCKS = 64  # of that size
SHARD_DOCS = 2_000
SEED = 7
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also weight and target (words of the mix).

    Sources rank by code point, null last, and weigh ``WEIGHTS`` in turn. A source's target is the water
    level times its weight, at most ``MOST`` times its size: the fixed point of resharing what is above
    the caps by weight. Caps are met in the order of cap / weight, so the level follows from running sums.
    The window is over sources, not documents.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy((F.col("source_size") / F.col("weight")).asc(), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    running = (
        ranked.withColumn("weight", weight.cast("long"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # Were this source the first that stays under its cap, the level would be rest / (2 left).
    rest = F.lit(SHARE[0]) * F.col("total") - F.lit(SHARE[1] * MOST) * F.col("full")
    capped = rest * F.col("weight") >= F.lit(SHARE[1] * MOST) * F.col("source_size") * F.col("left")
    marked = running.withColumn("rest", rest).withColumn("capped", capped)
    level = (F.min(F.when(~F.col("capped"), F.struct("order", "rest", "left"))).over(every)).alias("level")
    marked = marked.withColumn("order", F.row_number().over(order)).withColumn("level", level)
    open_target = F.col("level.rest") * F.col("weight") / (F.lit(SHARE[1]) * F.col("level.left")).cast("double")
    is_open = F.col("level").isNotNull() & (F.col("order") >= F.col("level.order"))
    target = F.when(is_open, open_target).otherwise((F.lit(MOST) * F.col("source_size")).cast("double"))
    return marked.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(rows: DataFrame, by: list[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: the seats of each row among the rows of its group ``by``, by highest quotients.

    ``seats`` is the group's number of seats, a column. With n rows, V votes and M seats, all quotients
    above V / (M - n/2) win and none below V / (M + n/2) does; only the quotients between, about 2 n in
    a group and two more of each row, are listed and ranked. Ties go to the smaller key (nulls last). No votes, no seats.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    v, m, n = F.col(votes).cast("double"), F.col(seats).cast("double"), F.col("_n").cast("double")
    share = F.when(F.col("_all") > 0, v / F.col("_all")).otherwise(F.lit(0.0))
    sure = F.greatest(F.lit(0), F.ceil(share * (m - n / 2) - 1.5)).cast("long")  # a seat on either side covers rounding
    most = F.greatest(F.lit(0), F.floor(share * (m + n / 2) + 1.5)).cast("long")
    bounds = (
        rows.withColumn("_all", F.sum(v).over(group))
        .withColumn("_n", F.count(F.lit(1)).over(group))
        .withColumn("_sure", F.when(m - n / 2 > 0, sure).otherwise(F.lit(0)).cast("long"))
        .withColumn("_most", F.greatest(most, F.col("_sure")))
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(group))
    )
    listed = bounds.withColumn("_s", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_most") - 1))))
    ranked = listed.withColumn(
        "_rank",
        F.row_number().over(group.orderBy((v / (2 * F.col("_s") + 1)).desc_nulls_last(), F.col(key).asc_nulls_last())),
    )
    won = F.sum(F.when(F.col("_s").isNotNull() & (F.col("_rank") <= F.col("_open")), 1).otherwise(0))
    kept = [c for c in rows.columns if c not in by and c != key]
    return (
        ranked.groupBy(*by, key)
        .agg(*[F.first(c).alias(c) for c in kept], F.first("_sure").alias("_sure"), won.alias("_won"))
        .withColumn(out, F.col("_sure") + F.col("_won"))
        .drop("_sure", "_won")
    )


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, source, size, source_size, target (its source's), taken: words that the mix takes.

    Size counts words; a null text has none. Null is a source of its own, last in order. Each source gets a
    target, each shard a quota of blocks, all of ``block`` words, or of a ``BLOCKS``-th part of the smallest source
    that has words, if that is less. In a shard, documents stand in the order of a
    seeded hash and are cut into blocks as one stream; each block is taken ``quota div blocks`` times and
    the first ``quota mod blocks`` of that order once more. So a document is taken at most ``MOST`` times
    its size, and a source misses its target by half a block a shard and one partial block a shard at most.
    Repeated rows are documents of their own; they share a seeded place and are told apart by their size
    only, which cannot change the sums. A null id has the place of ''. A text of any length is counted whole, whatever its
    share of the source. An empty table gives no rows; other columns are not looked at.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("place"))
    sized = materialise(sized, "sizes")  # else each of the three uses below counts the words again
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = source_targets(sources.select("source", "source_size"))
    targets = targets.join(
        sources.select(F.col("source").alias("s2"), "docs"), F.col("source").eqNullSafe(F.col("s2"))
    ).drop("s2", "weight")
    every = Window.partitionBy(F.lit(0))
    least = F.coalesce(F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(every), F.lit(0))
    targets = targets.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(least / BLOCKS))).cast("long"))
    blocks = F.ceil(F.lit(SHARE[0]) * F.sum("source_size").over(every) / (F.lit(SHARE[1]) * F.col("block")).cast("double") - 0.5).cast("long")
    quotas = sainte_lague(targets.withColumn("blocks", blocks), [], "source", "target", "blocks", "quota")
    shards = F.greatest(F.lit(1), F.ceil(F.col("docs") / F.greatest(F.lit(float(shard_docs)), F.sqrt("docs")))).cast("long")
    quotas = quotas.select(F.col("source").alias("s2"), "source_size", "target", "quota", "block", shards.alias("shards"))
    if sources.count() <= BROADCAST_SOURCES:  # with more, the join shuffles and AQE splits hot sources
        quotas = F.broadcast(quotas)

    number = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    placed = sized.join(quotas, F.col("source").eqNullSafe(F.col("s2"))).withColumn("shard", number % F.col("shards"))
    shard_sizes = placed.groupBy(F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"), "shard").agg(
        F.sum("size").alias("shard_size"), F.first("quota").alias("quota")
    )
    shard_quotas = sainte_lague(shard_sizes, ["key", "none"], "shard", "shard_size", "quota", "shard_quota")
    shard_quotas = shard_quotas.select(
        F.col("key").alias("k2"), F.col("none").alias("n2"), F.col("shard").alias("h2"), "shard_size", "shard_quota"
    )
    within = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    streamed = placed.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    match = (
        (F.coalesce("source", F.lit("")) == F.col("k2")) & (F.col("source").isNull() == F.col("n2")) & (F.col("shard") == F.col("h2"))
    )
    joined = streamed.join(shard_quotas, match)
    n_blocks = F.ceil(F.col("shard_size") / F.col("block").cast("double")).cast("long")
    quota = F.least(F.col("shard_quota"), F.lit(MOST) * n_blocks)
    times = F.when(n_blocks > 0, F.floor(quota / n_blocks)).otherwise(F.lit(0)).cast("long")
    edge = (quota - times * n_blocks) * F.col("block")
    more = F.greatest(F.lit(0), F.least(F.col("size"), edge - F.col("at")))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", (times * F.col("size") + more).cast("long").alias("taken")
    )
