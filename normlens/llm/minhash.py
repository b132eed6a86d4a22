"""Near-duplicates by a MinHash LSH forest, confirmed on full shingle sets.

Each document becomes the set of its 5-word shingles (64-bit hashes) and ``VALUES`` MinHash values. Equal sets
collapse to one node first. Then:

1. Forest. Each tree is one sorted order of all nodes, by eight MinHash values that begin with four of its own.
   Neighbours in an order whose longest common prefix is ``MIN_DEPTH`` values or more are candidates; a run of
   them is a region. A region that is too dense for one piece is cut deeper, where its neighbours' common prefix
   is shortest, until each piece fits.
2. Pieces. Signatures of 128 half bytes are compared within each piece; what may be near joins to clusters.
   Pieces of one region, and regions that reach across tasks, then meet slice by slice, but only where their
   clusters differ. So cuts lose no candidates, and a region of copies costs no more than its size.
3. Links. Each cluster's full sets are compared: in one task, or in slices with a few pivots in each. Slices
   whose texts are still in different groups then meet in pairs, until every pair of different groups has met.

Tasks are bounded at every step. Only stars (smallest member, other member) leave them, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlens.llm.common import broadcast_if_small, forget, forget_since, give_back, materialise, mix64, row_batches, tables_now, text_bytes, word_hashes

WORDS = 5
OVER, UNDER = 75, 100  # linked if UNDER * intersection >= OVER * union
TREES = 32
MIN_DEPTH = 4  # values of 16 bits; an order goes on to twice as many
VALUES = TREES * MIN_DEPTH
#: Half bytes, one of each value, that must agree in two signatures: 4.8 standard errors below the mean at the threshold.
NEAR = 75
REGION_ROWS = 4_096  # nodes compared in one piece
SLICE_ROWS = 16_384  # signatures in one slice of a region that was cut
CONFIRM_ROWS = 2_048  # full sets in one slice of a cluster,
CONFIRM_SHINGLES = 1_000_000  # and shingles
PIVOTS = 3
SPREAD = 16  # times as many slices, up to so many, for what needs only a few
FEW_EDGES = 500_000  # up to so many, what nodes look up is broadcast; with more edges, that of hubs is
HUB_EDGES = 200  # of one node

_SHINGLE_FACTORS = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_LENGTH_TERMS = mix64(np.arange(WORDS + 1, dtype=np.uint64) + np.uint64(901))
_MULTIPLIERS = mix64(np.arange(101, 101 + VALUES, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_OFFSETS = mix64(np.arange(501, 501 + VALUES, dtype=np.uint64)).astype(np.uint32)
SKETCH_SCHEMA = "doc_id long, n_shingles long, node long, values binary, short binary"
PAIR_SCHEMA = "a long, b long"


def shingle_sets(raws: list[bytes]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted. Letters A-Z count as a-z.

    With fewer words than a shingle has, the whole sequence is the one shingle; without words the set is empty."""
    words, counts = word_hashes([r.lower() for r in raws])
    sums = words * _SHINGLE_FACTORS[0]
    for j in range(1, WORDS):
        sums[: len(words) - j] += words[j:] * _SHINGLE_FACTORS[j]
    sums = mix64(sums + _LENGTH_TERMS[WORDS])
    out, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            out.append(np.unique(sums[at : at + n - WORDS + 1]))
        elif n:
            short = (words[at : at + n] * _SHINGLE_FACTORS[:n]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(short + _LENGTH_TERMS[n]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def minhash(sets: list[np.ndarray], block: int = 1 << 16) -> np.ndarray:
    """The low 16 bits of the least permuted hash under each of ``VALUES`` permutations, for sets that are not empty."""
    out = np.empty((len(sets), VALUES), dtype=np.uint16)
    at = 0
    while at < len(sets):
        to, size = at + 1, len(sets[at])
        while to < len(sets) and size + len(sets[to]) <= block:
            size += len(sets[to])
            to += 1
        low = np.concatenate(sets[at:to]).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
        place = np.empty_like(low)
        for j in range(VALUES):
            np.multiply(low, _MULTIPLIERS[j], out=place)
            place += _OFFSETS[j]
            out[at:to, j] = np.minimum.reduceat(place, starts)
        at = to
    return out


def short_signature(values: np.ndarray) -> np.ndarray:
    """The low half byte of each value, two to a byte."""
    low = (values & np.uint16(15)).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


def half_bytes(short: list[bytes]) -> np.ndarray:
    """Signatures as columns: one row for each value, so that one is compared with many by adding up rows."""
    packed = np.frombuffer(b"".join(short), dtype=np.uint8).reshape(-1, VALUES // 2)
    return np.ascontiguousarray(np.hstack([packed >> 4, packed & 15]).T)


def node_of(shingles: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    return int.from_bytes(hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (the set's digest), MinHash values, short signature; the last three null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, 4 << 20):
            sets = shingle_sets(text_bytes(batch.column(1)))
            values = minhash([s for s in sets if len(s)])
            whole, short = iter(values.astype("<u2")), iter(short_signature(values))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([next(whole).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(short).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "node", "values", "short"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH_SCHEMA)


def full_sets(docs: DataFrame) -> DataFrame:
    """node and shingles (binary, sorted 64-bit hashes) of each row whose set is not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, 4 << 20):
            sets = [s for s in shingle_sets(text_bytes(batch.column(0))) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                names=["node", "shingles"],
            )

    return docs.select("text").mapInArrow(run, "node long, shingles binary")


def branches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node and tree, its place in the tree's order: the first four values, and the next four.

    A tree begins with four values of its own and goes on with those of another."""
    own = values.reshape(-1, TREES, MIN_DEPTH).astype(np.uint64)
    first = np.zeros(own.shape[:2], dtype=np.uint64)
    for j in range(MIN_DEPTH):
        first = first << np.uint64(16) | own[:, :, j]
    return first.view(np.int64), np.roll(first, -7, axis=1).view(np.int64)


def forest(nodes: DataFrame, region_rows: int = REGION_ROWS) -> DataFrame:
    """piece, node, region: the candidates of all trees.

    All nodes are sorted by tree and values, dealt over tasks by ranges of that order. Runs of neighbours that
    share ``MIN_DEPTH`` values are regions, cut to pieces of at most ``region_rows``. A row has a piece if it has
    company there, and a region if that was cut, or might go on in another task (the first and last of each)."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(-1, VALUES)
            first, then = branches(values)
            tree = np.tile(np.arange(TREES, dtype=np.int32), len(values))
            columns = [tree, first.reshape(-1), then.reshape(-1), np.repeat(batch.column(0).to_numpy(), TREES)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "hi", "lo", "node"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, begun = TaskContext.get().partitionId() << 36, False
        for (tree, hi, lo, node), last in whole_regions(batches):
            new = np.concatenate([[True], (tree[1:] != tree[:-1]) | (hi[1:] != hi[:-1])])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(node)))
            marked = sizes > region_rows
            for at, n in zip(starts[marked].tolist(), sizes[marked].tolist(), strict=True):
                new[[at + x for x in cut_places(lo[at : at + n], region_rows)]] = True
            marked[0] |= not begun
            marked[-1] |= last
            begun = True
            run = np.cumsum(new) - 1
            has_piece = np.bincount(run)[run] > 1
            has_region = np.repeat(marked, sizes)
            region = np.repeat(mix64(mix64(hi[starts]) + tree[starts].astype(np.uint64)).view(np.int64), sizes)
            keep = has_piece | has_region
            yield pa.RecordBatch.from_arrays(
                [pa.array((number + run)[keep], mask=~has_piece[keep]), pa.array(node[keep]), pa.array(region[keep], mask=~has_region[keep])],
                names=["piece", "node", "region"],
            )
            number += int(run[-1]) + 1

    order = ["tree", "hi", "lo", "node"]
    rows = nodes.select("node", "values").mapInArrow(places, "tree int, hi long, lo long, node long")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "piece long, node long, region long")


def whole_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, bool]]:
    """The rows as arrays of four columns that hold whole regions; and whether these are the last."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
        other = np.flatnonzero((now[0] != now[0, -1]) | (now[1] != now[1, -1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield np.concatenate([*held, now[:, :cut]], axis=1), False
            held = []
        elif held and (held[0][:2, 0] != now[:2, 0]).any():
            yield np.concatenate(held, axis=1), False
            held = []
        held.append(now[:, cut:])
    if held:
        yield np.concatenate(held, axis=1), True
    give_back()


def cut_places(lo: np.ndarray, most: int) -> list[int]:
    """Where a region's pieces begin. Cuts go between neighbours with the shortest common prefix that leaves pieces
    of at most ``most`` rows; neighbours with all values in common are cut by number."""
    code, out = lo.view(np.uint64), []

    def split(a: int, b: int, depth: int) -> None:
        if depth == MIN_DEPTH:
            out.extend(range(a, b, most))
            return
        level = code[a:b] >> np.uint64(16 * (MIN_DEPTH - 1 - depth))
        starts = [a, *(np.flatnonzero(level[1:] != level[:-1]) + a + 1).tolist()]
        begin = None
        for s, e in zip(starts, [*starts[1:], b], strict=True):
            if e - s > most:
                if begin is not None:
                    out.append(begin)
                begin = None
                split(s, e, depth + 1)
            elif begin is None:
                begin = s
            elif e - begin > most:
                out.append(begin)
                begin = s
        if begin is not None:
            out.append(begin)

    split(0, len(lo), 0)
    return out


class Groups:
    """Connected groups of 0..n-1, by labels, so that whole arrays can be compared at once."""

    def __init__(self, label: np.ndarray):
        self.label = label

    def join(self, i: int, others: np.ndarray) -> None:
        found = np.unique(self.label[others])
        found = found[found != self.label[i]]
        if len(found):
            self.label[np.isin(self.label, found)] = self.label[i]

    def stars(self, names: np.ndarray) -> list[tuple[int, int]]:
        """(smallest name, other name) of each group of two or more."""
        order = np.argsort(self.label, kind="stable")
        label, name = self.label[order], names[order]
        starts = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        least = np.repeat(np.minimum.reduceat(name, starts), np.diff(np.append(starts, len(name))))
        other = least != name
        return list(dict.fromkeys(zip(least[other].tolist(), name[other].tolist(), strict=True)))


def near_pairs(short: np.ndarray, side: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the rows after it of other labels that agree in ``NEAR`` values or more.

    Rows are sorted by side: those of side 0 meet those of side 1, and those of side 2 meet each other.
    ``label`` is read at each step, so it may change between them."""
    n, first = short.shape[1], int(np.count_nonzero(side == 0))
    for i in range(first or n - 1):
        at = max(first, i + 1)
        rest = short[:, at:] == short[:, i, None]
        same = np.add.reduce(rest.view(np.uint8), axis=0, dtype=np.uint8)
        near = np.flatnonzero((same >= NEAR) & (label[at:] != label[i]))
        if len(near):
            yield i, near + at


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each run of rows with the same first column; rows come sorted by it."""
    held: list[list] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        key, at = columns[0], 0
        for i in range(1, len(key) + 1):
            if i == len(key) or key[i] != key[at]:
                piece = [c[at:i] for c in columns]
                if held and held[0][0] == piece[0][0]:
                    for old, new in zip(held, piece, strict=True):
                        old.extend(new)
                else:
                    if held:
                        yield held
                    held = piece
                at = i
    if held:
        yield held
    give_back()


def near_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What may be near inside each task's group, as stars. Columns: task, side, node, label, short."""
    out: list[tuple[int, int]] = []
    for _, side, node, label, short in runs(batches):
        if len(node) > 1:
            groups = Groups(np.unique(label, return_inverse=True)[1])
            for i, others in near_pairs(half_bytes(short), np.array(side), groups.label):
                groups.join(i, others)
            out += groups.stars(np.array(node))
        if len(out) > 10_000:
            yield _pairs_batch(out)
            out = []
    if out:
        yield _pairs_batch(out)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets overlap enough."""
    if UNDER * min(len(a), len(b)) < OVER * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return UNDER * common >= OVER * (len(both) - common)


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links confirmed on full sets inside each task's group, as stars. Columns: task, side, node, label, short, shingles."""
    for _, side, node, label, short, shingles in runs(batches):
        sets = [np.frombuffer(s, dtype="<u8") for s in shingles]
        groups = Groups(np.unique(label, return_inverse=True)[1])
        for i, others in near_pairs(half_bytes(short), np.array(side), groups.label):
            while len(others := others[groups.label[others] != groups.label[i]]):
                if linked(sets[i], sets[others[0]]):
                    groups.join(i, others[:1])
                others = others[1:]
        pairs = groups.stars(np.array(node))
        if pairs:
            yield _pairs_batch(pairs)


def by_task(rows: DataFrame) -> DataFrame:
    return rows.repartition("task").sortWithinPartitions("task", "side")


def slices_for(load: Column) -> Column:
    """Number of slices, before rounding: the load itself, but a small load is spread over more tasks."""
    return F.greatest(load, F.least(F.lit(float(SPREAD)), load * SPREAD))


def crossed(members: DataFrame) -> DataFrame | None:
    """task, side, node, label: all that has one key but different labels meets in some task; None if nothing does.

    ``members`` has key, label, node and load, the share of a slice that a node fills. Labels that fill half a
    slice get slices of their own, which do not meet each other; the other labels are dealt over slices whole."""
    labels = members.groupBy("key", "label").agg(F.sum("load").alias("load"))
    totals = labels.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("load").alias("total")).where("labels > 1")
    totals = materialise(totals.select("key", (slices_for(F.col("total")) / F.col("total")).alias("factor")), "cross-totals")
    if totals.isEmpty():
        return None
    labels = labels.join(broadcast_if_small(totals), "key").withColumn("load", F.col("load") * F.col("factor"))
    labels = materialise(labels.withColumn("own", F.when(F.col("load") > 0.5, F.ceil("load")).otherwise(F.lit(0)).cast("long")), "cross-loads")
    few = F.broadcast if labels.count() <= FEW_EDGES else (lambda df: df)
    rest = F.sum(F.when(F.col("own") == 0, F.col("load")).otherwise(F.lit(0.0)))
    keys = labels.groupBy("key").agg(F.ceil(rest).cast("long").alias("rest"), F.sum("own").alias("owned"))
    before = F.sum("own").over(Window.partitionBy("key").orderBy("label").rowsBetween(Window.unboundedPreceding, -1))
    big = labels.where("own > 0").select("key", "label", "own", F.coalesce(before, F.lit(0)).alias("before"))
    placed = members.join(few(keys), "key").join(few(big), ["key", "label"], "left")
    begin = F.col("rest") + F.col("before")
    dealt = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("label"), F.greatest("rest", F.lit(1)))).otherwise(begin + F.pmod(F.xxhash64("node"), F.col("own")))
    every = placed.withColumn("slice", dealt).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest") + F.col("owned") - 1)))
    every = every.where(F.col("own").isNull() | (F.col("other") < begin) | (F.col("other") >= begin + F.col("own")))
    side = F.when(F.col("slice") == F.col("other"), 2).when(F.col("slice") < F.col("other"), 0).otherwise(1)
    return every.select(F.xxhash64("key", F.least("slice", "other"), F.greatest("slice", "other")).alias("task"), side.alias("side"), "node", "label")


def near_clusters(nodes: DataFrame, region_rows: int = REGION_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """node and root of all that the forest finds and signatures call near, joined to clusters."""
    found = materialise(forest(nodes, region_rows), "forest")
    short = nodes.select("node", "short")
    inside = found.where(F.col("piece").isNotNull()).select(F.col("piece").alias("task"), F.lit(2).alias("side"), "node", F.col("node").alias("label"))
    stars = by_task(inside.join(short, "node").select("task", "side", "node", "label", "short")).mapInArrow(near_stars, PAIR_SCHEMA)
    clusters = materialise(components(stars), "clusters")
    across = found.where(F.col("region").isNotNull()).join(clusters, "node", "left")
    across = across.select(F.col("region").alias("key"), "node", F.coalesce("root", "node").alias("label"), F.lit(1 / slice_rows).alias("load"))
    tasks = crossed(materialise(across, "across"))
    if tasks is None:
        return clusters
    more = materialise(by_task(tasks.join(short, "node").select("task", "side", "node", "label", "short")).mapInArrow(near_stars, PAIR_SCHEMA), "across-stars")
    if more.isEmpty():
        return clusters
    return components(more.unionByName(clusters.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))))


def _content(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def with_least(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """``edges`` with the m of their u, from a table of u, m and n, the number of its edges.

    A table of few rows is broadcast. Of a larger one only the hubs are, so a hub's edges never meet in one task."""
    if few:
        return edges.join(F.broadcast(least.select("u", "m")), "u")
    least = materialise(least, "least")
    hubs = broadcast_if_small(least.where(F.col("n") > HUB_EDGES).select("u", "m"))
    others = edges.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= HUB_EDGES).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(others)


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of a link, by star rounds.

    ``links`` has columns a and b; rows with a null or with a = b name no node. A hub's neighbours are never
    gathered: each round takes minima by node, and looks those of hubs up in a small table. The number of rounds
    grows with the logarithm of the nodes."""
    links = links.where("a <> b")
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    content = _content(edges)
    count = F.count(F.lit(1)).alias("n")
    while content[0]:
        # Large star: every larger neighbour of u goes to the least neighbour of u.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), count)
        few = content[0] <= FEW_EDGES
        large = with_least(both.where(F.col("v") > F.col("u")), least, few).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours go to the least of them.
        if not few:
            large = materialise(large.distinct(), "large-star")
        moved = with_least(large, large.groupBy("u").agg(F.min("v").alias("m"), count), few)
        arrows = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        after = moved.select(arrows).select("e.*").where(F.col("u") != F.col("v")).distinct()
        after = materialise(after, "links")
        forget(edges)
        edges, before = after, content
        content = _content(edges)
        if content == before:
            break
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def confirmed_links(docs: DataFrame, members: DataFrame, confirm_rows: int = CONFIRM_ROWS) -> DataFrame:
    """root and node (root <> node) of the groups that links on full sets make inside each cluster.

    ``members`` has root (the cluster), node, least_id, n_shingles and short."""
    members = materialise(members.withColumn("load", F.lit(1 / confirm_rows) + F.col("n_shingles") / F.lit(float(CONFIRM_SHINGLES))), "members")
    pivots = F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(PIVOTS)]))
    sizes = members.groupBy("root").agg(F.sum("load").alias("total"), F.count(F.lit(1)).alias("n"), pivots.alias("pivots"))
    sizes = sizes.select("root", F.ceil(slices_for(F.col("total"))).cast("long").alias("slices"), "pivots", "n")
    large = materialise(sizes.where("slices > 1 AND n > 2").drop("n"), "large-clusters")

    def links(tasks: DataFrame) -> DataFrame:
        """Stars of the confirmed links of each task; only texts that some task wants are read."""
        wanted = materialise(tasks.select("node").distinct().join(members.select("node", "least_id"), "node").select("least_id").distinct(), "wanted")
        own = docs.select("doc_id", "text").join(broadcast_if_small(wanted), F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi")
        sets = full_sets(own).groupBy("node").agg(F.any_value("shingles").alias("shingles"))
        shipped = tasks.join(members.select("node", "short"), "node").join(sets, "node")
        return by_task(shipped.select("task", "side", "node", "label", "short", "shingles")).mapInArrow(confirm, PAIR_SCHEMA)

    two = F.lit(2).alias("side")
    marked = broadcast_if_small(large)
    tasks = members.join(marked, "root", "left_anti").select(F.col("root").alias("task"), two, "node", F.col("node").alias("label"))
    several = not large.isEmpty()
    if several:
        slice_of = lambda place: F.xxhash64("root", place).alias("task")
        dealt = members.join(marked, "root").select(slice_of(F.pmod(F.xxhash64("node"), F.col("slices"))), two, "node", F.col("node").alias("label"))
        every = large.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        shown = every.select(slice_of(F.col("place")), two, F.explode("pivots").alias("node")).withColumn("label", F.col("node"))
        tasks = tasks.unionByName(dealt.unionByName(shown).distinct())
    found = materialise(links(tasks), "confirmed")
    named = found.select(F.col("a").alias("root"), F.col("b").alias("node"))
    if not several:
        return named
    named = materialise(components(found), "named")
    groups = members.join(marked, "root").select(F.col("root").alias("key"), "node", "load").join(named, "node", "left")
    groups = materialise(groups.select("key", "node", F.coalesce("root", "node").alias("label"), "load"), "groups")
    rest = crossed(groups)
    named = named.where("node <> root").select("root", "node")
    if rest is None:
        return named
    more = materialise(links(materialise(rest, "rest")), "across-links")
    if more.isEmpty():
        return named
    return components(more.unionByName(named.select(F.col("root").alias("a"), F.col("node").alias("b")))).where("node <> root").select("root", "node")


def near_duplicates(
    docs: DataFrame, region_rows: int = REGION_ROWS, slice_rows: int = SLICE_ROWS, confirm_rows: int = CONFIRM_ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    component_id is the smallest doc_id among the documents reachable by links, itself included; kept says
    that it is the row's own. Null and empty texts and texts without words have an empty set and link with
    nothing; texts of any length are read whole, in segments. Repeated rows have equal results. A row with a null id takes part in links but cannot name a
    component, and is not kept. Extra columns of ``docs`` are not looked at; an empty table gives no rows. The
    three limits bound what one task holds; the result does not depend on them.
    """
    begun = tables_now()
    sketches = materialise(sketch(docs), "sketches")
    nodes = sketches.where(F.col("node").isNotNull()).groupBy("node")
    any_of = lambda name: F.any_value(name).alias(name)
    nodes = nodes.agg(F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n_shingles"), any_of("values"), any_of("short"))
    nodes = materialise(nodes, "nodes")

    clusters = near_clusters(nodes, region_rows, slice_rows)
    members = clusters.join(nodes.select("node", "least_id", "n_shingles", "short"), "node")
    named = materialise(confirmed_links(docs, members, confirm_rows), "named")
    ends = named.unionByName(named.select("root", F.col("root").alias("node")).distinct())
    least = ends.join(nodes.select("node", "least_id"), "node")
    roots = least.groupBy("root").agg(F.min("least_id").alias("of_links"))
    found = nodes.select("node", "least_id").join(ends.join(roots, "root").select("node", "of_links"), "node", "left")
    found = materialise(found.select("node", F.coalesce("of_links", "least_id").alias("found")), "components")
    forget_since(begun, sketches, found)
    joined = sketches.select("doc_id", "n_shingles", "node").join(found, "node", "left")
    component = F.coalesce("found", "doc_id")
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )
