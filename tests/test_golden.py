"""Published facts and boundary cases of the semantics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from normlens.functions import paths
from normlens.operators import bank, cells, errors, files, geometry, hamming, latency, metrics, nearest, percentiles, scoring, sieve, sweeps, timing


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, y_true int")


def test_half_even_split_of_the_published_totals(spark):
    totals = {"a": 363, "b": 80, "c": 40, "d": 108, "e": 75, "f": 330, "g": 58, "h": 15, "i": 92, "j": 225, "k": 54, "one": 1, "three": 3}
    want = {"a": 182, "b": 40, "c": 20, "d": 54, "e": 38, "f": 165, "g": 29, "h": 8, "i": 46, "j": 112, "k": 27, "one": 0, "three": 2}
    rows = [(f"{t}/{i:04}", t) for t, n in totals.items() for i in range(n)]
    split = files.stratified_split(spark.createDataFrame(rows, "path string, defect_type string"))
    got = {r[0]: r[1] for r in split.groupBy("defect_type").agg(F.sum((F.col("part") == "validation").cast("int"))).collect()}
    assert got == want


@pytest.mark.parametrize(("score", "label"), [(0.49, "good"), (0.50, "defect"), (0.80, "defect"), (None, None)])
def test_label_boundary(spark, score, label):
    row = spark.createDataFrame([(score,)], "s double").select(scoring.label_from_score(F.col("s"), F.lit(0.5))).first()
    assert row[0] == label


@pytest.mark.parametrize(("size", "cells"), [((1000, 700), 704), ((333, 999), 320), ((256, 256), 1024), ((640, 481), 768)])
def test_letterbox_cells_equal_pooling(spark, size, cells):
    boxes = geometry.letterbox(spark.createDataFrame([size], "width int, height int"))
    assert geometry.valid_cells(boxes).count() == cells
    b = boxes.first()
    mask = np.zeros((256, 256))
    mask[b.pad_top : b.pad_top + b.new_height, b.pad_left : b.pad_left + b.new_width] = 1
    pooled = mask.reshape(32, 8, 32, 8).mean(axis=(1, 3))
    got = np.zeros((32, 32))
    for r in geometry.cells(boxes).collect():
        got[r.row, r.col] = r.valid_ratio
    assert (got == pooled).all()


@pytest.mark.parametrize(
    ("tn", "fp", "fn", "tp", "precision", "recall", "f1"), [(104, 78, 34, 505, 0.8662, 0.9369, 0.9002), (110, 71, 33, 505, 0.8767, 0.9387, 0.9066)]
)
def test_published_rates(spark, tn, fp, fn, tp, precision, recall, f1):
    r = metrics.with_rates(spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")).first()
    assert (round(r.precision, 4), round(r.recall, 4), round(r.f1, 4)) == (precision, recall, f1)


def test_published_sizes(spark):
    row = spark.range(1).select(bank.size_mb(F.lit(729792), F.lit(384)), bank.target_size(F.lit(729792)), bank.target_size(F.lit(744000)), bank.target_size(F.lit(3))).first()
    assert (round(row[0], 2), row[1], row[2], row[3]) == (1069.03, 72979, 74400, 1)


def test_throughput(spark):
    log = spark.createDataFrame([("x", 24.166)], "stage string, ms double")
    assert round(latency.throughput(log, ["stage"]).first().per_second, 2) == 41.38


def test_p95_is_linear(spark):
    log = spark.createDataFrame([("x", float(i)) for i in range(1, 5)], "stage string, ms double")
    assert latency.summarize(log, ["stage"]).first().p95 == pytest.approx(3.85)


def test_zero_denominators_and_single_class(spark):
    r = metrics.with_rates(spark.createDataFrame([(0, 0, 0, 0)], "tn long, fp long, fn long, tp long")).first()
    assert [r.precision, r.recall, r.f1, r.fpr, r.fnr] == [0.0] * 5
    assert metrics.auroc(scored(spark, [(0.1, 1), (0.2, 1)])).first().auroc is None
    assert metrics.auroc(scored(spark, [])).first() is None or metrics.auroc(scored(spark, [])).first().auroc is None
    assert metrics.average_precision(scored(spark, [(0.1, 0)])).first().average_precision is None
    assert metrics.best_f1_threshold(scored(spark, [])).count() == 0
    assert metrics.threshold_for_recall(scored(spark, [(0.1, 0)])).count() == 0


def test_ties_of_thresholds(spark):
    rows = scored(spark, [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0), (0.6, 0), (0.5, 1), (None, 1), (0.4, None)])
    points = {round(r.threshold, 1): r for r in metrics.pr_curve(rows).collect()}
    f1 = {t: 2 * r.precision * r.recall / (r.precision + r.recall) for t, r in points.items()}
    best = max(f1.values())
    assert metrics.best_f1_threshold(rows).first().threshold == min(t for t, v in f1.items() if abs(v - best) < 1e-12)
    tied = scored(spark, [(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 0)] + [(0.95, 1)] * 38)
    assert metrics.threshold_for_recall(tied).first().threshold == 0.95  # the highest of equal precision
    sweep = sweeps.linear_sweep(tied, 11)
    chosen = sweeps.sweep_choices(sweep).where("choice = 'high_recall'").first()
    assert chosen.threshold == min(r.threshold for r in sweep.collect() if r.recall >= 0.95 and r.precision == chosen.precision)


def test_auroc_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(float(s), int(y)) for s, y in zip(rng.integers(0, 20, 200), rng.integers(0, 2, 200), strict=True)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert metrics.auroc(scored(spark, rows)).first().auroc == pytest.approx(want)


@pytest.mark.parametrize("steps", [2, 7, 500])
def test_linear_sweep_counts(spark, steps):
    rng = np.random.default_rng(steps)
    rows = [(float(s), int(y)) for s, y in zip(np.round(rng.normal(size=150), 2), rng.integers(0, 2, 150), strict=True)]
    for r in sweeps.linear_sweep(scored(spark, rows), steps).collect():
        assert (r.tp, r.fp) == (sum(s >= r.threshold and y == 1 for s, y in rows), sum(s >= r.threshold and y == 0 for s, y in rows))


def test_histogram_top_bin_is_closed(spark):
    rows = scored(spark, [(0.0, 0), (1.0, 1), (1.0, 1), (0.5, 0)])
    top = sweeps.histogram_sweep(rows, 4).orderBy(F.desc("bin")).first()
    assert (top.bin, top.tp, top.fp, top.dice) == (3, 2, 0, 1.0)
    one = sweeps.histogram_sweep(scored(spark, [(2.0, 1), (2.0, 0)]), 4).first()
    assert (one.bin, one.tp, one.fp) == (0, 1, 1)


def test_retention_of_an_empty_mask(spark):
    row = geometry.retention(spark.createDataFrame([(0, 0), (10, 0), (10, 5)], "o int, k int"), "o", "k").collect()
    assert [(r.retention_ratio, r.loss_ratio, r.fully_lost) for r in row] == [(0.0, 1.0, False), (0.0, 1.0, True), (0.5, 0.5, False)]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    q, b = rng.normal(size=(40, 8)), rng.normal(size=(30, 8))
    b[7] = b[3]  # a tie goes to the smaller id
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "id long, v array<double>")
    want = {i: (int(s.argmax()), s.max()) for i, s in enumerate(np.round(q @ b.T, 9))}
    for found in (nearest.nearest(frame(q), frame(b)), nearest.blocked(frame(q).where("v is not null"), frame(b).where("v is not null"), 7, 9)):
        got = {r.query_id: (r.bank_id, r.similarity) for r in found.collect()}
        assert {i: b for i, (b, _) in got.items()} == {i: b for i, (b, _) in want.items()}
        assert all(abs(got[i][1] - s) < 1e-9 for i, (_, s) in want.items())
    assert nearest.nearest(frame(q), frame(b).where("id < 0")).count() == 0


def test_greedy_never_repeats():
    copies = np.ones((6, 4)) / 2
    order, _ = bank.greedy(np.arange(6), copies, 6)
    assert sorted(order) == list(range(6))
    assert len(bank.greedy(np.arange(2), copies[:2], 9)[0]) == 2


def test_banded_join_equals_theta_join(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 30)
    flipped = [int(x) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 7), replace=False)) for x in base]
    frame = lambda xs: spark.createDataFrame([(i, int(x), i % 2) for i, x in enumerate(xs)], "id long, fingerprint long, g int")
    for most in (0, 4, 20):
        a, b = (sorted(map(tuple, f(frame(base), frame(flipped), most, ["g"]).collect())) for f in (hamming.theta_join, hamming.banded_join))
        assert a == b
    assert hamming.theta_join(frame(base), frame(flipped), 4).count() > 0


def test_banded_join_leaves_small_bands_to_theta_join(spark):
    rows = spark.createDataFrame([(i, (i * 2654435761) % (1 << 62), i % 2) for i in range(60)], "id long, fingerprint long, g int")
    a, b = (sorted(map(tuple, f(rows, rows, 30, ["g"]).collect())) for f in (hamming.theta_join, hamming.banded_join))
    assert a == b and "bits" not in hamming.banded_join(rows, rows, 30, ["g"])._jdf.queryExecution().toString()


def test_farthest_first_in_rounds(spark):
    """The picks do not depend on how many candidates a round has, and are those of a greedy loop."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(150, 3))
    v[40:80] = v[:40]  # copies, and with few dimensions many near ties
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = rng.permutation(1000)[:150]
    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)] + [(5000, None)], "id long, v array<double>").repartition(3)
    order = np.argsort(ids)
    for picks in (1, 40, 150):
        places, similarity = bank.greedy(ids[order], v[order], picks)
        for few in (1, 7, 4096) if picks < 150 else (64,):
            got = bank.farthest_first(rows, picks=picks, candidates=few).orderBy("pick").collect()
            assert [r.id for r in got] == ids[order][places].tolist() and [r.pick for r in got] == list(range(picks))
            assert got[0].similarity is None and [r.similarity for r in got[1:]] == pytest.approx(similarity[1:])
    assert bank.farthest_first(rows, picks=900).count() == 150 and bank.farthest_first(rows.where("id = 5000")).count() == 0


def near_prints(spark, n, seed):
    rng = np.random.default_rng(seed)
    left = [(i, int(i % 3), int(x)) for i, x in enumerate(rng.integers(-(2**63), 2**63, n, dtype=np.int64))]
    right = []
    for i, p, x in left:
        flips = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 24), replace=False))
        right.append((1000 + i, p if i % 5 else None, (x ^ flips) - (1 << 64) if (x ^ flips) >= 1 << 63 else x ^ (flips - (1 << 64) if flips >= 1 << 63 else flips)))
    frame = lambda rows: spark.createDataFrame(rows, "id long, product int, fingerprint long")
    return frame(left), frame(right + [(2000, 0, left[0][2]), (2001, 0, left[0][2]), (2002, 1, None)])


@pytest.mark.parametrize(("most", "tables"), [(0, 1), (1, 1), (4, 3), (8, 4), (14, 4), (14, 5), (20, 5), (22, 6), (63, 64)])
def test_indexed_join_equals_theta_join(spark, most, tables):
    left, right = near_prints(spark, 40, most)
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    index = hamming.Index.of(most, tables)
    assert len(index.masks()) == index.probes
    for by in (["product"], None):
        want = key(hamming.theta_join(left, right, most, by))
        assert key(hamming.indexed_join(left, right, most, by, index)) == want and want
        assert key(hamming.join(left, right, most, by)) == key(hamming.join(left.union(left.limit(0)), right, most, by)) == want


def test_index_follows_from_the_counts():
    assert hamming.best_index(20, 100, 100, 10_000) is None
    index = hamming.best_index(8, 10**6, 10**8, 10**14)
    assert index.share < 0.01 and index.probes < 5_000 and hamming.Index.of(4, 5).radii == (0,) * 5
    assert hamming.best_index(14, 10**6, 10**8, 10**14).share < 0.2 and hamming.best_index(40, 10**6, 10**8, 10**14) is None
    with pytest.raises(ValueError, match="probes"):
        hamming.candidates(None, None, 40, None, hamming.Index.of(40, 3))


def test_coreset_of_many_parts(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = bank.distributed_coreset(rows, 0.1, part_rows=30).collect()
    assert len({r.id for r in got}) == len(got) and abs(len(got) - 40) <= 6 and len({r.pick for r in got}) == len(got)
    picked = v[[r.id for r in got]]
    cover = (v @ picked.T).max(axis=1).min()
    random_cover = np.median([(v @ v[rng.choice(400, len(got), replace=False)].T).max(axis=1).min() for _ in range(20)])
    assert cover > random_cover


def unit_rows(spark, v, first=0):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").cache()


def test_cells_recall_and_pairs(spark, tmp_path):
    """Clustered vectors: near cells have what is near; vectors without structure need most cells."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 16))
    near = lambda n: middles[rng.integers(0, 40, n)] + 0.25 * rng.normal(size=(n, 16))
    exact = lambda q, b: {r.query_id: r.bank_id for r in nearest.nearest(q, b).collect()}
    bank, queries = unit_rows(spark, near(3000)), unit_rows(spark, near(300), 10_000)
    index = cells.build(bank, 40, f"{tmp_path}/index", sample_rows=1000)
    want = exact(queries, bank)
    got = {r.query_id: r.bank_id for r in cells.search(queries, index, 3).collect()}
    share = cells.compared(queries, index, 3).first()
    assert len(got) == 300 and sum(want[q] == b for q, b in got.items()) / 300 >= 0.9
    assert share.n_pairs == 900_000 and share.n_compared < 0.25 * share.n_pairs
    pruned = cells.compared(queries, index).first()
    assert pruned.n_compared < 0.5 * pruned.n_pairs
    again = cells.load(spark, f"{tmp_path}/index")
    assert {r.query_id: r.bank_id for r in cells.exact(queries, again).collect()} == want and again.sizes.sum() == 3000
    bank, queries = unit_rows(spark, rng.normal(size=(1500, 16))), unit_rows(spark, rng.normal(size=(150, 16)), 10_000)
    index, want = cells.build(bank, 20), exact(queries, bank)
    got = {r.query_id: r.bank_id for r in cells.search(queries, index, 14).collect()}
    assert sum(want[q] == b for q, b in got.items()) / 150 >= 0.9
    assert {r.query_id: r.bank_id for r in cells.exact(queries, index).collect()} == want


def test_cells_edges(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 4))
    v[20:50] = v[0]  # a hot cell of copies, in several blocks
    bank = unit_rows(spark, v).union(spark.createDataFrame([(99, None)], "id long, v array<double>"))
    queries = unit_rows(spark, np.vstack([v[:10], rng.normal(size=(30, 4))]), 1000).union(spark.createDataFrame([(5000, None)], "id long, v array<double>"))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    for n in (1, 3, 200):
        index = cells.build(bank, n, rounds=2)
        assert key(cells.exact(queries, index)) == key(nearest.nearest(queries, bank)) == key(cells.search(queries, index, 200))
    assert cells.exact(queries, cells.build(bank.where("id = 99"), 3)).count() == 0


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0, 2.0, 7.5], 25), "c": np.array([3.0]), None: rng.exponential(size=64) * 1e6}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("d", None)]
    shares = {"low": 0.0, "quarter": 0.25, "mid": 0.5, "high": 0.95, "top": 1.0}
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in percentiles.percentiles(percentiles.tally(df, ["g"], "x"), ["g"], "x", shares).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert [got[g][n] for n in shares] == pytest.approx([np.quantile(v, p) for p in shares.values()])
    whole = percentiles.percentiles(percentiles.tally(df, [], "x", ("g",)), [], "x", shares).first()
    every = np.concatenate(list(groups.values()))
    assert [whole[n] for n in shares] == pytest.approx([np.quantile(every, p) for p in shares.values()])
    assert percentiles.with_percentiles(df, ["g"], "x", {"mid": 0.5}, percentiles.weighted("x")).where("g = 'd'").first().mid is None


def test_outliers_leave_parts_even(spark):
    """One huge value, and a heavy tail: each part of the order still has its share of the distinct values."""
    rows = spark.range(200_000).select(F.when(F.col("id") == 7, 1e9).otherwise(F.exp(F.col("id") / 20_000)).alias("ms"), F.lit("s").alias("stage"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows share one part
    try:
        counts = percentiles.tally(rows, ["stage"], "ms")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in counts.groupBy("bin").count().collect()]
    assert sum(sizes) == 200_000 and len(sizes) >= 3 and max(sizes) < 2 * 200_000 / len(sizes)
    want = np.quantile(np.append(np.delete(np.exp(np.arange(200_000) / 20_000), 7), 1e9), [0.5, 0.95])
    got = latency.summarize(rows, ["stage"]).first()
    assert [got.median, got.p95] == pytest.approx(want.tolist()) and got.max == 1e9


def test_roc_corners(spark):
    """Points equal those of second differences over the whole curve; the area is that of all points."""
    rng = np.random.default_rng(6)
    rows = [(float(x), int(rng.random() < x / 60)) for x in rng.integers(0, 60, 90)] + [(100.0 + i, 1) for i in range(9)] + [(-1.0 - i, 0) for i in range(9)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(r) for r in metrics.roc_corners(scored(spark, rows)).where("threshold IS NOT NULL").collect()), reverse=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    levels = sorted({s for s, _ in rows}, reverse=True)
    tp = np.array([sum(s >= t and y for s, y in rows) for t in levels])
    fp = np.array([sum(s >= t and not y for s, y in rows) for t in levels])
    keep = np.r_[True, (np.diff(fp, 2) != 0) | (np.diff(tp, 2) != 0), True]
    assert got == [(t, f / fp[-1], p / tp[-1]) for t, f, p, k in zip(levels, fp, tp, keep, strict=True) if k] and not keep.all()
    x, y = np.array([0, *(r[1] for r in got)]), np.array([0, *(r[2] for r in got)])
    assert np.trapezoid(y, x) == pytest.approx(metrics.auroc(scored(spark, rows)).first().auroc)
    assert metrics.roc_corners(scored(spark, [(1.0, 1)])).count() == 2 and metrics.roc_corners(scored(spark, [])).count() == 1


def test_measured_stages(spark, tmp_path):
    from normlens.scratch import Scratch

    calls = []
    stages = lambda n: [("a", lambda made: calls.append(n) or spark.range(n).select("id", F.col("id").cast("double").alias("x"))), ("b", lambda made: made["a"].where("id > 0"))]
    with Scratch(spark) as scratch:
        log, results = timing.measure(spark, {"one": stages(5), "two": stages(4)}, scratch, runs=2, warm_up=1)
        rows = log.collect()
        assert calls == [5, 4] * 3 and len(rows) == 2 * 2 * 3 and {r.run for r in rows} == {0, 1}
        assert {(r.variant, r.stage, r.n_rows) for r in rows} == {("one", "a", 5), ("one", "b", 4), ("one", "total", 4), ("two", "a", 4), ("two", "b", 3), ("two", "total", 3)}
        total = {(r.variant, r.run): r.ms for r in rows if r.stage == "total"}
        assert all(total[v, k] == pytest.approx(sum(r.ms for r in rows if (r.variant, r.run) == (v, k) and r.stage != "total")) for v, k in total)
        assert latency.summarize(log, ["variant", "stage"]).count() == 6
        assert {tuple(r) for r in timing.agreement(results, "id", "x").collect()} == {("one", 4, 1.0), ("two", 3, 0.75)}
        assert len(scratch.paths) == 2
    assert scratch.paths == []


def test_stored_filter(spark):
    """No key is missed; few others pass; the exact join gives the rows of the plain one, and is left out where nothing passes."""
    digest = lambda k: F.sha2(k.cast("string"), 256)
    train = spark.range(20_000).select(digest(F.col("id")).alias("sha256"))
    test = spark.range(15_000, 45_000).select(F.concat(F.lit("p"), F.col("id")).alias("path"), F.when(F.col("id") % 97 > 0, digest(F.col("id"))).alias("sha256"))
    stored = sieve.build(train.union(train.limit(50)), "sha256").cache()
    assert stored.count() == stored.first().blocks == 10 and stored.where("length(bits) <> 4096").count() == 0
    asked = sieve.ask(test, "sha256", stored)
    known = asked.join(train.distinct(), "sha256", "left_semi")
    assert asked.count() == 30_000 and known.count() == known.where("maybe").count() > 4_900
    wrong = asked.where("maybe").count() - known.count()
    assert 0 <= wrong < 250  # below one in a hundred
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.select("path", "sha256").collect())))
    assert key(sieve.without_leaks_sieved(test, train, stored)) == key(files.without_leaks(test, train))
    unread = train.select(F.raise_error(F.lit("train was read")).cast("string").alias("sha256"))
    far = test.where("sha256 IS NULL")
    assert key(sieve.without_leaks_sieved(far, unread, stored)) == key(far) and far.count() > 300
    none = sieve.build(train.where("sha256 IS NULL"), "sha256")
    assert none.count() == 0 and key(sieve.without_leaks_sieved(test, unread, none)) == key(test)


def test_bilinear_against_numpy(spark):
    from normlens.sources.pixels import bilinear

    grid = np.arange(16.0).reshape(4, 4) ** 2
    rows = spark.createDataFrame([(0, r, c, float(grid[r, c])) for r in range(4) for c in range(4)], "image_id int, row int, col int, value double")
    want = bilinear(grid, 8, 8)
    got = geometry.bilinear_upsample(rows, 4, 2).collect()
    assert len(got) == 64 and all(abs(want[r.row, r.col] - r.value) < 1e-9 for r in got)


def test_split_and_product_from_paths(spark):
    rows = spark.createDataFrame([("cable/train/good/1.PNG",), ("x/test/ground_truth/2.bmp",), ("y/other/3.txt",), ("bare",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in rows.select(paths.split_of(p), paths.product_of(p), paths.parent_of(p), paths.is_image(p)).collect()]
    assert got == [("train", "cable", "good", True), ("test", "x", "ground_truth", True), ("unknown", "y", "other", False), ("unknown", "bare", None, False)]


def test_guards(spark):
    a = spark.createDataFrame([("h1",), ("h2",)], "sha256 string")
    b = spark.createDataFrame([("h2",)], "sha256 string")
    files.assert_no_overlap({"a": a, "b": b.where("sha256 = 'x'")})
    with pytest.raises(ValueError, match="a and b"):
        files.assert_no_overlap({"a": a, "b": b})
    with pytest.raises(ValueError, match="not normal"):
        files.assert_all_normal(spark.createDataFrame([(1,)], "label int"))


def test_manifest_needs_masks(spark):
    rows = spark.createDataFrame([("p/test/cut/1.png", "cut", "1", "h", "test")], "path string, defect_type string, stem string, sha256 string, split string")
    assert files.make_manifest(rows, strict=False).first().mask_path is None
    with pytest.raises(Exception, match="no mask for"):
        files.make_manifest(rows).collect()


def test_errors_overall(spark):
    rows = errors.with_errors(spark.createDataFrame([("a", 1, 0.9), ("a", 1, 0.1), ("b", 1, 0.6), ("good", 0, 0.9)], "t string, y_true int, score double"), 0.5)
    got = {r.t: (r.total, r.tp, r.fn) for r in errors.overall_and_by_type(rows, "t").collect()}
    assert got == {"(all)": (3, 2, 1), "a": (2, 1, 1), "b": (1, 1, 0)}


def test_images_without_valid_patches(spark):
    images = spark.createDataFrame([(1,), (2,)], "image_id int")
    assert [r[0] for r in scoring.images_without_patches(images, spark.createDataFrame([(1, 0.5)], "image_id int, score double")).collect()] == [2]
