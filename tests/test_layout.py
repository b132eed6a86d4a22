"""The kernel of nearest neighbours: exact on any bank, in tiles of memory, and with few pairs where vectors have structure."""

import tracemalloc

import numpy as np
import pytest

from normlens.operators import cells, layout, nearest


def units(rng, n, dims):
    v = rng.normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("dims", (4, 12, 64))
def test_layout_against_brute_force(dims):
    """Copies within and across cells, zero vectors and vectors of other lengths included."""
    rng = np.random.default_rng(dims)
    bank, queries = units(rng, 5_000, dims), units(rng, 400, dims)
    bank[2_500:2_900] = bank[7]
    queries[:20], queries[20], queries[21] = bank[7], 0, 3 * queries[21]
    ids = np.sort(rng.permutation(20_000)[:5_000])
    s = np.round(queries @ bank.T, 9)
    for made in (layout.laid_out(ids, bank), layout.plain(ids, bank)):
        where, best = made.best(queries)
        assert (where == ids[s.argmax(axis=1)]).all() and np.abs(best - s.max(axis=1)).max() < 1e-12
    bank[3] *= 2  # no unit vectors, no cells
    assert not len(layout.laid_out(ids, bank).centroids)
    assert (layout.laid_out(ids, bank).best(queries)[0] == ids[np.round(queries @ bank.T, 9).argmax(axis=1)]).all()


def test_memory_does_not_grow_with_the_batch():
    rng = np.random.default_rng(1)
    bank, queries = units(rng, 20_000, 16), units(rng, 6_000, 16)
    made = layout.laid_out(np.arange(20_000), bank)
    tracemalloc.start()
    made.best(queries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # a matrix of 6,000 x 8,192 alone takes 393 MB


def test_few_pairs_on_the_sphere(monkeypatch):
    rng = np.random.default_rng(2)
    made, pairs = layout.laid_out(np.arange(40_000), units(rng, 40_000, 4)), []
    whole = layout.raise_best
    monkeypatch.setattr(layout, "raise_best", lambda where, best, rows, queries, bank, ids: pairs.append(len(rows) * len(bank)) or whole(where, best, rows, queries, bank, ids))
    made.best(units(rng, 2_000, 4))
    assert sum(pairs) < 0.05 * 2_000 * 40_000


def bent(rng, n):
    """Unit vectors of 12 dimensions on a sheet of three, dense in its middle and thin outside, so that cells have wide radii."""
    t = rng.normal(size=(n, 3)) * rng.choice([0.05, 0.3], (n, 1))
    v = np.hstack([t + 1, np.sin(3 * t), t**2, np.abs(t)])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_planes_leave_few_cells(monkeypatch):
    """Balls of neighbouring cells overlap, so that they alone admit ten cells and more here; the planes between centroids do not."""
    rng, pairs = np.random.default_rng(11), []
    bank, queries = bent(rng, 30_000), bent(rng, 1_000)
    made = layout.laid_out(np.arange(30_000), bank)
    whole = layout.raise_best
    monkeypatch.setattr(layout, "raise_best", lambda where, best, rows, queries, bank, ids: pairs.append((len(rows), len(bank))) or whole(where, best, rows, queries, bank, ids))
    where, best = made.best(queries)
    s = np.round(queries @ bank.T, 9)
    assert (where == s.argmax(axis=1)).all() and np.abs(best - s.max(axis=1)).max() < 1e-12
    assert sum(n for n, _ in pairs) < 5 * 1_000


def test_cells_are_read_in_one_pass(spark, monkeypatch):
    """Bounds and the choice of the way come from a broadcast part of the bank; samples are the same with a bound on their hashes."""
    monkeypatch.setattr(nearest, "CELL_ROWS", 50)
    met, meet = [], cells._meet
    monkeypatch.setattr(cells, "_meet", lambda visits, index: met.append(len(index.sizes)) or meet(visits, index))
    rng = np.random.default_rng(12)
    bank, queries = bent(rng, 2_000), bent(rng, 90)
    frame = lambda v: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    monkeypatch.setattr(nearest, "FLOOR_BYTES", 40_000)  # a fifth of the bank
    got = {r.query_id: r.bank_id for r in nearest.nearest(frame(queries), frame(bank), limit_bytes=0).collect()}
    assert got == dict(enumerate(np.round(queries @ bank.T, 9).argmax(axis=1).tolist())) and met == [40]
    monkeypatch.setattr(nearest, "FLOOR_BYTES", 1)
    assert {r.query_id: r.bank_id for r in nearest.nearest(frame(queries), frame(bank), limit_bytes=0).collect()} == got
    with_rows, without = (cells.fit_centroids(frame(bank), 8, 60, 2, rows=n) for n in (2_000, 0))
    assert (with_rows == without).all() and (cells.fit_centroids(frame(bank), 8, 60, 2, rows=10**7) == without).all()
    assert [nearest.cell_count(n) for n in (100, 2_000, 14_000_000)] == [2, 40, 531]


def test_tiles_that_cannot_win_are_not_searched(monkeypatch):
    """A tile's places are sought for the queries that it can raise; nearly equal values go to the smaller id or cell, as rounded."""
    rng, sought = np.random.default_rng(3), []
    bank, queries = units(rng, 40_000, 64), units(rng, 256, 64)
    bank[30_000:30_010], bank[39_999] = queries[0], queries[0]
    bank[35_000] = queries[1] * (1 + 1e-10)
    bank[35_001] = queries[1]
    seek = layout.at_least
    monkeypatch.setattr(layout, "at_least", lambda s, floor: sought.append(len(s)) or seek(s, floor))
    where, _ = layout.plain(np.arange(40_000), bank).best(queries)
    assert (where == np.round(queries @ bank.T, 9).argmax(axis=1)).all() and (where[0], where[1]) == (30_000, 35_000)
    assert sum(sought) < 0.4 * 256 * 20  # 20 tiles
    centroids = np.vstack([bank[:50], bank[:50] * (1 + 1e-11)])
    assert (layout.own_cells(bank, centroids)[0] == np.round(bank @ centroids.T, 9).argmax(axis=1)).all()


def test_blocks_do_not_copy_the_other_side_more_often_as_tables_grow():
    assert [nearest.block_count(n, 64, nearest.BLOCK_ROWS) for n in (30, 128, 16_000, 200_000)] == [1, 2, 4, 4]
    assert nearest.block_count(10 * nearest.BLOCK_ROWS, 64, nearest.BLOCK_ROWS) == 10


@pytest.mark.parametrize("dims", (4, 64))
def test_large_bank_keeps_every_query(spark, monkeypatch, dims):
    """An id may stand for several queries, as patch 3 does in every image; by cells in 4 dimensions, by blocks in 64."""
    monkeypatch.setattr(nearest, "CELL_ROWS", 50)
    ways = []
    monkeypatch.setattr(nearest, "blocked", lambda *a, way=nearest.blocked: ways.append("blocked") or way(*a))
    rng = np.random.default_rng(dims)
    bank, queries = units(rng, 3_000, dims), units(rng, 120, dims)
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(bank)], "id long, v array<double>")
    q = spark.createDataFrame([(i % 4, v.tolist(), i) for i, v in enumerate(queries)], "id long, v array<double>, image long")
    want = np.round(queries @ bank.T, 9)
    got = nearest.nearest(q, b, limit_bytes=0, keep=("image",)).collect()
    assert sorted((r.image, r.query_id, r.bank_id) for r in got) == [(i, i % 4, int(s.argmax())) for i, s in enumerate(want)]
    assert ways == (["blocked"] if dims == 64 else [])
