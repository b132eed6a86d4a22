"""A bank of vectors laid out by cells for one task: the best inner product of each query, exact, without comparing all pairs.

The kernel behind ``nearest``: products are taken in tiles of a fixed size, whatever the batch and the bank. If the bank's vectors
have unit length, they lie sorted by k-means cells, and a cell is left out for the queries whose bound it does not reach: with
all its vectors within angle r of its centroid, none has an inner product above cos(a - r) with a query at angle a; nor is any
nearer than the plane midway between its centroid and the query's nearest. On vectors without structure the bounds admit most cells; such queries are compared with the whole bank.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DIGITS = 9
NEAR = 2 * 10.0**-DIGITS  # rounding moves a value by half a unit, so only what is this near to the greatest can be equal to it
MARGIN = 1e-7  # added to bounds, above what rounding and angles of unit vectors can err
TILE_QUERIES, TILE_BANK = 256, 2_048
PLANE_QUERIES = 64  # whose products with all centroids stay in the processor's memory
LEAST_ROWS = 2_048  # a smaller bank has no cells
MOST_CELLS = 4_096
SAMPLE_OF_CELL = 16  # vectors of the sample for each cell
ROUNDS = 3
DENSE = 0.5  # share of the bank to be compared from which all of it is


def cells_for(rows: int) -> int:
    """Half the root of the bank's rows: bounds leave few cells to a query, and a visit has a cost of its own."""
    return min(MOST_CELLS, int(rows**0.5 / 2)) if rows >= LEAST_ROWS else 0


def at_least(s: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns, in their order, of what reaches its row's ``floor``; on flat places, which are found in a fraction of the time."""
    return np.divmod(np.flatnonzero(s >= floor[:, None]), s.shape[1])


def own_cells(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of the nearest centroid (the smaller on ties at ``DIGITS``) and the angle to it, in tiles."""
    cell, angle = np.empty(len(vectors), dtype=np.int64), np.empty(len(vectors))
    for at in range(0, len(vectors), TILE_QUERIES * 4):
        s = vectors[at : at + TILE_QUERIES * 4] @ centroids.T
        own = s.argmax(axis=1)
        row, col = at_least(s, s[np.arange(len(s)), own] - NEAR)
        order = np.lexsort((col, -np.round(s[row, col], DIGITS), row))
        row, col = row[order], col[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        own[row[first]] = col[first]
        cell[at : at + len(s)], angle[at : at + len(s)] = own, np.arccos(np.clip(s[np.arange(len(s)), own], -1, 1))
    return cell, angle


def lloyd(vectors: np.ndarray, start: np.ndarray, rounds: int) -> np.ndarray:
    """Unit centroids after ``rounds`` of spherical k-means; a cell without vectors keeps its centroid."""
    centroids = start.copy()
    for _ in range(rounds if len(vectors) else 0):
        own = own_cells(vectors, centroids)[0]
        order = np.argsort(own, kind="stable")
        live, first = np.unique(own[order], return_index=True)
        for j, mine in zip(live, np.split(vectors[order], first[1:]), strict=True):
            total = mine.sum(axis=0)
            length = np.linalg.norm(total)
            if length > 1e-12:
                centroids[j] = total / length
    return centroids


def are_units(vectors: np.ndarray) -> np.ndarray:
    return np.abs(np.einsum("ij,ij->i", vectors, vectors) - 1) < 1e-9


def reaching(queries: np.ndarray, near: np.ndarray, centroids: np.ndarray, radii: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cells, in the order of rows: the cells besides the nearest, ``near``, that may hold what reaches a query's ``best``.

    Queries, centroids and what the cells hold have unit length. What lies in another cell is on that side of the plane midway
    to the nearest centroid, so at least as far off as the plane; and it lies within the cell's radius (an angle)."""
    rows, cells = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(queries), PLANE_QUERIES):
        q, own = queries[at : at + PLANE_QUERIES], near[at : at + PLANE_QUERIES]
        reach = 2 * (2 - 2 * best[at : at + PLANE_QUERIES, None] + MARGIN)
        s = q @ centroids.T
        gap = (s[np.arange(len(s)), own] - MARGIN / 2)[:, None] - s
        np.maximum(gap, 0, out=gap)
        np.multiply(gap, gap, out=gap)
        gap += (centroids[own] * reach) @ centroids.T  # the squared distance of both centroids, times that of what is sought, is reach - this
        row, cell = np.divmod(np.flatnonzero(gap <= reach + 1e-12), s.shape[1])
        reached, cos_r, sin_r = np.clip(s[row, cell], -1, 1), np.cos(radii[cell]), np.sin(radii[cell])
        bound = np.where(reached >= cos_r, 1.0, reached * cos_r + np.sqrt(1 - reached * reached) * sin_r)
        kept = (bound + MARGIN >= best[at + row]) & (cell != own[row])
        rows.append(at + row[kept])
        cells.append(cell[kept])
    return np.concatenate(rows), np.concatenate(cells)


def raise_best(where: np.ndarray, best: np.ndarray, rows: np.ndarray, queries: np.ndarray, bank: np.ndarray, ids: np.ndarray) -> None:
    """Raises ``best`` and ``where`` of the queries ``rows`` by the vectors of ``bank``, in tiles; the smaller id wins ties."""
    for a in range(0, len(rows), TILE_QUERIES):
        mine = rows[a : a + TILE_QUERIES]
        q = queries[mine]
        for b in range(0, len(bank), TILE_BANK):
            s = q @ bank[b : b + TILE_BANK].T
            most = s.max(axis=1)
            live = np.flatnonzero(most >= best[mine] - NEAR)  # few, once a query has met some tiles
            if not len(live):
                continue
            row, col = at_least(s if len(live) == len(s) else s[live], np.maximum(most, best[mine])[live] - NEAR)
            row = live[row]
            value, found = np.round(s[row, col], DIGITS), ids[b + col]
            if len(row) > 1 and (row[1:] == row[:-1]).any():
                order = np.lexsort((found, -value, row))
                row, value, found = row[order], value[order], found[order]
                first = np.concatenate([[True], row[1:] != row[:-1]])
                row, value, found = row[first], value[first], found[first]
            at = mine[row]
            better = (value > best[at]) | ((value == best[at]) & (found < where[at]))
            best[at[better]], where[at[better]] = value[better], found[better]


@dataclass
class Layout:
    """``vectors`` and ``ids`` by cell; cell j lies from ``first[j]`` to ``first[j + 1]``. Without centroids there are no cells."""

    ids: np.ndarray
    vectors: np.ndarray
    centroids: np.ndarray
    first: np.ndarray
    radii: np.ndarray

    def best(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best bank id and rounded similarity of each query."""
        where, best = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), -np.inf)
        every = np.arange(len(queries))
        if len(self.centroids):
            every = self._pruned(queries, where, best)
        raise_best(where, best, every, queries, self.vectors, self.ids)
        return where, best

    def _visit(self, where: np.ndarray, best: np.ndarray, queries: np.ndarray, rows: np.ndarray, cell: np.ndarray) -> None:
        order = np.argsort(cell, kind="stable")
        live, start = np.unique(cell[order], return_index=True)
        for j, mine in zip(live, np.split(rows[order], start[1:]) if len(live) else (), strict=True):
            of = slice(self.first[j], self.first[j + 1])
            raise_best(where, best, mine, queries, self.vectors[of], self.ids[of])

    def _pruned(self, queries: np.ndarray, where: np.ndarray, best: np.ndarray) -> np.ndarray:
        """The nearest cell of each query, then those that its bound admits; the queries that are left to compare with all."""
        units = np.flatnonzero(are_units(queries))
        rest = [np.flatnonzero(~are_units(queries))]
        own = own_cells(queries[units], self.centroids)[0]
        self._visit(where, best, queries, units, own)
        sizes = np.diff(self.first)
        visits = [(np.zeros(0, dtype=np.int64),) * 2]
        for at in range(0, len(units), TILE_QUERIES):
            mine = units[at : at + TILE_QUERIES]
            row, cell = reaching(queries[mine], own[at : at + len(mine)], self.centroids, self.radii, best[mine])
            if sizes[cell].sum() > DENSE * len(self.ids) * len(mine):
                rest.append(mine)
            else:
                visits.append((mine[row], cell))
        rows, cells = (np.concatenate(x) for x in zip(*visits, strict=True))
        self._visit(where, best, queries, rows, cells)
        return np.concatenate(rest)


def plain(ids: np.ndarray, vectors: np.ndarray) -> Layout:
    """A layout without cells."""
    return Layout(ids, vectors, np.zeros((0, 1)), np.zeros(1, dtype=np.int64), np.zeros(0))


def placed(ids: np.ndarray, vectors: np.ndarray, centroids: np.ndarray, cell: np.ndarray, angle: np.ndarray) -> Layout:
    """The layout of vectors whose cells are known; empty cells are dropped."""
    order = np.argsort(cell, kind="stable")
    live, first = np.unique(cell[order], return_index=True)
    radii = np.maximum.reduceat(angle[order], first)
    return Layout(ids[order], vectors[order], centroids[live], np.append(first, len(ids)), radii)


def laid_out(ids: np.ndarray, vectors: np.ndarray) -> Layout:
    """The layout of a part of a bank that one task holds."""
    cells = cells_for(len(ids))
    if not cells or not are_units(vectors).all():
        return plain(ids, vectors)
    sample = vectors[:: max(1, len(ids) // (cells * SAMPLE_OF_CELL))]
    centroids = lloyd(sample, sample[:: max(1, len(sample) // cells)][:cells], ROUNDS)
    return placed(ids, vectors, centroids, *own_cells(vectors, centroids))
