"""Inverted multi-index: a codebook for each half of the vectors, whose product is a grid of cells.

A vector may have a neighbour in a cell if the plane between its own and the cell's centre is near, in both halves: the sum of the squared
distances from these planes is the cell's cost. Cells are visited in the order of their cost, as the multi-sequence algorithm does, up to
the cost at which the target share of neighbours at exactly the threshold has been met; such neighbours are made in random directions from
the rows of the fit. A pair is met from either side, so the cost is that of the cheaper way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Centres of a codebook at most, rows of the fit a centre, made neighbours, and rounds of the fit.
CENTRES, FIT_ROWS_A_CENTRE, MADE, ROUNDS = 1024, 32, 40_000, 8


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, whatever the numbers' size."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _costs(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def codebook(x: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """Centres by k-means, in an order in which near ones are mostly near each other."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(size, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = _costs(x, centres).argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.r_[0, np.cumsum(n)[:-1]], len(x) - 1), axis=0) if x.shape[1] else np.zeros_like(centres)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres[_ordered(centres)]


def _ordered(x: np.ndarray) -> np.ndarray:
    """Places of rows, halved again and again across the direction of their largest spread."""
    if len(x) < 3 or not x.shape[1]:
        return np.arange(len(x))
    c = x - x.mean(axis=0)
    along = np.argsort(c @ np.linalg.svd(c, full_matrices=False)[2][0], kind="stable")
    a, b = along[: len(along) // 2], along[len(along) // 2 :]
    return np.concatenate([a[_ordered(x[a])], b[_ordered(x[b])]])


@dataclass
class Grid:
    """Two codebooks and the cost up to which cells are visited."""

    halves: tuple[np.ndarray, np.ndarray]
    limit: float = 0.0

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.halves[0]), len(self.halves[1])

    def costs(self, vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half: own centres, and squared distances from the planes to all others."""
        cut, owns, planes = vectors.shape[1] // 2, [], []
        for x, c in zip((vectors[:, :cut], vectors[:, cut:]), self.halves, strict=True):
            d = _costs(x, c)
            own = d.argmin(axis=1)
            apart = 2 * np.sqrt(np.maximum(_costs(c, c), 0))
            i = np.arange(len(x))
            with np.errstate(divide="ignore", invalid="ignore"):
                h = np.where(apart[own] > 1e-9, (d - d[i, own][:, None]) / apart[own], 0)
            h[i, own] = 0
            owns.append(own)
            planes.append(h * h)
        return owns, planes

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        (a, b), _ = self.costs(vectors)
        return a * self.shape[1] + b

    def visited(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that rows visit, nearest first. Of the multi-sequence walk with a limit of cost no queue is needed: in the
        grid of both halves' sorted costs, what it visits is, for each cost of the first half, a beginning of the second."""
        _, (x, y) = self.costs(vectors)
        ox, oy = np.argsort(x, axis=1, kind="stable"), np.argsort(y, axis=1, kind="stable")
        x, y = np.take_along_axis(x, ox, axis=1), np.take_along_axis(y, oy, axis=1)
        rows, cells, costs = [], [], []
        for i in range(x.shape[1]):
            on = np.nonzero(x[:, i] <= self.limit)[0]
            if not len(on):
                break
            total = x[on, i][:, None] + y[on]
            r, j = np.nonzero(total <= self.limit)
            rows.append(on[r])
            cells.append(ox[on[r], i] * self.shape[1] + oy[on[r], j])
            costs.append(total[r, j])
        rows, cells, costs = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (rows, cells, costs))
        order = np.lexsort((costs, rows))
        return rows[order], cells[order]


def size_for(vectors: int, occupancy: float = 4.0) -> int:
    """Centres of a half for so many vectors: a power of two, at which a cell has about `occupancy` of them."""
    return int(min(CENTRES, 2 ** max(0, round(np.log2(max(1.0, vectors / occupancy)) / 2))))


def fit(sample: np.ndarray, vectors: int, threshold: float, target: float, seed: int = 7) -> Grid:
    """The grid for so many unit vectors, from a sample of them."""
    cut, size = sample.shape[1] // 2, size_for(vectors)
    grid = Grid((codebook(sample[:, :cut], size, seed), codebook(sample[:, cut:], size, seed + 1)))
    rng = np.random.default_rng(seed)
    found = []
    for at in range(0, MADE, 4_000):  # in parts, so that little memory is taken
        q = sample[rng.integers(len(sample), size=min(4_000, MADE - at))]
        u = rng.normal(size=q.shape)
        u -= (u * q).sum(axis=1)[:, None] * q
        u /= np.maximum(np.sqrt((u * u).sum(axis=1)), 1e-300)[:, None]
        near = threshold * q + np.sqrt(max(0.0, 1 - threshold**2)) * u
        (a, b), (x, y) = grid.costs(q)
        (c, d), (z, w) = grid.costs(near)
        i = np.arange(len(q))
        found.append(np.minimum(x[i, c] + y[i, d], z[i, a] + w[i, b]))
    grid.limit = float(np.quantile(np.concatenate(found), target)) + 1e-12
    return grid


def packed(counts: np.ndarray, shape: tuple[int, int], block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first region, regions) of each cell with rows, and how many regions there are: neighbouring cells share a region of about `block`
    rows, a cell of more has several. Cells are taken in the order of interleaved places, so that regions are compact."""
    a, b = (v.astype(np.uint64) for v in np.divmod(np.arange(len(counts)), shape[1]))
    code = np.zeros(len(counts), np.uint64)
    for bit in range(11):
        one = np.uint64(1)
        code |= ((a >> np.uint64(bit)) & one) << np.uint64(2 * bit + 1) | ((b >> np.uint64(bit)) & one) << np.uint64(2 * bit)
    first, parts = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // block))
    region = filled = 0
    for cell in np.argsort(code, kind="stable").tolist():
        n = int(counts[cell])
        if not n:
            first[cell], parts[cell] = -1, 0
            continue
        if filled and filled + n > block:
            region, filled = region + 1, 0
        first[cell] = region
        region, filled = (region + int(parts[cell]), 0) if parts[cell] > 1 else (region, filled + n)
    return first, parts, region + 1
