"""Blocks of points that lie close together, for searches that run in NumPy where the points are."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

GROUP, TILE, LINES = 512, 128, 200  # so few that their pairs stay in a core's cache


def _spread(v: np.ndarray) -> np.ndarray:
    """The lower 31 bits with a zero between each two."""
    v = v.astype(np.uint64)
    for shift, mask in ((32, 0x00000000FFFFFFFF), (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def blocks(x: np.ndarray, y: np.ndarray, size: float, rows: int) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
    """Row numbers, ascending, in blocks of up to ``rows`` along a Z-curve over cells of ``size``; and the blocks' boxes (x0, y0, x1, y1)."""
    cell = lambda v: np.minimum((v - v.min()) / size, 2.0**31 - 1)
    order = np.argsort(_spread(cell(x)) | (_spread(cell(y)) << np.uint64(1)), kind="stable")
    starts = np.arange(0, len(x), rows)
    return [np.sort(order[s : s + rows]) for s in starts], tuple(f.reduceat(v[order], starts) for f in (np.minimum, np.maximum) for v in (x, y))


def _norm(dx, dy):
    return np.sqrt(dx * dx + dy * dy)


def nearest_rows(x: np.ndarray, y: np.ndarray, gx: np.ndarray, gy: np.ndarray, tiles: tuple, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the number of its nearest target, the smallest at ties, and the distance; ``tiles`` are blocks of the targets.

    A group of points meets the tiles that its box cannot rule out, the nearest
    first, and in each only its points that the tile's box may still bring nearer.
    """
    held, (bx0, by0, bx1, by1) = tiles
    best, at = np.full(len(x), np.inf), np.full(len(x), len(gx))
    for rows, x0, y0, x1, y1 in zip(*(lambda g: (g[0], *g[1]))(blocks(x, y, size, GROUP)), strict=True):
        least = _norm(np.maximum(0.0, np.maximum(bx0 - x1, x0 - bx1)), np.maximum(0.0, np.maximum(by0 - y1, y0 - by1)))
        most = _norm(np.maximum(bx1 - x0, x1 - bx0), np.maximum(by1 - y0, y1 - by0))
        near = np.flatnonzero(least <= most.min())
        px, py, d, a = x[rows], y[rows], best[rows], at[rows]
        for j in near[np.argsort(least[near], kind="stable")]:
            s = np.flatnonzero(_norm(np.maximum(0.0, np.maximum(bx0[j] - px, px - bx1[j])), np.maximum(0.0, np.maximum(by0[j] - py, py - by1[j]))) <= d)
            if len(s):
                full = _norm(px[s, None] - gx[held[j]], py[s, None] - gy[held[j]])
                k = full.argmin(1)
                new, r = full[np.arange(len(s)), k], held[j][k]
                won = (new < d[s]) | ((new == d[s]) & (r < a[s]))
                d[s[won]], a[s[won]] = new[won], r[won]
        best[rows], at[rows] = d, a
    return at, best


def nearest_finder(targets, size: float):
    """For batches (id, x, y): (id, gx, gy, d) with the place of the nearest target; ``targets`` is a broadcast (x, y) by rank."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gx, gy = targets.value
        tiles = blocks(gx, gy, size, TILE)
        for b in batches:
            if b.num_rows:
                x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
                at, d = nearest_rows(x, y, gx, gy, tiles, size)
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (gx[at], gy[at], d))], ["id", "gx", "gy", "d"])

    return find


def _clipped(px, py, qx, qy, ring: np.ndarray) -> np.ndarray:
    """Shares of segments p-q inside one polygon, by the middles of the parts between its edges."""
    ax, ay, bx, by = *ring.T, *np.roll(ring, -1, 0).T
    dx, dy = (qx - px)[:, None], (qy - py)[:, None]
    ex, ey, ox, oy = bx - ax, by - ay, ax - px[:, None], ay - py[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = dx * ey - dy * ex
        t, u = (ox * ey - oy * ex) / cross, (ox * dy - oy * dx) / cross
        ends = np.ones((len(px), 1))
        cuts = np.sort(np.hstack([0 * ends, np.where((t > 0) & (t < 1) & (u >= 0) & (u <= 1) & (cross != 0), t, 1.0), ends]), axis=1)
        share = np.zeros(len(px))
        for s, e in zip(cuts.T, cuts.T[1:], strict=False):
            mx, my = px + (qx - px) * (s + e) / 2, py + (qy - py) * (s + e) / 2
            over = ((ay > my[:, None]) != (by > my[:, None])) & (mx[:, None] < ex * (my[:, None] - ay) / ey + ax)
            share += np.where(over.sum(1) % 2 == 1, e - s, 0.0)
    return share


def _cells(x0, y0, x1, y1, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of boxes: row, column and row number of each cell that they touch."""
    a, b, c, d = (np.floor(v / size).astype(np.int64) for v in (x0, x1, y0, y1))
    wide, n = b - a + 1, (b - a + 1) * (d - c + 1)
    i = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return i, a[i] + k % wide[i], c[i] + k // wide[i]


def cover_finder(rings, size: float, least: float):
    """For batches (line_id, len, line): (line_id, len, total, near, worst) of each line.

    ``rings`` is a broadcast (points, copies, worst): corners, zones that share
    the ring and rank of its worst zone (-1: no risk), by the ring's number.
    ``near`` holds number and overlap of the rings that no other exceeds by 1e-5.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, copies, worst = rings.value
        lo, hi = (np.array([f(p, axis=0) for p in points]) for f in (np.min, np.max))
        boxed = np.array([len(p) in (4, 5) and len(np.unique(p, axis=0)) == 4 and len(np.unique(p[:, 0])) == len(np.unique(p[:, 1])) == 2 and bool(np.all(np.any(p == np.roll(p, -1, 0), axis=1))) for p in points])
        r, cx, cy = _cells(lo[:, 0], lo[:, 1], hi[:, 0], hi[:, 1], size)
        gx0, gy0, wide, high = cx.min(), cy.min(), cx.max() - cx.min() + 1, cy.max() - cy.min() + 1
        key = (cx - gx0) * high + cy - gy0
        order = np.argsort(key, kind="stable")
        r, key = r[order], key[order]
        grid = (r, *lo[r].T.copy(), *hi[r].T.copy(), cx[order] * 1.0, cy[order] * 1.0, key, gx0, gy0, wide, high)
        for batch in batches:
            for at in range(0, batch.num_rows, LINES):
                yield _covered(batch.slice(at, LINES), points, copies, worst, lo, hi, boxed, grid, size, least)

    return find


def _covered(b: pa.RecordBatch, points, copies, worst, lo, hi, boxed, grid, size, least) -> pa.RecordBatch:
    r, rx0, ry0, rx1, ry1, rx, ry, key, gx0, gy0, wide, high = grid
    line = b.column(2)
    n = line.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = line.flatten()
    x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
    owner = np.repeat(np.arange(len(n)), n)
    first = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else np.zeros(0, int)
    px, py, qx, qy, owner = x[first], y[first], x[first + 1], y[first + 1], owner[first]
    real = np.isfinite(px + py + qx + qy)
    px, py, qx, qy, owner = (v[real] for v in (px, py, qx, qy, owner))
    x0, x1, y0, y1 = np.minimum(px, qx), np.maximum(px, qx), np.minimum(py, qy), np.maximum(py, qy)
    edge = lambda v, c, h: np.clip(v, c * size, (c + h) * size - size / 2)  # noqa: E731  cells beyond all rings are left out
    some = np.flatnonzero((x1 >= gx0 * size) & (x0 < (gx0 + wide) * size) & (y1 >= gy0 * size) & (y0 < (gy0 + high) * size))
    i, cx, cy = _cells(edge(x0[some], gx0, wide), edge(y0[some], gy0, high), edge(x1[some], gx0, wide), edge(y1[some], gy0, high), size)
    i, at = some[i], (cx - gx0) * high + cy - gy0
    begin, end = np.searchsorted(key, at), np.searchsorted(key, at, side="right")
    count = end - begin
    k = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    i = np.repeat(i, count)
    # A pair counts in the first cell that both touch alone.
    for v0, v1, r0, r1 in ((x0, x1, rx0, rx1), (y0, y1, ry0, ry1)):
        keep = np.flatnonzero((v0[i] <= r1[k]) & (r0[k] <= v1[i]))
        i, k = i[keep], k[keep]
    keep = (rx[k] == np.floor(np.maximum(x0[i], rx0[k]) / size)) & (ry[k] == np.floor(np.maximum(y0[i], ry0[k]) / size))
    i, z = i[keep], r[k[keep]]
    s, t = np.zeros(len(i)), np.ones(len(i))
    with np.errstate(divide="ignore", invalid="ignore"):
        for p, q, c in ((px, qx, 0), (py, qy, 1)):
            a, d = p[i], q[i] - p[i]
            u, v = (lo[z, c] - a) / d, (hi[z, c] - a) / d
            flat_in = np.where((a < lo[z, c]) | (a >= hi[z, c]), 2.0, 0.0)
            s, t = np.maximum(s, np.where(d == 0, flat_in, np.minimum(u, v))), np.minimum(t, np.where(d == 0, 1.0, np.maximum(u, v)))
    met = s < t
    i, z, share = i[met], z[met], (t - s)[met]
    other = np.flatnonzero(~boxed[z])
    for g in np.unique(z[other]):
        j = other[z[other] == g]
        share[j] = _clipped(px[i[j]], py[i[j]], qx[i[j]], qy[i[j]], points[g])
    pair, back = np.unique(owner[i] * len(points) + z, return_inverse=True)
    over = np.bincount(back, share * _norm(qx[i] - px[i], qy[i] - py[i]), len(pair))
    pair, over = pair[over > least], over[over > least]
    who, z = pair // len(points), pair % len(points)
    total = np.bincount(who, over * copies[z], len(n))
    most, rank = np.zeros(len(n)), np.full(len(n), -1, np.int64)
    np.maximum.at(most, who, over)
    np.maximum.at(rank, who, worst[z])
    near = over >= most[who] - 1e-5
    who, z, over = who[near], z[near], over[near]
    held = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(len(n) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(z), pa.array(over)], ["ring", "overlap"]))
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total), held, pa.array(rank)], ["line_id", "len", "total", "near", "worst"])
