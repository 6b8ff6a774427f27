"""Decision trees over binned rows, each grown in NumPy in one task."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

BLOCK, STRIP = 1 << 16, 1 << 14  # rows sent together; rows counted at a time, so few that they stay in a core's cache
NODE = "tree int, id int, prediction double, impurity double, n0 double, n1 double, raw long, gain double, l int, r int, feature int, threshold double"
MOST = 127  # draws of a row that fit beside its label


def packer(borders: list[np.ndarray]):
    """For rows (part, features, y) of one partition: (part, no, n, rows) with up to ``BLOCK`` rows of 8 bytes: a bin for each feature, the label in the top bit."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, no, part = np.zeros(0, np.uint64), 0, 0

        def block(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["part", "no", "n", "rows"])

        for b in batches:
            if b.num_rows:
                part = b.column(0)[0].as_py()
                wide = np.zeros((b.num_rows, 8), np.uint8)
                for f, at in enumerate(borders):
                    wide[:, f] = np.searchsorted(at, b.column(f + 1).to_numpy(zero_copy_only=False).astype(np.float64))
                wide[:, 7] = b.column(len(borders) + 1).to_numpy(zero_copy_only=False).astype(np.uint8) << 7
                held = np.concatenate([held, wide.view("<u8")[:, 0]])
                while len(held) >= BLOCK:
                    yield block(held[:BLOCK])
                    held, no = held[BLOCK:], no + 1
        if len(held):
            yield block(held)

    return pack


def _drawn(data: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A copy of the rows that a draw with replacement takes, with how often in the lower bits of the top byte."""
    out, n = np.empty_like(data), 0
    for at in range(0, len(data), BLOCK):
        some = data[at : at + BLOCK]
        times = np.minimum(rng.poisson(1.0, len(some)), MOST).astype(np.uint64)
        took = some[times > 0] | (times[times > 0] << np.uint64(56))
        out[n : n + len(took)] = took
        n += len(took)
    return out[:n]


def _counts(rows: np.ndarray, features: np.ndarray, bins: int) -> np.ndarray:
    """Drawn rows by feature, bin and label."""
    total = np.zeros((len(features), 2 * bins))
    for at in range(0, len(rows), STRIP):
        some = rows[at : at + STRIP].view(np.uint8).reshape(-1, 8)
        times, label = (some[:, 7] & MOST).astype(np.float64), (some[:, 7] >> 7).astype(np.intp) * bins
        for i, f in enumerate(features):
            total[i] += np.bincount(some[:, f] + label, times, 2 * bins)
    return total.reshape(len(features), 2, bins).transpose(0, 2, 1)


def _parted(rows: np.ndarray, feature: int, border: int) -> int:
    """Rows up to the border first, in place; their number."""
    n, later = 0, []
    for at in range(0, len(rows), BLOCK):
        some = rows[at : at + BLOCK]
        low = some.view(np.uint8).reshape(-1, 8)[:, feature] <= border
        later.append(some[~low])
        some = some[low]
        rows[n : n + len(some)] = some
        n += len(some)
    at = n
    for some in later:
        rows[at : at + len(some)] = some
        at += len(some)
    return n


def _impurity(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    return 1 - (n * n).sum(-1) / (total * total)


def grow(rows: np.ndarray, weights: np.ndarray, borders: list[np.ndarray], tries: int, depth: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one tree as in ``NODE`` (without the tree), by Gini over ``tries`` features drawn for each node, as MLlib splits; ``rows`` are put in another order."""
    bins = max(map(len, borders)) + 1
    last = rows.view(np.uint8).reshape(-1, 8)[:, 7]
    root = np.array([float(np.sum(last & MOST, where=last < 128, dtype=np.int64)), float(np.sum(last & MOST, where=last >= 128, dtype=np.int64))])
    nodes, stack = [None], [(0, 0, len(rows), 0, root)]
    with np.errstate(divide="ignore", invalid="ignore"):
        while stack:
            i, lo, hi, level, raw = stack.pop()
            n = raw * weights
            size = n.sum()
            impurity = float(_impurity(n, size)) if size else 0.0
            head = (i, float(n[1] > n[0]), impurity, float(n[0]), float(n[1]), int(raw.sum()))
            best = 0.0
            if level < depth and raw.min() > 0:
                features = np.sort(rng.permutation(len(borders))[:tries])
                left_raw = _counts(rows[lo:hi], features, bins).cumsum(1)[:, :-1]
                left = left_raw * weights
                right = n - left
                l, r = left.sum(-1), right.sum(-1)
                gain = impurity - (l * _impurity(left, l) + r * _impurity(right, r)) / size
                some = left_raw.sum(-1)
                gain = np.where((some > 0) & (some < raw.sum()), gain, -1.0)
                at = int(gain.argmax()) if gain.size else 0
                best = float(gain.flat[at]) if gain.size else 0.0
            if best <= 0:
                nodes[i] = (*head, -1.0, -1, -1, -1, 0.0)
                continue
            f, border = int(features[at // (bins - 1)]), at % (bins - 1)
            low = left_raw.reshape(-1, 2)[at]
            mid = lo + (_parted(rows[lo:hi], f, border) if level + 1 < depth else 0)
            a = len(nodes)
            nodes += [None, None]
            nodes[i] = (*head, best, a, a + 1, f, float(borders[f][border]))
            stack += [(a + 1, mid, hi, level + 1, raw - low), (a, lo, mid, level + 1, low)]
    return nodes


def grower(starts: dict[tuple[int, int], int], total: int, trees: int, groups: int, weights: list[float], borders: list[np.ndarray], tries: int, depth: int, seed: int):
    """For the blocks of all rows (part, no, rows, g), sent whole to each group g: the nodes of its trees g, g + groups, ...

    A task holds all rows, with 8 bytes for each, and those of one tree.
    """

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, g = np.empty(total, np.uint64), None
        for b in batches:
            for part, no, rows, g in zip(*(b.column(c) for c in range(4)), strict=True):  # noqa: B007
                some = np.frombuffer(rows.as_buffer(), "<u8")
                at = starts[part.as_py(), no.as_py()]
                data[at : at + len(some)] = some
        for tree in range(g.as_py(), trees, groups) if g is not None else ():
            rng = np.random.default_rng([seed, tree])
            columns = zip(*grow(_drawn(data, rng), np.array(weights), borders, tries, depth, rng), strict=True)
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([tree] * len(made[0]), pa.int32()), *made], [f.split()[0] for f in NODE.split(", ")])

    return grown
