"""Components inside a part of a graph, in NumPy where its edges are."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

HELD = 1 << 21  # edges joined at a time, some 300 MB in a task


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of ``n`` nodes the least number in the component, for edges u-v."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root = root[root]


def _stars(edges: np.ndarray) -> np.ndarray:
    """Edges (ax, ay, bx, by) from each node to one of its component, itself left out; nodes are told apart by their bits."""
    ends = np.ascontiguousarray(edges).reshape(-1, 2)
    named = pa.Array.from_buffers(pa.binary(16), len(ends), [None, pa.py_buffer(ends)]).dictionary_encode()
    code = named.indices.to_numpy().reshape(-1, 2)
    first = np.frombuffer(named.dictionary.buffers()[1], np.float64, 2 * len(named.dictionary)).reshape(-1, 2)
    root = roots(len(first), code[:, 0], code[:, 1])
    moved = np.flatnonzero(root != np.arange(len(root)))
    return np.hstack([first[moved], first[root[moved]]])


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join the same nodes as those of the batches (ax, ay, bx, by), one for each node but the first of a component.

    Of more than ``HELD / 2`` such edges a task hands on what it has and begins anew, so its memory is bounded.
    """

    def rows(edges: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in edges.T.copy()], ["ax", "ay", "bx", "by"])

    held, n = [], 0
    for batch in batches:
        held.append(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]))
        n += batch.num_rows
        if n >= HELD:
            held = [_stars(np.concatenate(held))]
            n = len(held[0])
            if n > HELD // 2:
                yield rows(held[0])
                held, n = [], 0
    if n:
        yield rows(_stars(np.concatenate(held)))
