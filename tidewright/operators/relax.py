"""Shortest ways inside a block of a graph, in NumPy where its arcs are."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


def packed(rows: pa.Table) -> pa.Table:
    """One row (block, arcs) from those of a block: (block, a, to, b, w), ``to`` being the block of b; rows without b only name a node."""
    block, rows = rows.column("block")[0].as_py(), rows.combine_chunks()
    nodes = pc.unique(rows.column("a"))
    arcs = rows.filter(pc.is_valid(rows.column("b")))
    tail = pc.index_in(arcs.column("a"), value_set=nodes).to_numpy().astype(np.int32)
    order = np.argsort(tail, kind="stable")
    arcs = arcs.take(pa.array(order))
    away = arcs.filter(pc.not_equal(arcs.column("to"), block))
    out = pc.unique(away.column("b"))
    home = np.array(away.column("to").to_numpy(), np.int32)[_firsts(pc.index_in(away.column("b"), value_set=out).to_numpy(), len(out))]
    far = pc.index_in(arcs.column("b"), value_set=out).fill_null(-1).to_numpy().astype(np.int32)
    near = pc.index_in(arcs.column("b"), value_set=nodes).fill_null(-1).to_numpy().astype(np.int32)
    to = np.where(far < 0, near, -1 - far)
    ptr = np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=len(nodes)))])
    held = {"nodes": nodes, "ptr": ptr, "to": to, "w": arcs.column("w").to_numpy(), "out": out, "home": home}
    return pa.table({"block": pa.array([block], pa.int32()), "arcs": pa.array([pickle.dumps(held)], pa.binary())})


def _firsts(code: np.ndarray, n: int) -> np.ndarray:
    at = np.zeros(n, np.int64)
    at[code[::-1]] = np.arange(len(code))[::-1]
    return at


def _arcs_of(nodes: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arc numbers of all ``nodes``, and each arc's node."""
    n = ptr[nodes + 1] - ptr[nodes]
    k = np.repeat(ptr[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return k, np.repeat(nodes, n)


def settle(dist: np.ndarray, front: np.ndarray, ptr: np.ndarray, to: np.ndarray, w: np.ndarray, step: float) -> np.ndarray:
    """Lower ``dist`` along arcs in the block from the nodes ``front`` until nothing falls; the nodes that fell, ``front`` among them.

    The nearest nodes, up to ``step`` behind the first, go on before the others.
    """
    waits, fell = np.zeros(len(dist), bool), np.zeros(len(dist), bool)
    waits[front] = fell[front] = True
    pending = front
    while len(pending):
        now = pending[dist[pending] <= dist[pending].min() + step]
        waits[now] = False
        k, tail = _arcs_of(now, ptr)
        inside = to[k] >= 0
        k, tail = k[inside], tail[inside]
        head, offer = to[k], dist[tail] + w[k]
        less = offer < dist[head]
        head = head[less]
        np.minimum.at(dist, head, offer[less])
        fell[head] = True
        new = head[~waits[head]]
        waits[new] = True
        pending = np.concatenate([pending[waits[pending]], new])
        pending = np.unique(pending) if len(new) else pending
    return np.flatnonzero(fell)


def _relaxed(held: dict, state: dict, offers: pa.StructArray) -> tuple[dict, list[tuple]]:
    """The block's new state, and per source the offers to other blocks: (source, numbers in ``out``, distances)."""
    ptr, to, w = held["ptr"], held["to"], held["w"]
    step = float(w.mean()) if len(w) else 0.0
    source = offers.field("source").dictionary_encode()
    code, at, d = source.indices.to_numpy(), pc.index_in(offers.field("node"), value_set=held["nodes"]).to_numpy(), offers.field("dist").to_numpy()
    dist, sent, made = np.full(len(held["nodes"]), np.inf), np.full(len(held["out"]), np.inf), []
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        name = source.dictionary[int(code[rows[0]])].as_py()
        i, di, j, dj = state.get(name, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)))
        dist[i], sent[j] = di, dj
        won = d[rows] < dist[at[rows]]
        front = at[rows][won].astype(np.int64)
        dist[front] = d[rows][won]
        fell = settle(dist, front, ptr, to, w, step)
        k, tail = _arcs_of(fell, ptr)
        k, tail = k[to[k] < 0], tail[to[k] < 0]
        head, offer = -1 - to[k], dist[tail] + w[k]
        less = offer < sent[head]
        head = head[less]
        np.minimum.at(sent, head, offer[less])
        head = np.unique(head)
        made.append((name, head, sent[head]))
        i, j = np.union1d(i, fell), np.union1d(j, head)
        state[name] = (i, dist[i], j, sent[j])
        dist[i], sent[j] = np.inf, np.inf
    return state, made


def relaxer(schema: pa.Schema):
    """For rows (arcs, offers, state) of blocks: rows of ``schema``, (block, source, node, dist, state): the block's state, or an offer to another block."""

    def relax(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, arcs, offers, state = (batch.column(c)[r] for c in ("block", "arcs", "offers", "state"))
                held = pickle.loads(arcs.as_py())
                state, made = _relaxed(held, pickle.loads(state.as_py()) if state.is_valid else {}, offers.values)
                none = pa.nulls(1)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([pa.array([block.as_py()]), none, none, none, pa.array([pickle.dumps(state)], pa.binary())], schema, strict=True)], schema=schema)
                for name, head, d in made:
                    n = len(head)
                    columns = [pa.array(held["home"][head]), pa.array([name] * n, schema.field("source").type), held["out"].take(pa.array(head)), pa.array(d), pa.nulls(n)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return relax


def lister(schema: pa.Schema):
    """For rows (arcs, state) of blocks: (source, node, dist) of all nodes reached."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for arcs, state in zip(batch.column("arcs"), batch.column("state"), strict=True):
                nodes = pickle.loads(arcs.as_py())["nodes"]
                for name, (i, d, _, _) in pickle.loads(state.as_py()).items():
                    columns = [pa.array([name] * len(i), schema.field("source").type), nodes.take(pa.array(i)), pa.array(d)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return listed
