"""Links of roads are joined where they lie, so that components work on fewer links than places."""

import random

import numpy as np
import pyarrow as pa
from test_road_network import fixture

from tidewright.operators import graph, stars
from tidewright.plans import registry


def parts(edges):
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in root}


def test_joined_links(monkeypatch):
    r = random.Random(3)
    spot = lambda: (float(r.randrange(60)), float(r.randrange(3)))
    edges = [(spot(), spot()) for _ in range(150)] + [((100.0 + i, 0.0), (101.0 + i, 0.0)) for i in range(300)]
    r.shuffle(edges)
    table = pa.table({c: [e[i // 2][i % 2] for e in edges] for i, c in enumerate(("ax", "ay", "bx", "by"))})
    for held in (stars.HELD, 64, 8):
        monkeypatch.setattr(stars, "HELD", held)
        out = list(stars.joined(iter(table.to_batches(max_chunksize=20))))
        got = [((a, b), (c, d)) for batch in out for a, b, c, d in zip(*(col.to_pylist() for col in batch.columns), strict=True)]
        assert parts(got) == parts(e for e in edges if e[0] != e[1]), held
        assert len(got) <= len(edges)
        if held > 64:
            assert len(got) == len(parts(edges)) - len(set(parts(edges).values()))
    assert list(stars.roots(4, np.array([3]), np.array([1]))) == [0, 1, 2, 1]


def test_road_components_get_fewer_links_than_places(spark, tmp_path, monkeypatch):
    fixture(spark, tmp_path)
    seen, whole = [], graph.components
    monkeypatch.setattr(graph, "components", lambda nodes, edges: seen.append((nodes.count(), edges.count())) or whole(nodes, edges))
    registry.road_components(spark, str(tmp_path))
    (nodes, links), *_ = seen
    assert 0 < links < nodes
