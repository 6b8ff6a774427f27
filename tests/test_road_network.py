"""The queries over the network of all roads, by union-find and Dijkstra on a small fixture."""

import heapq
import math
import random

import pytest

from tidewright.plans import registry

SPEED = {"1": 50.0, "2": 40.0, "3": 35.0, "4": 30.0, "5": 30.0}  # priorities 1 to 4 are highways; the rest are tracks at the usual speed
HAZARD = [1.0, 1.5, 2.5, 5.0, 10.0, 1.0]


def fixture(spark, folder):
    r = random.Random(5)
    orders = [(k, k * 31 % 90, f"{k % 5 + 1}-X", 700.0 + 70 * k) for k in (*range(1, 31), 5001)]
    items = [(k, n, 10 * r.randrange(5), r.randrange(2), "2024-01-01", float(n)) for k, *_ in orders for n in range(1, 5)]
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    save(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double", "orders")
    save(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate string, l_extendedprice double", "lineitem")
    save([(k,) for k in range(1, 10)], "s_suppkey long", "supplier")
    return orders, items


def network(orders, items):
    """Positions of nodes and the cost of each pair of nodes, that of the last road and segment."""
    at, edges = {}, {}
    for k, cust, priority, price in orders:
        points = [((k % 100) * 100.0 + p % 50 * 10, 100.0 * (k // 100 % 100) + s % 50 * 10) for o, _, p, s, *_ in items if o == k]
        names = [f"{x:.3f},{y:.3f}" for x, y in points]
        at |= {n: (*p, min(k, at.get(n, (0, 0, k))[2])) for n, p in zip(names, points, strict=True)}
        cost = price / 7 / 1000 / SPEED[priority[0]] * 60 * (1 + cust % 101 / 100 * (HAZARD[k % 6] - 1))
        total = sum(map(math.dist, points, points[1:]))
        for u, v, p, q in zip(names, names[1:], points, points[1:], strict=False):
            if u != v:
                edges[min(u, v), max(u, v)] = cost * math.dist(p, q) / total
    return at, edges


def test_road_network(spark, tmp_path):
    at, edges = network(*fixture(spark, tmp_path))
    root = {n: n for n in at}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = dict(registry.road_components(spark, str(tmp_path)).collect())
    assert got == {n: find(n) for n in at}
    assert max(list(got.values()).count(c) for c in set(got.values())) > 12 and len(set(got.values())) > 1

    near = {n: [] for n in at}
    for (a, b), w in edges.items():
        near[a].append((b, w))
        near[b].append((a, w))
    # Base 6 has most teams (6 % 7 + 1 = 7); it stands at (6 * 613 % 3000 * 5000, 42 % 4 * 600).
    bx, by = 6 * 613 % 3000 * 5000.0, 42 % 4 * 600.0
    start = min(at, key=lambda n: (math.dist(at[n][:2], (bx, by)), at[n][2]))
    dist, heap = {}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in dist:
            dist[n] = d
            for m, w in near[n]:
                heapq.heappush(heap, (d + w, m))
    rows = registry.road_shortest_path(spark, str(tmp_path)).collect()
    assert {r.source for r in rows} == {start}
    assert {r.node: r.dist for r in rows} == pytest.approx(dist)
    assert len(dist) > 12
