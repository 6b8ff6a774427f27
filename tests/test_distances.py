"""Distances by blocks of a graph, against Dijkstra; loops keep no estimate of their size."""

import heapq
import random

from pyspark.sql import functions as F

from tidewright.functions.storage import cut_round
from tidewright.operators import graph


def dijkstra(near, start):
    dist, heap = {}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in dist:
            dist[n] = d
            for m, w in near.get(n, ()):
                heapq.heappush(heap, (d + w, m))
    return dist


def test_distances_by_blocks(spark):
    r = random.Random(3)
    edges = [(i, i + 1, float(r.randrange(1, 9))) for i in range(48) if i != 40] + [(r.randrange(30), r.randrange(30), r.randrange(40) / 4 + 1) for _ in range(30)]
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    want = {(s, n): d for s in (0, 45, 99) for n, d in dijkstra(near, s).items()}
    sources = spark.createDataFrame([(0,), (45,), (99,)], "source long")
    table = spark.createDataFrame(edges, "a long, b long, w double")
    for place in (None, lambda n: n):
        rows = graph.distances(sources, table, place, block_arcs=40).collect()
        assert {(x.source, x.node): x.dist for x in rows} == want and len(rows) == len(want)
    preds = {(x.source, x.node): x.pred for x in graph.shortest_paths(sources, table).collect()}
    assert preds == {(s, n): min((m for m, w in near.get(n, ()) if want.get((s, m), 1e9) + w == d), default=None) if n != s else None for (s, n), d in want.items()}


def test_round_forgets_estimate(spark):
    now, sizes = spark.range(4), []
    for _ in range(6):
        now = cut_round(now.join(now.withColumn("x", F.lit(1)).hint("merge"), "id").select("id"))
        sizes.append(int(str(now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    assert len(set(sizes)) == 1 and now.count() == 4
