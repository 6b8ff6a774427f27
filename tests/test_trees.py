"""Trees grown in one task over all rows: equal whatever the partitions, and as brute force splits."""

import numpy as np
import pytest

from tidewright.functions import hydro
from tidewright.operators import forest, trees


def gini(n):
    return 1 - (n * n).sum() / n.sum() ** 2


def test_grow_splits_as_brute_force():
    r = np.random.default_rng(7)
    n, weights = 300, np.array([0.7, 2.0])
    bins, y, times = r.integers(0, 6, (n, 7)), r.integers(0, 2, n), r.integers(1, 4, n)
    rows = (np.column_stack([bins, y << 7 | times]).astype(np.uint8)).view("<u8")[:, 0].copy()
    borders = [np.arange(5) + 0.5] * 7
    nodes = trees.grow(rows.copy(), weights, borders, 7, 4, np.random.default_rng(1))

    def check(i, mask, level):
        count = np.array([times[mask & (y == c)].sum() for c in (0, 1)])
        node, size = nodes[i], (count * weights).sum()
        assert node[5] == count.sum() and node[3:5] == pytest.approx(tuple(count * weights)) and node[1] == float(node[4] > node[3])
        gains = {}
        for f in range(7):
            for b in range(5):
                low = mask & (bins[:, f] <= b)
                sides = [np.array([times[m & (y == c)].sum() for c in (0, 1)]) * weights for m in (low, mask & ~low)]
                if all(s.sum() for s in sides):
                    gains[f, b + 0.5] = gini(count * weights) - sum(s.sum() * gini(s) for s in sides) / size
        if level == 4 or not count.all() or not gains or max(gains.values()) <= 1e-12:
            assert node[7] == -1
            return 1
        assert node[6] == pytest.approx(max(gains.values())) == gains[node[9], node[10]]
        low = mask & (bins[:, node[9]] <= node[10])
        return 1 + check(node[7], low, level + 1) + check(node[8], mask & ~low, level + 1)

    assert check(0, np.ones(n, bool), 0) == len(nodes) > 15


def test_draws_are_poisson_and_keep_all_rows_in_reach():
    data = np.arange(200_000, dtype=np.uint64) << np.uint64(8)
    drawn = trees._drawn(data, np.random.default_rng(3))
    times = (drawn >> np.uint64(56)).astype(int)
    assert times.sum() / len(data) == pytest.approx(1, abs=0.02) and len(drawn) / len(data) == pytest.approx(1 - np.exp(-1), abs=0.01)
    assert (np.diff((drawn & np.uint64((1 << 56) - 1)).astype(np.int64)) > 0).all()


def test_fit_reads_rows_once_for_all_trees(spark, monkeypatch):
    """Every tree stands on all rows, from blocks of any number, and the fit's jobs do not grow with trees or depth."""
    rows = [(*(float((i * p) % m) for p, m in ((7, 90), (3, 11), (5, 13), (1, 50), (9, 8), (2, 40), (4, 30))), int(i % 10 in (1, 2, 3)), i) for i in range(900)]
    df = spark.createDataFrame(rows, [*hydro.FEATURES, "y", "k"])
    tracker, seen = spark.sparkContext.statusTracker(), []
    for block, size in ((trees.BLOCK, {"trees": 3, "depth": 2}), (64, {"trees": 9, "depth": 7}), (trees.BLOCK, {"trees": 9, "depth": 7})):
        monkeypatch.setattr(trees, "BLOCK", block)
        group = f"fit-{len(seen)}"
        spark.sparkContext.setJobGroup(group, group)
        model = forest.fit(df, bins=32, **size)
        spark.sparkContext.setJobGroup("rest", "rest")
        last = model.stages[-1]
        assert last.getNumTrees == size["trees"] and max(t.depth for t in last.trees) == size["depth"]
        for t in last.trees:
            assert float(t._call_java("rootNode").impurityStats().count()) > 800 * 0.8
        seen.append((len(tracker.getJobIdsForGroup(group)), {r.k: r.raw_score for r in forest.score(model, df).select("k", "raw_score").collect()}))
    assert abs(seen[0][0] - seen[2][0]) <= 1
    assert seen[1][1] == seen[2][1]
    with pytest.raises(ValueError):
        forest.fit(df.selectExpr("*").replace(7.0, None, ["elevation"]))
    with pytest.raises(ValueError):
        forest.fit(df.filter("k < 0"))
