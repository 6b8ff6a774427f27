"""The registered forest has the reference's size."""

from tidewright.operators import forest
from tidewright.plans import registry
from tidewright.plans.derived import derived


def test_forest_size(spark, monkeypatch):
    made, fit = [], forest.fit
    monkeypatch.setattr(forest, "fit", lambda *a, **k: made.append(fit(*a, **k)) or made[-1])
    registry.forest_scores(spark, "/root/testdata/sf0.001")
    trees = made[0].stages[-1]
    assert (trees.getNumTrees, trees.getMaxDepth(), trees.getMaxBins()) == (100, 12, 128)


def test_forest_deals_rows_to_all_cores(spark):
    rows = registry.features(derived(spark, "/root/testdata/sf0.001", "cells"))
    one, many = rows.coalesce(1), rows.repartition(7)
    for some in (one, many):
        assert forest.dealt(some).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert forest.dealt(some).count() == rows.count()
    a, b = (forest.fit(x, trees=5, depth=4, bins=32) for x in (one, many))
    scores = [{r.k: r.raw_score for r in forest.score(m, rows).select("k", "raw_score").collect()} for m in (a, b)]
    assert scores[0] == scores[1]
