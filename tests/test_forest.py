"""Isolation forests: rows go down the trees by levels, with the numbers of the walk by node; novelty scores rows once."""

import numpy as np
from pyspark.sql import functions as F

from vanewright.operators import anomaly, drift


def forest(rng, rows=300, trees=12):
    return anomaly.IsolationForest([anomaly.grow_tree(np.round(rng.standard_normal((rows, 4)), 1), np.random.default_rng(i)) for i in range(trees)], rows)


def test_levels_give_what_nodes_give():
    rng = np.random.default_rng(3)
    for rows in (1, 2, 300):
        f = forest(rng, rows)
        x = np.round(rng.standard_normal((20_000, 4)) * 2, 1)  # values on the cuts, and more than a block
        x[3, 1], x[4, 2], x[5, 0] = np.nan, np.inf, -np.inf
        by_node = 2.0 ** (-f.paths_by_node(x) / len(f.trees) / max(float(anomaly.path_constant(rows)), anomaly.TINY))
        assert np.array_equal(f.score(x), by_node)
    assert anomaly.IsolationForest([], 1).score(np.zeros((2, 4))).tolist() == [1.0, 1.0] and not len(f.score(np.zeros((0, 4))))


def test_rows_pass_the_forest_once_and_score_as_by_the_model(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"m{i % 3}", i, i, [float(v) for v in rng.standard_normal(5)], i % 4 < 2) for i in range(400)]
    table = spark.createDataFrame(rows, "turbine_id string, timestamp long, ordinal long, x array<double>, own boolean")
    model = drift.fit_novelty(table.filter("own"), trees=20)
    want = {r["ordinal"]: r["novelty"] for r in drift.novelty_scores(table, model).collect()}
    asked, plain = [], anomaly.score_with
    monkeypatch.setattr(anomaly, "score_with", lambda *a, **b: asked.append(1) or plain(*a, **b))
    made = drift.fitted_novelty(table, "own", trees=20)
    got = {r["ordinal"]: r["novelty"] for r in made.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(asked) == 1
    assert "MapInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()  # read, not scored again
    assert drift.fitted_novelty(table.withColumn("own", F.col("ordinal") < 9), "own") is None
