"""Approximate neighbours against exact ones: recall, full leaves, and cells whose leaves hold too few."""

import numpy as np

from grainfield.operators import graph


def table(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cell_id long, vec array<double>")


def rows(df):
    return {(r["cell_id"], r["rank"]): (r["nbr_id"], round(r["dist"], 9)) for r in df.collect()}


def test_recall_with_many_leaves(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 8)) * 6
    v = centres[rng.integers(0, 60, 1500)] + rng.standard_normal((1500, 8))
    want = rows(graph.knn(table(spark, v), 20))
    got = rows(graph.approximate_knn(table(spark, v), 20, tables=4, bits=10))
    assert set(got) == set(want)
    pairs = lambda found: {(i, n) for (i, r), (n, _) in found.items() if r > 0}
    assert len(pairs(got) & pairs(want)) >= 0.93 * len(pairs(want))


def test_short_cells_are_filled(spark):
    v = np.random.default_rng(4).standard_normal((60, 3))
    assert rows(graph.approximate_knn(table(spark, v), 20, tables=1, bits=6)).keys() == rows(graph.knn(table(spark, v), 20)).keys()


def test_full_leaves_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(graph, "PIECE", 64)
    monkeypatch.setattr(graph, "BLOCK", 64)
    rng = np.random.default_rng(5)
    v = np.concatenate([np.tile(rng.standard_normal(4), (200, 1)), rng.standard_normal((200, 4))])
    assert rows(graph.approximate_knn(table(spark, v), 5)) == rows(graph.knn(table(spark, v), 5))
    assert len(rows(graph.approximate_knn(table(spark, v), 5, tables=2, bits=5))) == 5 * 400
