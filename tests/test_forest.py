"""Forests with several targets against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import forest


def data(n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(0, 10, (n, 3)), 2)
    y = np.column_stack([np.where(x[:, 0] > 4, 5.0, 0) + x[:, 1] * 0.2, np.where(x[:, 0] > 4, -3.0, 1) + np.where(x[:, 2] > 7, 4.0, 0)]) + rng.normal(0, 0.1, (n, 2))
    return x, np.round(y, 3)


def frame(spark, x, y):
    return spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double, z double").repartition(4)


def plain_tree(x, y, w, edges, depth, fewest):
    """Predictions of the greedy tree on its own rows."""
    out = np.empty_like(y)

    def grow(rows, level):
        n = w[rows].sum()
        total = (w[rows, None] * y[rows]).sum(axis=0)
        best = (0.0, None)
        if level < depth:
            for f in range(x.shape[1]):
                for b, e in enumerate(edges[f]):
                    left = rows[x[rows, f] <= e]
                    ln = w[left].sum()
                    if ln >= fewest and n - ln >= fewest:
                        ls = (w[left, None] * y[left]).sum(axis=0)
                        gain = round((ls**2).sum() / ln + ((total - ls) ** 2).sum() / (n - ln) - (total**2).sum() / n, 9)
                        if gain > best[0]:
                            best = (gain, (f, e))
        if best[1] is None:
            out[rows] = total / n
            return
        f, e = best[1]
        grow(rows[x[rows, f] <= e], level + 1)
        grow(rows[x[rows, f] > e], level + 1)

    grow(np.arange(len(x)), 0)
    return out


@pytest.mark.parametrize("depth", [0, 1, 3, 5])
def test_one_tree_is_the_greedy_tree(spark, depth):
    x, y = data()
    edges = [np.arange(0.5, 10, 0.5)] * 3
    model = forest.fit_forest(frame(spark, x, y), ["a", "b", "c"], ["y", "z"], trees=1, depth=depth, bootstrap=False, edges=edges)
    assert np.allclose(model.predict(x), plain_tree(x, y, np.ones(len(x)), edges, depth, 5))


def test_drawn_rows_and_passes(spark, monkeypatch):
    """Several trees, each over its own draw; small passes give the same forest."""
    x, y = data(400)
    df = frame(spark, x, y)
    edges = [np.arange(1, 10, 1.0)] * 3
    fit = lambda: forest.fit_forest(df, ["a", "b", "c"], ["y", "z"], trees=4, depth=3, edges=edges, seed=3)
    whole = fit()
    monkeypatch.setattr(forest, "MOST_CELLS", 100)
    parts = fit()
    assert np.allclose(whole.predict(x), parts.predict(x))
    assert len({tuple(t.threshold) for t in whole.trees}) > 1
    w = forest.draws(np.arange(200_000), 2, 5)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and not np.array_equal(w, forest.draws(np.arange(200_000), 3, 5))


def test_targets_missing_values_and_modes(spark):
    x, y = data(1500)
    df = frame(spark, x, y).withColumn("a", F.when(F.rand(1) > 0.05, F.col("a")))
    held = F.pmod(F.xxhash64("b", "c"), F.lit(4)) == 0
    for mode in ("wide", "pooled", "separate"):
        got = {r["target"]: r for r in forest.experiment(df, held, ["a", "b", "c"], ["y", "z"], mode, trees=5, depth=6).collect()}
        assert set(got) == {"y", "z"} and all(r["r2"] > 0.9 and r["n"] > 250 for r in got.values()), mode
    model = forest.fit_forest(df, ["a", "b", "c"], ["y", "z"], trees=3, depth=4)
    scored = forest.predict_forest(df, model, keep=["a"])
    assert scored.where("a IS NULL AND predicted IS NOT NULL").count() == 0 and scored.where("a IS NOT NULL AND size(predicted) = 2").count() == df.where("a IS NOT NULL").count()
    assert sum(model.importances().values()) == pytest.approx(1) and model.importances()["a"] > 0.5


def test_forest_of_nothing_and_of_one_value(spark):
    x, y = data(20)
    with pytest.raises(ValueError, match="no complete row"):
        forest.fit_forest(frame(spark, x, y).limit(0), ["a"], ["y"])
    flat = frame(spark, x, np.ones_like(y))
    assert np.allclose(forest.fit_forest(flat, ["a", "b"], ["y", "z"], trees=2).predict(x[:, :2]), 1)
