"""Kriging in blocks gives the weights of the dense system."""

import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle

from eventide.operators import gapfill, krige_blocks

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def field(n, seed=1, clustered=False):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 50, (n, 2)) if not clustered else np.concatenate([rng.normal(c, 0.5, (n // 5, 2)) for c in rng.uniform(0, 50, (5, 2))])
    return np.round(xy, 4), np.sin(xy[:, 0] / 5) + 0.1 * xy[:, 1] + rng.normal(0, 0.1, len(xy))


def dense(spark, xy, v):
    """Weights and constant of the whole system, solved in one task."""

    def solve(batches):
        for _ in batches:
            a = np.ones((len(xy) + 1, len(xy) + 1))
            a[:-1, :-1] = krige_blocks.distances(xy, xy)
            a[-1, -1] = 0
            yield pd.DataFrame({"w": np.linalg.solve(a, np.append(v, 0.0))})

    return spark.range(1).repartition(1).mapInPandas(solve, "w double").toPandas()["w"].to_numpy()


def known_kriging(spark, places):
    def fill(batches):
        for b in batches:
            yield pd.DataFrame({"w": gapfill.kriged(b["y"].to_numpy(), b["x"].to_numpy(), b["v"].to_numpy(float), nugget=0.0)})

    df = spark.createDataFrame([(r[0], r[1], None if r[2] is None or np.isnan(r[2]) else r[2]) for r in places], "y double, x double, v double").coalesce(1)
    return df.mapInPandas(fill, "w double").toPandas()["w"].tolist()


@pytest.mark.parametrize(("n", "clustered"), [(3000, False), (1500, True)])
def test_weights_of_the_dense_system(spark, n, clustered):
    xy, v = field(n, clustered=clustered)
    solver = krige_blocks.Solver(spark, xy, tile=400)
    c, m, rounds = solver.weights(v)
    got = np.empty(len(xy))
    got[solver.order] = c
    want = dense(spark, xy, v)
    assert rounds < 60
    assert np.abs(got - want[:-1]).max() < 1e-6 * np.abs(want[:-1]).max() and m == pytest.approx(want[-1], rel=1e-6)


def test_an_iteration_that_ends_early_is_an_error(spark):
    xy, v = field(800)
    with pytest.raises(ArithmeticError, match="not converged"):
        krige_blocks.Solver(spark, xy, tile=100).weights(v, rounds=2)


def test_fields_with_gaps(spark):
    xy, v = field(900)
    rows = [(float(a), float(b), None if i % 6 == 0 else float(z), i) for i, ((a, b), z) in enumerate(zip(xy, v, strict=True))]
    rows += [(rows[1][0], rows[1][1], None, 9000), (None, 1.0, None, 9001), (2.0, 2.0, float("nan"), 9002)]
    df = spark.createDataFrame(rows, "y double, x double, v double, filled_by int").repartition(3)
    got = {r["filled_by"]: r["filled"] for r in krige_blocks.fill_large(df, "y", "x", "v", tile=150).collect()}
    places = [r for r in rows if r[0] is not None]
    want = known_kriging(spark, places)
    assert len(got) == len(rows) and got[9001] is None and got[9000] == pytest.approx(rows[1][2], abs=1e-6)
    assert [got[r[3]] for r in places] == pytest.approx(want, abs=1e-5)
    few = spark.createDataFrame(rows[:6], "y double, x double, v double, i int")
    assert [r["filled"] for r in krige_blocks.fill_large(few, "y", "x", "v").where("v IS NULL").collect()] == [pytest.approx(np.mean([r[2] for r in rows[1:6]]))]
    assert krige_blocks.fill_large(few.where("v IS NULL"), "y", "x", "v").first()["filled"] is None
