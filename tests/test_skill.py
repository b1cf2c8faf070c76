"""Identities of skill, ranks, thresholds and inference."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.functions import clean
from eventide.operators import inference, inversion, rank, skill, thresholds


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def gini(df, **kw):
    return skill.gini(df, "x", "flag", **kw).first()["gini"]


def test_perfect_and_reversed_predictors(spark):
    n = 20_000
    x = np.arange(n, dtype=float)
    assert gini(frame(spark, x=x, flag=x >= 0.95 * n)) == pytest.approx(0.95, abs=1e-9)
    assert gini(frame(spark, x=x, flag=x < 0.05 * n)) == pytest.approx(-0.95, abs=1e-9)


def test_gini_is_auc_in_disguise(spark):
    rng = np.random.default_rng(0)
    x = rng.random(8000)
    flag = rng.random(8000) < 0.2 * x**2
    df = frame(spark, x=x, flag=flag)
    auc = skill.auc(df, "x", "flag").first()["auc"]
    assert gini(df) == pytest.approx((2 * auc - 1) * (1 - flag.mean()), abs=1e-9)


def test_ties_take_the_expectation_over_random_orders(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(600) < 0.7, 0.0, rng.integers(1, 5, 600)).astype(float)
    flag = rng.random(600) < 0.1 + 0.1 * x
    draws = []
    for _ in range(3000):
        order = np.lexsort((rng.random(600), x))
        y = np.concatenate([[0], np.cumsum(flag[order])]) / flag.sum()
        draws.append(2 * np.trapezoid(np.arange(601) / 600 - y, np.arange(601) / 600))
    assert gini(frame(spark, x=x, flag=flag)) == pytest.approx(np.mean(draws), abs=4e-3)


@pytest.mark.parametrize("parts", [1, 7, 32])
def test_results_do_not_depend_on_partitioning(spark, parts):
    rng = np.random.default_rng(2)
    df = frame(spark, i=np.arange(3000), x=np.round(rng.random(3000), 2), flag=rng.random(3000) < 0.1).repartition(parts)
    assert gini(df) == pytest.approx(gini(df.coalesce(1).orderBy("i")), abs=1e-12)
    bins = rank.equal_count_bins(df, [], "x", "i", 7).groupBy("bin").count().toPandas()["count"]
    assert bins.max() - bins.min() <= 1 and bins.sum() == 3000


def test_missing_values_never_are_events(spark):
    df = clean.nan_to_null(frame(spark, x=[1.0, float("nan"), 3.0, -999.0], t=[5.0, 9.0, float("nan"), 1.0]), [-999.0])
    assert [r["x"] for r in df.collect()] == [1.0, None, 3.0, None]
    assert [r["e"] for r in df.select(thresholds.exceeds("t", 4.0).alias("e")).collect()] == [True, True, False, False]


def test_no_events_and_no_rows(spark):
    df = frame(spark, x=[1.0, 2.0], flag=[False, False])
    assert gini(df) is None
    assert skill.gini(df.limit(0), "x", "flag", ["x"]).count() == 0


def test_thresholds_interpolate(spark):
    df = frame(spark, v=np.arange(11, dtype=float))
    assert thresholds.percentile_thresholds(df, "v", [25, 95]) == [2.5, 9.5]


def test_average_rank_matches_pandas(spark):
    v = pd.Series(np.random.default_rng(3).integers(0, 40, 500).astype(float))
    got = rank.average_rank(frame(spark, i=np.arange(500), v=v), "v").toPandas().sort_values("i")["pct_rank"].to_numpy()
    assert np.allclose(got, v.rank(pct=True))


def test_block_bootstrap_is_wider_for_day_level_signal(spark):
    rng = np.random.default_rng(4)
    day = np.repeat(np.arange(120), 60)
    level = rng.random(120)[day]
    flag = rng.random(len(day)) < 0.15 * level
    df = frame(spark, k=np.zeros(len(day), int), i=np.arange(len(day)), x=level, flag=flag, day=day)
    m = inference.bin_day_matrix(df, ["k"], "x", "flag", "day", "i", 64)
    r = inference.bootstrap(m, ["k"], "k long", reps=300).first()
    assert r["inflation"] > 1.2 and r["ci_lo"] < r["gini"] < r["ci_hi"] and r["n_days"] == 120
    with pytest.raises(ValueError):
        inference.bootstrap(m, ["k"], "k long", method="other")


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, None, 0.9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    got = {r["i"]: r["fdr_significant"] for r in inference.fdr(df).collect()}
    assert [got[i] for i in range(8)] == [True, True, False, False, False, False, False, False]


def test_permuted_column_keeps_its_values(spark):
    df = frame(spark, i=np.arange(300), v=np.arange(300.0))
    out = inference.permuted(df, "v", "i", 5).toPandas()
    assert sorted(out["v"]) == list(range(300)) and (out["v"] != out["i"]).mean() > 0.9


def test_inversion_recovers_a_non_monotone_response(spark):
    rng = np.random.default_rng(6)
    n = 6000
    x = rng.standard_normal(n)
    flag = rng.random(n) < 0.4 * np.exp(-2 * x**2)
    df = frame(spark, i=np.arange(n), day=np.arange(n) // 100, x=x, flag=flag)
    assert abs(gini(df)) < 0.1
    for method in inversion.METHODS:
        out = inversion.crossfit(df, "x", "flag", "day", method, 3)
        assert out.count() == n
        assert skill.gini(out, "index", "flag").first()["gini"] > 0.35
    with pytest.raises(ValueError):
        inversion.crossfit(df, "x", "flag", "day", "none")


def test_conditional_gini_of_a_copy_of_the_control_is_small(spark):
    rng = np.random.default_rng(7)
    x = rng.random(6000)
    df = frame(spark, i=np.arange(6000), x=x, flag=rng.random(6000) < 0.3 * x, c=x)
    per_bin = skill.conditional_gini(df, "x", "flag", "c", "i", 10)
    assert abs(skill.pooled_gini(per_bin).first()["gini"]) < 0.12 < gini(df)


def test_curve_and_gini_agree(spark):
    rng = np.random.default_rng(8)
    x = rng.random(4000)
    df = frame(spark, i=np.arange(4000), x=x, flag=rng.random(4000) < 0.2 * x)
    curve = skill.capture_curve(df, "x", "flag", "i")
    assert skill.gini_from_curve(curve).first()["gini"] == pytest.approx(gini(df), abs=5e-3)
    assert 0.1 < skill.detection_at(curve, 0.9).first()["pod"] < 0.3
    assert curve.agg(F.max("event_fraction")).first()[0] == 1.0
