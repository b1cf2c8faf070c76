"""Fold stability, stored curves, configurations, footprints and swaths against plain versions."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.operators import features, grid, inference, inversion, trajectory
from eventide.plans import config, suite
from eventide.sources import tables


def test_fold_stability_matches_numpy(spark):
    rng = np.random.default_rng(5)
    n, folds, bins = 3000, 3, 20
    x, day = rng.gamma(2, 20, n).round(1), rng.integers(0, 30, n)
    flag = rng.random(n) < 0.05 + 0.3 * np.exp(-(((x - 40) / 20) ** 2))
    fold = day * folds // 30
    at = np.quantile(x, 0.005 + 0.99 * np.arange(101) / 100)
    curves = []
    for k in range(folds):
        a, y = x[fold != k], flag[fold != k]
        edges = np.unique(np.quantile(a, np.arange(bins + 1) / bins))
        which = np.searchsorted(edges[1:-1], a, side="right")
        c = np.array([np.median(a[which == b]) for b in np.unique(which)])
        r = np.array([y[which == b].mean() for b in np.unique(which)])
        curves.append(pd.Series(np.interp(at, c, r)).rank())
    want = np.mean([np.corrcoef(curves[i], curves[j])[0, 1] for i in range(folds) for j in range(i + 1, folds)])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "day": day, "flag": flag}))
    row = inversion.fold_stability(df, "x", "flag", "day", "binned", folds).first()
    assert row["n_pairs"] == 3 and row["stability"] == pytest.approx(want, abs=2e-3)
    with pytest.raises(ValueError):
        inversion.fold_stability(df, "x", "flag", "day", "other")


def test_curves_of_a_run_are_replaced_and_others_stay(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 5, 1.0, 0.5, 0.1)], "id string, bin int, n long, median double, rate double, se double")
    at = str(tmp_path / "curves")
    suite.write_curves(df, at, "first")
    suite.write_curves(df.withColumn("n", F.lit(7).cast("long")), at, "second")
    suite.write_curves(df.withColumn("n", F.lit(9).cast("long")), at, "first")
    assert [suite.load_curves(spark, at, r).first()["n"] for r in ("first", "second")] == [9, 7]
    assert suite.load_curves(spark, at, "third").count() == 0


def test_configurations(tmp_path, spark):
    assert config.RunConfig.preset("complete", ["a", "b", "c"]).complete_days
    assert config.RunConfig.preset("first_last", ["a", "b", "c"], reps=9).valid == ("a", "c")
    with pytest.raises(ValueError):
        config.RunConfig.preset("other", ["a"])
    for name, values in (("one", {"reps": 5}), ("two", {"seed": 3, "label": "x"}), ("three", {"reps": 6})):
        (tmp_path / name).write_text(json.dumps(values))
    got = config.RunConfig.from_files([str(tmp_path / n) for n in ("one", "two")])
    assert (got.reps, got.seed, got.label) == (5, 3, "x")
    with pytest.raises(ValueError, match="reps"):
        config.RunConfig.from_files([str(tmp_path / n) for n in ("one", "three")])
    made = config.block_experiments({"heat": ["t"], "soil": ["s1", "s2"]}, {"met": ["f"], "pred": ["g"]})
    assert made["full-pred"] == ["t", "s1", "s2", "g"] and made["drop-heat"] == ["s1", "s2", "f"] and made["drop-swap"] == ["t", "s1", "s2"] and made["solo-pred"] == ["g"]
    assert len(made) == 9 and not any({"f", "g"} <= set(c) for c in made.values())
    manifest = spark.createDataFrame([(f"s{i}", str(i)) for i in range(1500)], "name string, value string")
    features.require_same(manifest, {"s1400": "1400", "new": "x"})
    with pytest.raises(ValueError, match="s1400"):
        features.require_same(manifest, {"s1400": "0"})


def test_footprint_keeps_its_mass_and_lags(spark):
    p = pd.DataFrame({"u": 1, "h": [0.0, 30.0, 60.0, 70.0, 80.0], "y": [0.0, 1, 2, 3, 4], "x": [0.0, 0, 1, 1, 2], "c": [1.0, 1.0, 0.5, 0.0, 1.0]})
    out = trajectory.footprint(spark.createDataFrame(p), ["u"], ["u"], "h", "y", "x", contact=F.col("c"), sigma=F.lit(0.8), most_lag=60, lag_hours=10, energy=F.lit(2.0))
    got = {r["lag"]: r["m"] for r in out.groupBy("lag").agg(F.sum("mass").alias("m")).collect()}
    assert got == {5: pytest.approx(60.0), 2: pytest.approx(20.0), 0: pytest.approx(10.0)}


def test_envelope_fills_holes_and_the_border_stays_open(spark):
    seen = np.zeros((9, 9), bool)
    seen[1:8, 1:8] = True
    seen[3:6, 3:6] = False  # a hole wider than the closing
    i, j = (a.ravel() for a in np.mgrid[0:9, 0:9])
    df = spark.createDataFrame(pd.DataFrame({"day": 1, "lat": i.astype(np.int32), "lon": j.astype(np.int32), "seen": seen.ravel()}))
    got = {(r["lat"], r["lon"]) for r in grid.envelope(df, ["day"], "day long", "seen").where("inside").collect()}
    assert got == {(a, b) for a in range(1, 8) for b in range(1, 8)}
    assert grid.envelope(df.limit(0), ["day"], "day long", "seen").count() == 0


def test_bicubic_is_exact_on_quadratics_and_at_cells(spark):
    i, j = (a.ravel() for a in np.mgrid[0:12, 0:12])
    f = lambda a, b: 2 + 0.5 * a - b + 0.1 * a * a + 0.2 * a * b
    df = spark.createDataFrame(pd.DataFrame({"k": 0, "lat": i.astype(np.int32), "lon": j.astype(np.int32), "v": f(i, j)}))
    rows = [r for r in grid.bicubic(df, ["k"], "v", 1.5).collect() if 1 <= r["ilat"] * 1.5 <= 10 and 1 <= r["ilon"] * 1.5 <= 10]
    assert len(rows) == 36 and all(r["v"] == pytest.approx(f(r["ilat"] * 1.5, r["ilon"] * 1.5)) for r in rows)


def test_error_of_a_part_shrinks_with_its_size(spark):
    m = spark.createDataFrame([(b, d, 40, b) for b in range(20) for d in range(5)], "bin int, day int, n long, e long")
    whole, sixth = (inference.resampled_error(m, parts).first()["sigma"] for parts in (1, 6))
    assert sixth == pytest.approx(6**0.5 * whole, rel=0.2)


def test_newest_version(spark, tmp_path):
    for v in (1, 3):
        spark.range(v).write.parquet(str(tmp_path / f"base-v{v}"))
    assert [tables.newest(spark, str(tmp_path), "base", v).count() for v in (2, 3, 7)] == [1, 3, 3]
    with pytest.raises(FileNotFoundError):
        tables.newest(spark, str(tmp_path), "base", 0)
