"""Joins on time, windows, screens, grids, trajectories, gap filling, sources, configuration."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.functions import clean, physics
from eventide.operators import asof, climatology, gapfill, grid, screens, trajectory, verify, windows
from eventide.plans import config, suite
from eventide.sources import bulletins, tables


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


# -- time ---------------------------------------------------------------------------------------------------


def test_bracketing_is_exact_on_a_ramp_and_never_extrapolates(spark):
    left = frame(spark, k=[1] * 5, id=range(5), t=[0.0, 10.0, 15.0, 30.0, 31.0])
    right = frame(spark, k=[1, 1, 1], u=[10.0, 20.0, 30.0], v=[100.0, 200.0, 300.0])
    got = {r["id"]: r["w"] for r in asof.bracketed(left, right, ["k"], "t", "u", "v", 100, "w").collect()}
    assert got == {0: None, 1: 100.0, 2: 150.0, 3: 300.0, 4: None}
    narrow = {r["id"]: r["w"] for r in asof.bracketed(left, right, ["k"], "t", "u", "v", 5, "w").collect()}
    assert narrow[2] is None and narrow[1] == 100.0


def test_nearest_within_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    left = pd.DataFrame({"k": rng.integers(0, 3, 200), "id": np.arange(200), "t": rng.integers(0, 5000, 200)})
    right = pd.DataFrame({"k": rng.integers(0, 3, 100), "u": rng.integers(0, 5000, 100), "v": rng.random(100)})
    out = asof.nearest_within(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "u", 60, "id", ["v"]).toPandas().set_index("id")
    for r in left.itertuples():
        near = right[(right.k == r.k) & ((right.u - r.t).abs() <= 60)]
        want = min(((abs(x.u - r.t), x.u) for x in near.itertuples()), default=(None, None))[1]
        got = out.loc[r.id, "u"]
        assert (pd.isna(got) and want is None) or got == want


@pytest.mark.parametrize("strictly", [True, False])
def test_last_before(spark, strictly):
    left = frame(spark, k=[1, 1, 1], id=[0, 1, 2], t=[5, 10, 20])
    right = frame(spark, k=[1, 1, 2], u=[5, 10, 1], v=[50.0, 100.0, 7.0])
    got = {r["id"]: r["v"] for r in asof.last_before(left, right, ["k"], "t", "u", ["v"], strictly).collect()}
    assert got == ({0: None, 1: 50.0, 2: 100.0} if strictly else {0: 50.0, 1: 100.0, 2: 100.0})


def test_merge_left_guards(spark):
    left, right = frame(spark, k=[1.0001, 2.0], a=[1, 2]), frame(spark, k=[1.0, 1.0], b=[3, 4])
    with pytest.raises(ValueError):
        asof.merge_left(left, right.withColumnRenamed("b", "a"), ["k"])
    with pytest.raises(Exception, match="repeated key"):
        asof.merge_left(left, right, ["k"]).collect()
    assert asof.merge_left(left, right.limit(1), ["k"]).where("b IS NOT NULL").count() == 1


def test_fallback_names_its_source(spark):
    df = frame(spark, k=[1, 2, 3])
    out = asof.fallback(df, [("a", frame(spark, k=[1], v=[10.0]), ["k"], "v"), ("b", frame(spark, k=[1, 2], v=[5.0, 6.0]), ["k"], "v")], "x")
    assert {r["k"]: (r["x"], r["source"]) for r in out.collect()} == {1: (10.0, "a"), 2: (6.0, "b"), 3: (None, None)}


def test_lags_follow_the_calendar(spark):
    days = [dt.date(2020, 1, d) for d in (1, 2, 4, 5)]
    df = spark.createDataFrame([(1, d, float(i)) for i, d in enumerate(days)], "cell int, day date, v double")
    out = windows.calendar_lags(df, ["cell"], "v", [1]).orderBy("day").collect()
    assert [r["v_lag1"] for r in out] == [None, 0.0, None, 2.0]
    mean = windows.antecedent_mean(df, ["cell"], "v", 1, 2, "m").orderBy("day").collect()
    assert [r["m"] for r in mean] == [None, None, None, None]


def test_harmonic_fit_removes_a_planted_cycle(spark):
    days = pd.date_range("2019-01-01", "2020-12-31")
    t = 2 * np.pi / 365.25 * days.dayofyear.to_numpy()
    pdf = pd.concat([pd.DataFrame({"cell": c, "day": days.date, "v": 3.0 * c + np.cos(t) - 0.5 * np.sin(2 * t)}) for c in (1, 2)])
    pdf.loc[pdf.index % 7 == 0, "v"] = None
    df = spark.createDataFrame(pdf, "cell int, day date, v double")
    df = clean.nan_to_null(df)
    fit = climatology.harmonic_fit(df, ["cell"], "v", "cell int", n=2)
    out = climatology.deseasonalise(df, fit, ["cell"], "v", "a", n=2)
    assert out.agg(F.max(F.abs("a"))).first()[0] < 1e-9
    few = climatology.harmonic_fit(df.limit(5), ["cell"], "v", "cell int", n=2).first()
    assert few["beta"] is None


def test_interpolation_weights_do_not_extrapolate():
    w = climatology.bracket_weights([16, 19, 22, 25, 28], [15, 21, 22, 24])
    assert {k for k, _, _ in w} == {1, 2, 3}
    for k in (1, 2, 3):
        assert sum(x for i, _, x in w if i == k) == pytest.approx(1)


# -- screens ------------------------------------------------------------------------------------------------


def test_onset_screen_keeps_unknown_rows(spark):
    rows = [("A", s, 3.0 if s in (3, 5) else 0.0) for s in range(1, 7)] + [("B", s, 0.0) for s in range(1, 7)] + [("C", s, 1.0 if s == 1 else None) for s in range(1, 7)] + [("D", 0, 5.0), ("D", 1, 0.0)]
    df = spark.createDataFrame(rows, "cell string, slot int, q double")
    kept = screens.until_onset(df, F.col("q") > 0, ["cell"]).groupBy("cell").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert {r["cell"]: r["s"] for r in kept} == {"A": [1, 2, 3], "B": [1, 2, 3, 4, 5, 6], "C": [1]}


def test_poisoned_maximum_and_renormalised_mean(spark):
    df = frame(spark, g=[1, 1, 2, 2], v=[1.0, None, 2.0, 5.0], w=[1.0, 3.0, 1.0, 1.0])
    df = clean.nan_to_null(df)
    got = {r["g"]: (r["m"], r["a"]) for r in df.groupBy("g").agg(clean.poisoned_max("v").alias("m"), clean.weighted_mean("v", "w").alias("a")).collect()}
    assert got == {1: (None, 1.0), 2: (5.0, 3.5)}


def test_steps_and_schema_helpers(spark):
    df = frame(spark, a=[1, 2, 3])
    report = screens.step_report(df, {"big": F.col("a") > 1, "odd": F.col("a") % 2 == 1}).orderBy("step_no").collect()
    assert [(r["step"], r["n_rows"]) for r in report] == [("input", 3), ("big", 2), ("odd", 1)]
    with pytest.raises(ValueError, match="missing columns"):
        clean.require_columns(df, ["a", "b"])
    assert clean.with_columns_of(df, {"b": "double", "a": "long"}).dtypes == [("b", "double"), ("a", "bigint")]


# -- grids --------------------------------------------------------------------------------------------------


def grid_of(spark, a, **keys):
    i, j = np.indices(a.shape)
    return clean.nan_to_null(spark.createDataFrame(pd.DataFrame({"lat": i.ravel(), "lon": j.ravel(), "v": a.ravel(), **keys})).withColumns({"lat": F.col("lat").cast("int"), "lon": F.col("lon").cast("int")}))


def test_offset_lines_hit_only_when_dilated(spark):
    truth = frame(spark, lat=range(6), lon=[2] * 6).withColumn("d", F.lit(1))
    pred = frame(spark, lat=range(6), lon=[3] * 6).withColumn("d", F.lit(1))
    for n, pod, far in ((0, 0.0, 1.0), (1, 1.0, 0.0)):
        s = verify.scores(verify.contingency(truth, pred, ["d"], n, F.lit(1.0)), ["dilation"]).first()
        assert (s["pod"], s["far"], s["fb"]) == (pod, far, 1.0)


def test_flat_fields_stay_flat(spark):
    df = grid_of(spark, np.full((6, 7), 4.0))
    assert [r["m"] for r in grid.neighbourhood_mean(df, [], "v", 1, 1, "m").select("m").distinct().collect()] == [4.0]
    assert grid.gradient(df, [], "v").where("magnitude > 0").count() == 0
    assert grid.complete_grid(df, ["lat", "lon"]).first()["complete"]


def test_planted_storm_and_its_neighbours(spark):
    a = np.full((8, 10), 0.5)
    a[3, 4] = 40.0
    a[0, 9] = 0.0
    out = grid.objects(grid_of(spark, a, t=1), ["t"], "v", 0.2, 10.0, 1, "t long")
    storm = {(r["lat"], r["lon"]) for r in out.where("storm").collect()}
    assert storm == {(i, j) for i in (2, 3, 4) for j in (3, 4, 5)}
    assert out.where("object > 0").select("object").distinct().count() == 1


def test_rasterised_strokes(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 4.0, 0.0), (1, 2, None, None), (1, 3, 0.0, 5.0), (1, 4, 0.0, 6.0)], "line int, seq int, x double, y double")
    got = {(r["ilat"], r["ilon"]) for r in grid.rasterise(p, ["line"], "seq", "x", "y", 1.0).collect()}
    assert got == {(0, j) for j in range(5)} | {(5, 0), (6, 0)}


def test_sweep_equals_one_dilation_per_threshold(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random((8, 8)), 3)
    t = rng.random((8, 8)) < 0.2
    probs = grid_of(spark, p, d=1).withColumnRenamed("v", "p")
    truth = grid_of(spark, np.where(t, 1.0, np.nan), d=1).where("v IS NOT NULL")
    out = {round(r["threshold"], 3): r for r in verify.threshold_sweep(probs, truth, ["d"], "p", 1, 9).collect()}
    for k in range(1, 10):
        pred = probs.where(F.floor(F.col("p") * 10 + 1e-9) >= k)
        want = verify.contingency(truth, pred, ["d"], 1, F.lit(1.0)).first()
        assert [out[k / 10][c] for c in ("pred_hit", "pred_miss", "truth_hit", "truth_miss")] == [want[c] for c in ("pred_hit", "pred_miss", "truth_hit", "truth_miss")]


# -- trajectories -------------------------------------------------------------------------------------------


def test_deposit_conserves_mass(spark):
    p = frame(spark, r=[1, 1, 2], lat=[0.2, 3.7, -1.1], lon=[0.0, 2.2, 5.5], s=[0.2, 1.3, 2.5], m=[1.0, 2.0, 5.0])
    got = {r["r"]: r["t"] for r in trajectory.deposit(p, ["r"], "lat", "lon", "s", "m").groupBy("r").agg(F.sum("mass").alias("t")).collect()}
    assert got[1] == pytest.approx(3) and got[2] == pytest.approx(5)


def test_uniform_surface_through_a_gappy_kernel(spark):
    k = frame(spark, r=[1, 1, 1], s=[1, 2, 3], w=[0.5, 0.3, 0.2])
    out = trajectory.apply_kernel(k, frame(spark, s=[1, 2], v=[7.0, 7.0]), ["r"], ["s"], "w", "v").first()
    assert out["value"] == pytest.approx(7) and out["coverage"] == pytest.approx(0.8)
    assert trajectory.apply_kernel(k, frame(spark, s=[3], v=[7.0]), ["r"], ["s"], "w", "v", 0.5).first()["value"] is None


def test_resampling_is_linear_and_keeps_the_end(spark):
    p = spark.createDataFrame([(1, 0, 0.0), (1, 100, 10.0), (1, 150, 20.0), (1, 200, None), (1, 250, 1.0)], "k int, t long, v double")
    got = [(r["t"], r["v"]) for r in trajectory.resample(p, ["k"], "t", ["v"], 40).orderBy("t").collect()]
    assert got == [(0, 0.0), (40, 4.0), (80, 8.0), (120, 14.0), (150, 20.0)]


def test_distances_and_layers(spark):
    df = frame(spark, a=[0.0]).select(physics.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"), physics.contact_weight(F.lit(110.0), F.lit(100.0)).alias("c"), physics.nearest_branch(F.lit(179.0), F.lit(-170.0)).alias("b"))
    r = df.first()
    assert r["half"] == pytest.approx(np.pi * 6371.0) and r["c"] == pytest.approx(0.5) and r["b"] == pytest.approx(-181.0)


# -- gaps ---------------------------------------------------------------------------------------------------


def test_kriging_follows_a_plane_and_falls_back():
    i, j = (x.ravel().astype(float) for x in np.indices((8, 8)))
    v = 2 * i - j
    v[[9, 27, 44]] = np.nan
    filled = gapfill.kriged(i, j, v, 0)
    assert np.allclose(filled, 2 * i - j, atol=0.35)
    few = np.full(64, np.nan)
    few[:3] = [1.0, 2.0, 6.0]
    assert np.allclose(gapfill.kriged(i, j, few, 0)[3:], 3.0)
    assert np.isnan(gapfill.kriged(i, j, np.full(64, np.nan), 0)).all()


def test_fill_reports_what_it_did(spark):
    a = np.arange(16.0).reshape(4, 4)
    a[1, 1] = np.nan
    out = gapfill.fill(grid_of(spark, a, t=1), ["t"], "t long", "v", "nearest")
    assert out.where("gap_type = 1").count() == 1 and out.where("filled IS NULL").count() == 0
    with pytest.raises(ValueError):
        gapfill.fill(grid_of(spark, a, t=1), ["t"], "t long", "v", "guess")


# -- sources and plans --------------------------------------------------------------------------------------

BULLETIN = """ASUS01 KWBC\nCODSUS\nVALID 010203Z\nHIGHS 1022 3999\nCOLD WK 40100 41101 42102\nSTNRY 35090 35091\nTROF 30080 31081\n$$"""


def test_bulletins(spark, tmp_path):
    partial = BULLETIN.replace(" 41101 42102", "")
    other = BULLETIN.replace("40100", "4010000").replace("010203Z", "010206Z")
    (tmp_path / "month.txt").write_text("\x01".join([partial, BULLETIN, other, "prose without a stamp"]))
    got = [tuple(r) for r in bulletins.points_of(bulletins.read_bulletins(spark, str(tmp_path)), "text", F.lit(2016)).orderBy("line_id", "seq").select("kind", "seq", "lat", "lon").collect()]
    assert got == [("cold", 1, 40.0, -100.0), ("cold", 2, 41.0, -101.0), ("cold", 3, 42.0, -102.0), ("stationary", 1, 35.0, -90.0), ("stationary", 2, 35.0, -91.0)]


def test_xml_lines_unwrap(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<Product><Line pgenType="COLD_FRONT"><Point Lat="30" Lon="-178"/><Point Lat="31" Lon="178"/><Point Lat="-9999" Lon="10359"/><Point Lat="32" Lon="-170"/></Line></Product>')
    points = bulletins.read_xml_lines(spark, str(tmp_path / "a.xml"))
    out = bulletins.split_and_unwrap(points, ["line_id"], -101.0).orderBy("seq").collect()
    assert [(r["run"], r["lon"]) for r in out] == [(0, -178.0), (0, -182.0), (1, -170.0)]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.optional(spark, path, "a int").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.optional(spark, path, "a int", required=True)
    calls = []
    for _ in range(2):
        assert tables.cached(spark, str(tmp_path), "key", lambda: calls.append(1) or spark.range(3)).count() == 3
    assert calls == [1]
    k = frame(spark, i=[0, 1], j=[0, 1], v=[0.0, 2.0])
    tables.write_sparse(k, "v", path)
    assert spark.read.parquet(path).count() == 1
    axis = lambda n: spark.range(2).select(F.col("id").alias(n))
    assert tables.read_dense(spark, path, "v", {"i": axis("i"), "j": axis("j")}).agg(F.sum("v"), F.count("v")).first() == (2.0, 4)
    parts = str(tmp_path / "p")
    tables.write_partitions(frame(spark, y=[1, 2], v=[1, 2]), parts, "y")
    tables.write_partitions(frame(spark, y=[2], v=[5]), parts, "y")
    assert {(r["y"], r["v"]) for r in spark.read.parquet(parts).collect()} == {(1, 1), (2, 5)}
    assert tables.files_by_date(spark, parts, r"y=(\d+)").select("stamp").distinct().count() == 2


def test_config():
    with pytest.raises(ValueError, match="unknown settings"):
        config.RunConfig.from_dict({"rep": 5})
    with pytest.raises(ValueError):
        config.RunConfig(inference="other")
    a, b = config.RunConfig.from_json('{"reps": 7, "hypotheses": ["x"]}'), config.RunConfig(reps=7)
    assert a.hypotheses == ("x",) and a.key("reps") == b.key("reps") != config.RunConfig().key("reps")
    reg = [config.Hypothesis("a", "x", "f", topline=True), config.Hypothesis("b", "y", "f")]
    assert [h.id for h in config.select(reg, "topline")] == ["a"]
    with pytest.raises(ValueError):
        config.select(reg, ["c"])
    assert len(config.experiment_grid({"p": [1, 2], "q": "abc"})) == 6


def test_suite_finds_signal_and_not_noise(spark):
    rng = np.random.default_rng(9)
    n = 6000
    x, noise, c = rng.random(n), rng.random(n), rng.random(n)
    df = frame(spark, key=np.arange(n), day=np.arange(n) // 60, slot=np.arange(n) % 6, x=x, noise=noise, c=c, flag=rng.random(n) < 0.3 * x)
    reg = [config.Hypothesis("signal", "x", "flag", "+", controls=("c",), strata=("phase",)), config.Hypothesis("noise", "noise", "flag", "+")]
    out = suite.verdict(suite.run(df, reg, {"phase": F.when(F.col("slot") > 2, "late").otherwise("early")}, config.RunConfig(reps=200, rank_bins=32), "key"))
    got = {(r["id"], r["scope"]): r["verdict"] for r in out.collect()}
    assert got[("signal", "overall")] == got[("signal", "ctrl:c")] == got[("signal", "phase=late")] == "supported"
    assert got[("noise", "overall")] == "null"
    assert len(got) == 5


def test_kriging_of_many_points_matches_one_dense_system(monkeypatch):
    rng = np.random.default_rng(4)
    lat, lon = (a.ravel() for a in np.mgrid[0:24, 0:20].astype(float))
    v = np.where(rng.random(480) < 0.3, np.nan, np.sin(lat / 4) + lon / 9 + rng.normal(0, 0.1, 480))
    want = gapfill.kriged(lat, lon, v)
    monkeypatch.setattr(gapfill, "DENSE_POINTS", 10)
    monkeypatch.setattr(gapfill, "BLOCK", 64)
    assert np.allclose(gapfill.kriged(lat, lon, v), want, atol=1e-6) and not np.isnan(want).any()
