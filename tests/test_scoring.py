"""Given models over tables and grids, and parcels assigned to receptors."""

import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from eventide.operators import receptors, scoring

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


class Affine:
    def __init__(self, w, b):
        self.w, self.b = np.array(w, float), b

    def predict(self, x, batch_size=None, verbose=1):
        assert len(x) <= batch_size and verbose == 0  # only what the signature asks for is given
        return x @ self.w + self.b


class Counting:
    """A model that tells which copy of it answered and how many rows it saw at once."""

    def __init__(self):
        import uuid

        self.name = float(uuid.uuid4().int % 10**9)

    def predict(self, x):
        return np.column_stack([np.full(len(x), self.name), np.full(len(x), len(x))])


class Blur:
    def predict(self, x):
        """Sum over 3 by 3 cells of channel 0 and the largest of channel 1."""
        out = np.zeros((*x.shape[:3], 2))
        p = np.pad(x, ((0, 0), (1, 1), (1, 1), (0, 0)))
        for i in range(3):
            for j in range(3):
                part = p[:, i : i + x.shape[1], j : j + x.shape[2]]
                out[..., 0] += part[..., 0]
                out[..., 1] = np.maximum(out[..., 1], part[..., 1])
        return out


def test_score_numbers_and_missing_inputs(spark):
    rows = [(1, 2.0, [1.0, 2.0], "a"), (2, None, [1.0, 2.0], "b"), (3, float("nan"), [0.0, 0.0], None), (4, 1.0, None, "d"), (None, 0.0, [3.0, 4.0], "e")]
    df = spark.createDataFrame(rows, "id long, x double, v array<double>, score string").repartition(2)
    got = scoring.score(df, Affine([1, 10, 100], 0.5), ["x", "v"], "y")
    assert got.columns == ["id", "x", "v", "score", "y"]
    assert {r["id"]: r["y"] for r in got.collect()} == {1: 212.5, 2: None, 3: None, 4: None, None: 430.5}
    seen = scoring.score(df, Affine([1, 10, 100], 0.5), ["x", "v"], "y", keep=["id"], missing="nan")
    assert {r["id"]: math.isnan(r["y"]) for r in seen.collect()} == {1: False, 2: True, 3: True, 4: True, None: False}
    assert scoring.score(df.limit(0), Affine([1, 1, 1], 0), ["x", "v"], "y").count() == 0


def test_score_keeps_one_model_a_worker_and_bounds_batches(spark):
    df = spark.range(1000).repartition(4).select("id", F.col("id").cast("float").alias("x"))
    got = scoring.score(df, Counting, ["x"], "y", width=2, batch_size=64).collect()  # a loader: the class itself
    assert len(got) == 1000 and max(r["y"][1] for r in got) <= 64
    assert len({r["y"][0] for r in got}) <= 8  # not one a batch (16 and more)
    assert len({r["y"][0] for r in scoring.score(df, Counting(), ["x"], "y", width=2).collect()}) == 1  # an object is copied as it is


def test_score_does_not_shuffle_and_reads_only_its_columns(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2.0 AS x", "id AS other").write.parquet(f"{tmp_path}/t")
    plan = scoring.score(spark.read.parquet(f"{tmp_path}/t"), Affine([1], 0), ["x"], "y", keep=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "other" not in plan


def test_score_refuses_what_is_no_model(spark):
    df = spark.range(3).select("id", F.col("id").cast("double").alias("x"))
    with pytest.raises(TypeError):
        scoring.score(df, 3, ["x"], "y")
    with pytest.raises(ValueError, match="bytes"):
        scoring.score(df, Affine(np.zeros(9_000_000), 0), ["x"], "y")
    with pytest.raises(Exception, match="numbers a row"):
        scoring.score(df, Counting, ["x"], "y").collect()


def test_best_class_takes_the_first_of_equal_scores(spark):
    df = spark.createDataFrame([(1, [0.1, 0.7, 0.7]), (2, [0.0, 0.0]), (3, None)], "id int, s array<double>")
    assert [r[0] for r in df.orderBy("id").select(scoring.best_class("s")).collect()] == [1, 0, None]


@pytest.mark.parametrize(("tile", "halo"), [(4, 1), (5, 2), (64, 1)])
def test_tiles_give_the_uncut_field(spark, tile, halo):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for day in range(2):
        field = rng.integers(1, 50, (13, 9, 2)).astype(float)
        known = rng.random((13, 9)) < 0.8
        field[~known] = 0
        whole = Blur().predict(field[None])[0]
        for i, j in zip(*np.nonzero(known), strict=True):
            rows.append((day, int(i) - 4, int(j) - 2, *field[i, j].tolist()))  # negative rows and columns too
            want[day, int(i) - 4, int(j) - 2] = whole[i, j].tolist()
    df = spark.createDataFrame(rows, "day int, r int, c int, a double, b double").repartition(3)
    got = scoring.score_tiles(df, Blur(), ["day"], "r", "c", ["a", "b"], "y", width=2, tile=tile, halo=halo, fill=0.0, batch_tiles=3)
    assert {(r["day"], r["r"], r["c"]): r["y"] for r in got.collect()} == want


def test_tiles_refuse_two_rows_for_one_cell(spark):
    df = spark.createDataFrame([(0, 1, 1, 1.0), (0, 1, 1, 2.0)], "day int, r int, c int, a double")
    with pytest.raises(Exception, match="two rows for one cell"):
        scoring.score_tiles(df, Blur(), ["day"], "r", "c", ["a"], "y", tile=4, halo=1).collect()


def test_box_assignment_against_brute_force(spark):
    rng = np.random.default_rng(2)
    points = [(i, int(rng.integers(0, 2)), float(rng.integers(-40, 40)) / 4, float(rng.integers(-40, 40)) / 4, float(rng.integers(0, 2000))) for i in range(600)]
    points += [(1000 + i, 0, 1.5, -1.5, 500.0) for i in range(400)]  # a hot spot on two edges
    points += [(2000, 0, None, 1.0, 500.0), (2001, 0, 1.0, None, 500.0), (2002, 0, 1.0, 1.0, None)]
    targets = [(k, w, float(a), float(b)) for k, (w, a, b) in enumerate((w, a, b) for w in range(2) for a in range(-3, 4) for b in range(-3, 4, 2))] + [(99, 0, 1.25, 0.3), (98, 0, None, 0.0)]
    arrivals = spark.createDataFrame(points, "id long, wave int, y double, x double, alt double").repartition(4)
    receptors_df = spark.createDataFrame(targets, "rid long, wave int, rlat double, rlon double")
    got = receptors.within_box(arrivals, receptors_df, ["wave"], "y", "x", 0.5, alt="alt", band=(100, 1500))
    assert got.columns == ["wave", "id", "y", "x", "alt", "rid", "rlat", "rlon"]
    want = [(p[0], t[0]) for p in points for t in targets if p[1] == t[1] and None not in (p[2], p[3], p[4], t[2]) and abs(p[2] - t[2]) <= 0.5 and abs(p[3] - t[3]) <= 0.5 and 100 <= p[4] <= 1500]
    assert sorted((r["id"], r["rid"]) for r in got.collect()) == sorted(want)


def test_box_assignment_on_inexact_edges(spark):
    """Widths that binary fractions cannot hold: the squares never lose what the exact test keeps."""
    half = 0.1
    targets = [(i, i * 0.3) for i in range(200)]
    points = [(3 * i + j, r + d) for i, r in targets for j, d in enumerate((-half, 0.0, half))]
    a = spark.createDataFrame([(i, x, x) for i, x in points], "id long, y double, x double")
    t = spark.createDataFrame([(i, x, x) for i, x in targets], "rid long, rlat double, rlon double")
    want = sorted((i, r) for i, x in points for r, c in targets if abs(x - c) <= half)
    assert sorted((r["id"], r["rid"]) for r in receptors.within_box(a, t, [], "y", "x", half).collect()) == want


def test_nearest_target_takes_each_arrival_once(spark):
    rows = [(1, 10.5, 20.5, 100.0), (2, 11.5, 20.49, 100.0), (3, 9.4, 20.0, 100.0), (4, 10.0, 20.0, 5000.0), (5, 14.5, 24.5, 3000.0), (6, None, 20.0, 1.0), (7, 10.0, 20.0, None)]
    df = spark.createDataFrame(rows, "id long, y double, x double, alt double")
    got = receptors.nearest_target(df, "y", "x", 10.0, 20.0, 1.0, 5, 5, alt="alt", band=(0, 3000))
    assert {r["id"]: (r["tlat"], r["tlon"]) for r in got.collect()} == {1: (10.0, 20.0), 2: (12.0, 20.0), 5: (14.0, 24.0)}
    assert receptors.nearest_target(df, "y", "x", 10.0, 20.0, 1.0, 5, 5).count() == 5  # no band: the missing altitude does not matter


def test_kernels_conserve_mass_and_look_back_only(spark):
    """Two paths; one receptor gets both at different steps.  All contact hours before the arrival are there, none after it."""
    points = [(p, s, float(s), 0.2 * s + p, 0.1 * s) for p in (0, 1) for s in range(8)]
    df = spark.createDataFrame(points, "path int, step int, h double, y double, x double")
    members = spark.createDataFrame([(0, "a", 5), (1, "a", 3), (1, "b", 7)], "path int, rec string, step int")
    out = receptors.receptor_kernels(df, members, ["path"], ["rec"], "step", "h", "y", "x", contact=F.lit(1.0), sigma=F.lit(0.6), most_lag=72)
    rows = out.collect()
    mass = {r: sum(x["mass"] for x in rows if x["rec"] == r) for r in "ab"}
    assert mass["a"] == pytest.approx(5 + 3) and mass["b"] == pytest.approx(7)
    assert {r["rec"]: r["n_parcels"] for r in rows} == {"a": 2, "b": 1} and max(r["lag"] for r in rows if r["rec"] == "a") == 5
    near = receptors.receptor_kernels(df, members.withColumns({"tlat": F.lit(1.0), "tlon": F.lit(0.0)}), ["path"], ["rec", "tlat", "tlon"], "step", "h", "y", "x", contact=F.lit(1.0), sigma=F.lit(0.6), window=1, target=("tlat", "tlon"))
    assert near.where("abs(ilat - 1) > 1 OR abs(ilon) > 1").count() == 0 and near.count() > 0
