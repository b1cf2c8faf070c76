"""Paths of any length: the same numbers in ranges as in one window, and no range with most of a path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import segments, trajectory, windows


def points(spark, n=3000):
    """A third of all points in one path; a path with a gap, single points, a null path, repeated times."""
    rng = np.random.default_rng(1)
    rows = [(None if p == 0 else p, int(t), round(float(x), 3), round(float(y), 3)) for p, many in ((1, n // 3), *((q, 2 * n // 3 // 40) for q in range(2, 42)), (0, 30), (50, 1)) for t, (x, y) in enumerate(rng.normal(0, 5, (many, 2)))]
    rows += [(60, t, None if t == 5 else float(t), 1.0) for t in range(9)] + [(61, 0, None, 1.0), (61, 1, 1.0, 1.0)]
    return spark.createDataFrame(rows, "path int, t long, x double, y double").repartition(5)


def rows_of(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("most", [3, 100])
def test_scans_in_ranges_are_scans(spark, most):
    df = points(spark)
    for f in (
        lambda m: windows.path_length(df, ["path"], "t", "x", "y", most=m),
        lambda m: windows.residence_hours(df, ["path"], "t", "t", "h", most=m),
        lambda m: trajectory.resample(df.withColumn("t", F.col("t") * 7), ["path"], "t", ["x", "y"], 3, most=m),
    ):
        assert rows_of(f(most)) == rows_of(f(1 << 30))


def test_a_path_with_a_third_of_all_rows_is_spread(spark):
    df = points(spark, 30000)
    rows, group = segments.segmented(df, ["path"], ["t"], most=1000)
    assert group == ["path", "_seg"] and rows.count() == df.count()
    sizes = sorted(r["count"] for r in rows.groupBy(*group).count().collect())
    assert sizes[-1] <= 2 * 500  # the longest range is no longer than two usual paths
    ends = {r["_seg"]: (r["a"], r["b"]) for r in rows.where("path = 1").groupBy("_seg").agg(F.min("t").alias("a"), F.max("t").alias("b")).collect()}
    order = [ends[s] for s in sorted(ends)]
    assert len(order) > 30 and all(a[1] < b[0] for a, b in zip(order, order[1:], strict=False))
    assert rows.where("path <> 1 OR path IS NULL").agg(F.max("_seg")).first()[0] == 0
    assert segments.segmented(df, ["path"], ["t"], most=1 << 30)[1] == ["path"]
    assert segments.segmented(df.limit(0), ["path"], ["t"])[0].count() == 0


def test_totals_of_unknown_values(spark):
    """Sums over nulls stay null until something is known, across borders too."""
    df = spark.createDataFrame([(1, t, None if t < 50 else 1.0) for t in range(200)], "path int, t long, v double")
    out = []
    for most in (10, 1 << 30):
        rows, group = segments.segmented(df, ["path"], ["t"], most)
        out.append(rows_of(segments.totals(rows, ["path"], group, ["t"], {"s": F.col("v")}, {"w": F.col("v")}, {"a": F.col("t")}, {"b": F.col("v")}).select("t", "s", "w", "a", "b")))
    assert out[0] == out[1] and out[0][0][1] is None


def test_deposit_covers_the_circle_and_nothing_else(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 3, float(a), float(b), float(s), 1.0) for i, (a, b, s) in enumerate(zip(rng.uniform(-9, 9, 60), rng.uniform(-9, 9, 60), rng.choice([0.1, 0.5, 0.75, 1.3, 2.0], 60), strict=True))]
    rows += [(0, 2.0, -3.0, 0.5, 1.0), (1, 0.5, 0.5, 1.0, 2.0)]  # the circle's edge lies on cells
    df = spark.createDataFrame(rows, "k int, y double, x double, s double, m double")
    want = {}
    for k, y, x, s, m in rows:
        if s < 0.5:
            cells = {(int(np.rint(y)), int(np.rint(x))): 1.0}
        else:
            r, i0, j0 = int(np.ceil(4 * s)), int(np.rint(y)), int(np.rint(x))
            cells = {(i, j): np.exp(-((i - y) ** 2 + (j - x) ** 2) / (2 * s * s)) for i in range(i0 - r, i0 + r + 1) for j in range(j0 - r, j0 + r + 1) if (i - y) ** 2 + (j - x) ** 2 <= (4 * s) ** 2}
        for c, w in cells.items():
            want[k, *c] = want.get((k, *c), 0) + m * w / sum(cells.values())
    got = {(r["k"], r["ilat"], r["ilon"]): r["mass"] for r in trajectory.deposit(df, ["k"], "y", "x", "s", "m").collect()}
    assert set(got) == set(want) and all(got[c] == pytest.approx(want[c], rel=1e-9) for c in want)
