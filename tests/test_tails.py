"""Tail curves and the folders of tests against plain versions."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.plans import suite

RESULT = "id string, scope string, n long, n_events long, gini double, ci_lo double, ci_hi double, se_naive double, se_block double, expected string, fdr_significant boolean"


def plain(x, key, event, bins):
    """Cumulative event rates over equal-count bins, ties by key."""
    order = np.lexsort((key, x))
    bin_ = np.arange(len(x)) * bins // len(x)
    n = np.bincount(bin_, minlength=bins)
    e = np.bincount(bin_, weights=event[order], minlength=bins)
    rate = np.divide(e, n, out=np.zeros(bins), where=n > 0)
    return n, e, np.cumsum(rate) / rate.sum() if rate.sum() else np.full(bins, np.nan)


@pytest.mark.parametrize("rows, bins", [(1000, 100), (257, 10), (30, 100)])
def test_tail_curves_match_numpy(spark, rows, bins):
    rng = np.random.default_rng(rows)
    pdf = pd.DataFrame({"k": np.arange(rows), "a": rng.integers(0, 40, rows).astype(float), "b": np.where(rng.random(rows) < 0.7, 0.0, rng.random(rows)), "y": rng.gamma(1.0, 2.0, rows)})
    got = suite.tail_curves(spark.createDataFrame(pdf), {"first": "a", "second": "b"}, "y", {"p90": 90, "p99": 99}, "k", absolute=False, bins=bins).toPandas()
    assert len(got) == 4 * bins
    for name, c in (("first", "a"), ("second", "b")):
        for label, pct in (("p90", 90), ("p99", 99)):
            n, e, cum = plain(pdf[c].to_numpy(), pdf["k"].to_numpy(), (pdf["y"] > np.percentile(pdf["y"], pct)).to_numpy(), bins)
            own = got[(got["id"] == name) & (got["label"] == label)].sort_values("bin")
            assert own["bin"].tolist() == list(range(1, bins + 1))
            assert own["n"].tolist() == n.tolist() and own["n_events"].tolist() == e.tolist()
            np.testing.assert_allclose(own["cum_freq"], cum, atol=1e-12)


def test_absolute_levels_missing_values_and_no_events(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 7.0), (3, None, 9.0), (4, 3.0, None), (5, 4.0, 8.0)], "k int, x double, y double")
    got = suite.tail_curves(df, {"x": "x"}, "y", {"high": 6.0, "never": 100.0}, "k", bins=3).orderBy("label", "bin").collect()
    assert [(r["label"], r["bin"], r["n"], r["n_events"], r["cum_freq"]) for r in got] == [("high", 1, 1, 0, 0.0), ("high", 2, 1, 1, 0.5), ("high", 3, 1, 1, 1.0), ("never", 1, 1, 0, None), ("never", 2, 1, 0, None), ("never", 3, 1, 0, None)]
    assert suite.tail_curves(df.where("k < 0"), {"x": "x"}, "y", {"high": 6.0}, "k").count() == 0


def test_stored_curves_of_dropped_tests_and_other_samples_are_not_seen(spark, tmp_path):
    at = str(tmp_path / "tails")
    curves = spark.createDataFrame([("01", "p90", 1, 4, 1, 0.5), ("two", "p90", 1, 4, 2, 0.25)], "id string, label string, bin int, n long, n_events long, cum_freq double")
    suite.write_tail_curves(curves, at, "old")
    suite.write_tail_curves(curves, at, "new")
    suite.write_tail_curves(curves.where("id = '01'").withColumn("cum_freq", F.lit(0.75)), at, "new")
    results = spark.createDataFrame([("01",), ("01",)], "id string")
    assert [tuple(r) for r in suite.load_tail_curves(results, at, "new").collect()] == [("01", "p90", 1, 4, 1, 0.75)]
    both = spark.createDataFrame([("01",), ("two",)], "id string")
    assert sorted(r["cum_freq"] for r in suite.load_tail_curves(both, at, "new").collect()) == [0.25, 0.75]
    assert sorted(r["cum_freq"] for r in suite.load_tail_curves(both, at, "old").collect()) == [0.25, 0.5]


def texts(folder):
    found = {}
    for root, _, names in os.walk(folder):
        for n in names:
            if n.startswith("part-"):
                found.setdefault(os.path.relpath(root, folder), []).append(open(os.path.join(root, n)).read())
    return found


def test_folders_hold_their_lines_in_order(spark, tmp_path):
    at = str(tmp_path / "folders")
    rows = [(i, scope, 900 + n, n, 0.25, 0.125, 0.5, 0.01, 0.02, "+", True) for i in ("h1", "h2") for n, scope in enumerate(["overall", *(f"s={j}" for j in range(200))])]
    rows.append(("h3", "overall", 10, 0, None, None, None, None, None, "-", None))
    results = spark.createDataFrame(rows, RESULT)
    lines = suite.csv_lines(results, "results.csv", ["scope", "n", "gini"], ["n", "scope"]).unionByName(suite.topline(results, {"h1": "The first"}))
    suite.write_folders(lines, at)
    found = texts(at)
    assert sorted(found) == sorted(f"id={i}/file={f}" for i in ("h1", "h2", "h3") for f in ("results.csv", "topline.md"))
    assert all(len(v) == 1 for v in found.values())
    assert found["id=h2/file=results.csv"][0].splitlines() == ["scope,n,gini", "overall,900,0.25", *(f"s={j},{901 + j},0.25" for j in range(200))]
    assert found["id=h1/file=topline.md"][0].splitlines() == ["# h1 - The first", "", "- expected: +, found: supported", "- rows: 900, events: 0", "- gini: +0.2500 [+0.1250, +0.5000]", "- standard error: 0.02000 in blocks of days, 0.01000 of single rows"]
    lone = found["id=h3/file=topline.md"][0].splitlines()
    assert lone[0] == "# h3" and lone[2] == "- expected: -, found: no estimate" and lone[4:] == ["- gini: no estimate", "- standard error: no estimate"]
    assert {r["id"]: r["line"] for r in suite.report_lines(results.where("id <> 'h2'").withColumn("p", F.lit(0.5))).collect()} == {"h1": " | h1 | +0.250 [+0.125, +0.500] | 0.500 | supported | ", "h3": " | h3 | - | 0.500 | no estimate | "}
    suite.write_folders(lines.where("id = 'h1' AND line < 2"), at)  # rebuilt; the others stay
    again = texts(at)
    assert again["id=h1/file=results.csv"][0].splitlines() == ["scope,n,gini", "overall,900,0.25"] and again["id=h2/file=results.csv"] == found["id=h2/file=results.csv"]
