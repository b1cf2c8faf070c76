"""Ranks, bins and percentiles where most rows share one value."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import inference, rank, thresholds, windows


def inflated(spark, n=6000, keys=1):
    """Nine of ten values are 0; ties tell the rows apart."""
    rng = random.Random(3)
    return [(k, 0.0 if rng.random() < 0.9 else round(rng.uniform(0.1, 5), 2), i) for k in range(keys) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("bins, most", [(1, 0), (5, 0), (16, 10_000), (97, 0)])
def test_bins_of_tied_values_match_a_sort(spark, monkeypatch, bins, most):
    monkeypatch.setattr(rank, "SORTED", most)
    rows = inflated(spark)
    df = spark.createDataFrame(rows, "k int, v double, i long").repartition(7)
    got = {r["i"]: r["bin"] for r in rank.equal_count_bins(df, [], "v", "i", bins).collect()}
    assert got == {i: j * bins // len(rows) for j, (_, _, i) in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}


@pytest.mark.parametrize("most", [0, 10_000])
def test_bins_by_key_with_nulls_and_repeated_rows(spark, monkeypatch, most):
    monkeypatch.setattr(rank, "SORTED", most)
    rows = inflated(spark, 500, 3) + [(0, None, 7), (1, None, None)]
    df = spark.createDataFrame(rows, "k int, v double, i long")
    got = Counter((r["k"], r["i"], r["bin"]) for r in rank.equal_count_bins(df, ["k"], "v", "i", 8).collect())
    want = Counter()
    for k in range(3):
        own = sorted((r for r in rows if r[0] == k and r[1] is not None), key=lambda r: (r[1], r[2]))
        want.update((k, i, j * 8 // len(own)) for j, (_, _, i) in enumerate(own))
    assert got == want
    equal = spark.createDataFrame([(1.0, None)] * 3 + [(1.0, 4)] * 2 + [(1.0, 5)] * 3, "v double, i long")
    assert Counter((r["i"], r["bin"]) for r in rank.equal_count_bins(equal, [], "v", "i", 4).collect()) == {(None, 0): 3, (4, 1): 2, (5, 2): 3}
    assert rank.equal_count_bins(equal.limit(0), [], "v", "i", 4).count() == 0


def test_no_task_ranks_the_common_value_alone(spark):
    """Rows of the value that nine of ten rows hold, by the task that ranks them: none has twice the median."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(inflated(spark, 40_000), "k int, v double, i long")
        zeros = rank.value_groups(df.where("v = 0"), ["v"], "i", {"n": F.count(F.lit(1))})
        ranked = rank.running_totals(zeros, ["v"], "i", ["n"], ranges=256)
        sizes = sorted(r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) > 35_000 and len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_percentiles_match_numpy(spark):
    rows = inflated(spark, 3000, 2)
    df = spark.createDataFrame([*rows, (0, None, 1)], "k int, v double, i long")
    at = [0, 0.1, 0.5, 0.9, 0.95, 0.997, 1]
    for r in rank.percentiles(df, "v", at, ["k"]).collect():
        assert r["q"] == pytest.approx(np.quantile([v for k, v, _ in rows if k == r["k"]], at).tolist())
    assert rank.percentiles(df, "v", at).first()["q"] == pytest.approx(np.quantile([v for _, v, _ in rows], at).tolist())
    assert thresholds.percentile_thresholds(df.where("k = 9"), "v", [10, 50]) == [None, None]
    assert rank.percentiles(df.where("k = 9"), "v", at, ["k"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 11, 70, 150_000])
def test_percentiles_of_small_and_large_tables(spark, n):
    at = [0.005, 0.05, 0.5, 0.9, 0.95, 0.99]
    v = np.random.default_rng(n).exponential(size=n).round(3 if n < 100 else 6)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(5)
    assert rank.percentiles(df, "v", at).first()["q"] == pytest.approx(np.quantile(v, at).tolist())


def test_quantile_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 0, 1, 2, 3, 4)] + [(None,)], "v double")
    got = Counter((r["v"], r["b"]) for r in windows.quantile_bins(df, "v", [0.5, 0.75], "b").collect())
    assert got == {(0.0, 0): 3, (1.0, 0): 1, (2.0, 1): 1, (3.0, 2): 1, (4.0, 2): 1, (None, None): 1}


def test_false_discovery_matches_the_step_up_rule(spark):
    rng = np.random.default_rng(2)
    p = [*np.round(rng.random(300) ** 3, 4).tolist(), 0.0004, 0.0004]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*p, None])], "i long, p double")
    order, cut = sorted(p), -1.0
    for k, x in enumerate(order, 1):
        if x <= 0.05 * k / len(order):
            cut = x
    assert {r["i"]: r["fdr_significant"] for r in inference.fdr(df).collect()} == {**{i: x <= cut for i, x in enumerate(p)}, len(p): False}
    assert [r["fdr_significant"] for r in inference.fdr(df.where("p IS NULL")).collect()] == [False]


@pytest.mark.parametrize("most", [1, 40, 1000, 1 << 30])
def test_percentiles_by_narrowing(spark, most):
    """Hot values, null keys and values, keys without values; the same numbers however few rows fit into one buffer."""
    rng = np.random.default_rng(3)
    v = np.where(rng.random(6000) < 0.35, 7.0, np.round(rng.normal(0, 10, 6000), 2))
    rows = [(None if i % 11 == 0 else i % 3, None if i % 13 == 0 else float(x)) for i, x in enumerate(v)] + [(9, None), (8, 2.5)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    at = [0, 0.001, 0.25, 0.3333, 0.5, 0.9, 0.999, 1]
    got = {r["k"]: r["q"] for r in rank.percentiles(df, "v", at, ["k"], most=most).collect()}
    assert set(got) == {0, 1, 2, 8, None}
    for k, q in got.items():
        assert q == pytest.approx(np.quantile([x for a, x in rows if a == k and x is not None], at).tolist(), abs=1e-12)
    whole = rank.percentiles(df, "v", at, most=most).collect()
    assert len(whole) == 1 and whole[0]["q"] == pytest.approx(np.quantile([x for _, x in rows if x is not None], at).tolist(), abs=1e-12)
    assert rank.percentiles(df.limit(0), "v", at, most=most).collect()[0]["q"] == [None] * len(at)


@pytest.mark.parametrize(("rows", "most"), [(3000, 25), (30000, 25), (30000, 400)])
def test_narrowing_leaves_bounded_windows(spark, rows, most):
    """Ten times the rows, one value on a third of them: what is sorted at the end stays below the bound, and nothing is lost."""
    df = spark.range(rows).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(5)).alias("_v"))
    asked = spark.range(0, rows, rows // 37).select(F.col("id").alias("_rank"))
    answers, rest, targets = rank.narrowed(df, asked, [], [0.5], most)
    assert (rest.groupBy("_part").count().agg(F.max("count")).first()[0] or 0) <= most
    assert answers.count() + targets.count() == asked.count()
    want = np.sort([r[0] for r in df.collect()])
    found = rank.selected(df, asked, [], [0.5], most).collect()
    assert len(found) == asked.count() and all(r["_v"] == want[r["_rank"]] for r in found)
