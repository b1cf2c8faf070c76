"""Point reads, expected swaths, base tables of a configuration, and pooled results."""

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import grid, pooling
from eventide.plans.base_table import BaseConfig, build_base_table, prepare
from eventide.sources.point_scan import lay_out, nearest_index, point_profile

DAY = datetime.date(2024, 3, 1)


def archive(spark, days=4):
    return spark.range(days * 40 * 36).select(
        F.date_add(F.lit(DAY), (F.col("id") % days).cast("int")).alias("day"), (F.expr("id div 4 % 40") - 20).cast("double").alias("lat"), (F.expr("id div 160") * 5.0).alias("lon"), (F.col("id") % 7).cast("double").alias("qv"), F.col("id").alias("u")
    )


def test_point_reads_skip_files(spark, tmp_path):
    df, at = archive(spark), str(tmp_path / "a")
    lay_out(df, at)
    got = point_profile(spark, at, (3.4, 11.0), DAY + datetime.timedelta(days=1), 2, ((-20.0, 1.0), (0.0, 5.0)), ["qv"])
    want = df.where((F.col("lat") == 3) & (F.col("lon") == 10) & F.col("day").isin([DAY + datetime.timedelta(days=i) for i in (1, 2)]))
    assert sorted((r["day"], r["u"], r["qv"]) for r in got.collect()) == sorted((r["day"], r["u"], r["qv"] or None) for r in want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    partitions = plan.split("PartitionFilters: [")[1].split("]")[0]
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "day" in partitions and "band" in partitions and "GreaterThanOrEqual(lat" in pushed and "IsNotNull(lon)" in pushed
    everything = sum(name.endswith(".parquet") for _, _, names in os.walk(at) for name in names)
    read = got.select(F.input_file_name()).distinct().count()
    assert read <= 2 and everything >= 16  # one file a day


def test_point_reads_prefer_the_denser_archive(spark, tmp_path):
    df = archive(spark)
    lay_out(df, str(tmp_path / "a"))
    lay_out(df.where(F.col("day") == DAY).withColumn("u", -F.col("u") - 1), str(tmp_path / "dense"))
    got = point_profile(spark, str(tmp_path / "a"), (0, 0), DAY, 6, ((-20.0, 1.0), (0.0, 5.0)), denser=str(tmp_path / "dense"))
    rows = got.collect()
    assert {r["day"] for r in rows} == {DAY + datetime.timedelta(days=i) for i in range(4)}  # two days are absent
    assert all((r["u"] < 0) == (r["day"] == DAY) for r in rows)
    assert nearest_index(2.5, 0, 1) == 2 and nearest_index(3.5, 0, 1) == 4


def test_an_overcast_stretch_is_told_by_the_bank(spark):
    """Nothing is observed: closing finds no swath, the bank of other overpasses does; few overpasses fall back."""
    cells = [(i, j) for i in range(4) for j in range(6)]
    observed = spark.createDataFrame([(d, h, i, j, d == 2 and j < 2) for d in (1, 2) for h in (0, 12) for i, j in cells], "d int, h int, lat int, lon int, seen boolean")
    bank = spark.createDataFrame([(1, 0, i, j, 9, 0.8 if j < 3 else 0.1) for i, j in cells if (i, j) != (0, 0)] + [(2, 0, i, j, 3, 0.9) for i, j in cells], "cycle_day int, hour int, lat int, lon int, n_days long, frequency double")
    out = grid.gap_types(observed, bank, ["d", "h"], "d int, h int", "seen", "d", "h", F.col("d"), domain=F.col("lat") < 3)
    rows = {(r["d"], r["h"], r["lat"], r["lon"]): (r["source"], r["gap"]) for r in out.collect()}
    assert len(rows) == 4 * len(cells)
    assert rows[1, 0, 1, 2] == ("bank", "cloud") and rows[1, 0, 1, 3] == ("bank", "out_of_swath") and rows[1, 0, 0, 0] == ("bank", "out_of_swath")
    assert rows[1, 12, 1, 2] == ("envelope", "out_of_swath") and rows[2, 0, 1, 1] == ("envelope", "observed") and rows[2, 0, 1, 4] == ("envelope", "out_of_swath")
    assert rows[1, 0, 3, 1][1] == "out_of_domain"
    alone = grid.gap_types(observed, None, ["d", "h"], "d int, h int", "seen", "d", "h", F.col("d"))
    assert {r["source"] for r in alone.collect()} == {"envelope"}


def test_only_changed_parts_are_compiled(spark, tmp_path):
    source = spark.range(300).select(F.date_add(F.lit(datetime.date(2020, 1, 1)), (F.col("id") * 5).cast("int")).alias("day"), (F.col("id") % 6).cast("int").alias("slot"), (F.col("id") % 5).cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.col("id").cast("double").alias("v"))
    built = []

    def compile_part(df, part):
        built.append(part)
        out = df.select("day", "slot", "lat", "v")
        return out.withColumn("late", F.lit(1)) if part == 2021 else out

    cfg = BaseConfig(parts=(2020, 2021, 2022), slots=(0, 1, 2), lat_range=(1, 9))
    root = str(tmp_path)
    first = build_base_table(source, cfg, root, compile_part)
    assert built == [2020, 2021, 2022]
    want = source.where("slot < 3 AND lat >= 1 AND year(day) <= 2022")
    assert sorted(r["v"] for r in first.collect()) == sorted(r["v"] for r in want.collect())
    assert {(r["day"].year == 2021) == (r["late"] == 1) for r in first.collect()} == {True}
    build_base_table(source.repartition(7), cfg, root, compile_part)  # the order of rows does not matter
    assert built == [2020, 2021, 2022]
    changed = source.withColumn("v", F.when((F.year("day") == 2021) & (F.col("slot") == 1), -F.col("v")).otherwise(F.col("v")))
    again = build_base_table(changed, cfg, root, compile_part)
    assert built == [2020, 2021, 2022, 2021] and again.where("v < 0").count() > 0
    build_base_table(source, BaseConfig(parts=(2021, 2023), slots=(0, 1, 2), lat_range=(1, 9)), root, compile_part)
    assert built[4:] == [2023]  # a further part leaves the others
    build_base_table(source, BaseConfig(parts=(2022,), slots=(0, 1, 2), lat_range=(1, 9), version=2), root, compile_part)
    assert built[5:] == [2022]
    with pytest.raises(ValueError, match="2050"):
        build_base_table(source, BaseConfig(parts=(2020, 2050)), root, compile_part)
    done = prepare(source, cfg, root, compile_part, "v", [50, 90], {"odd": F.col("slot") == 1})
    assert built[6:] == [] and set(done.thresholds) == {50, 90}
    v = [r["v"] for r in want.collect()]
    assert done.thresholds[90] == pytest.approx(np.quantile(v, 0.9))
    assert done.table.where("flag_p90").count() == sum(x > done.thresholds[90] for r in want.where("slot = 1").collect() for x in [r["v"]])


def test_names_of_runs(spark):
    names = ["D6C_fold1_kriged-airs", "D6C-ens5_kriged-airs", "bk19", "A_fold12_reanalysis", "_odd", "B_fold0"]
    df = pooling.leg_parts(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, i int"), "name")
    assert {r["name"]: (r["leg"], r["fold"], r["source"]) for r in df.collect()} == {
        "D6C_fold1_kriged-airs": ("D6C_kriged-airs", 1, "kriged-airs"), "D6C-ens5_kriged-airs": ("D6C-ens5_kriged-airs", None, "kriged-airs"), "bk19": ("bk19", None, None),
        "A_fold12_reanalysis": ("A_reanalysis", 12, "reanalysis"), "_odd": ("_odd", None, None), "B_fold0": ("B", 0, None),
    }
    places = {r["leg"]: r["place"] for r in pooling.legs_for_source(df, "kriged-airs", "bk19").collect()}
    assert places == {"bk19": 1, "D6C-ens5_kriged-airs": 2, "D6C_kriged-airs": 3}
    assert {r["name"] for r in pooling.for_fold(df, 12).collect()} == {"A_fold12_reanalysis", "D6C-ens5_kriged-airs", "bk19", "_odd"}


def test_weighted_frames_are_the_pooled_sample(spark):
    rng = np.random.default_rng(1)
    parts = [rng.normal(i, 1 + i, n) for i, n in enumerate((5, 40, 200))]
    rows = [("k", len(x), float(x.mean()), float(np.sqrt((x**2).mean())), float(x.std())) for x in parts] + [("k", 0, 99.0, 99.0, 99.0), ("k", 7, None, None, None), ("z", 3, None, None, None)]
    df = spark.createDataFrame(rows, "g string, n long, mean double, rms double, sd double")
    got = {r["g"]: r for r in pooling.weighted_frames(df, ["g"], "n", ["mean"], ["rms"], {"sd": "mean"}).collect()}
    x = np.concatenate(parts)
    assert (got["k"]["n"], got["z"]["mean"], got["z"]["sd"]) == (252, None, None)
    assert (got["k"]["mean"], got["k"]["rms"], got["k"]["sd"]) == pytest.approx((x.mean(), np.sqrt((x**2).mean()), x.std()))


def test_permutation_costs_take_means_and_the_coarsest_dilation(spark):
    rows = [
        ("m_fold0_a", "t", "mean", 2, "cold", 0.4), ("m_fold0_a", "t", "raw", 2, "cold", 9.0), ("m_fold0_a", "t", "mean", 1, "cold", 9.0), ("m_fold0_a", "baseline", "mean", 5, "cold", 9.0), ("m_fold0_a", "t", "mean", 2, "none", 9.0),
        ("m_fold1_a", "t", "raw", 3, "cold", 0.1), ("m_fold1_a", "t", "raw", 3, "cold", 0.3), ("m_fold1_b", "t", "raw", 3, "cold", 0.7), ("nosource", "t", "raw", 3, "cold", 9.0),
    ]
    df = spark.createDataFrame(rows, "run string, channel string, stat string, dilation int, front string, cost double")
    got = {(r["source"], r["leg"], r["front"], r["channel"]): r["cost"] for r in pooling.permutation_costs(df, "run", "baseline", "none", "cost").collect()}
    assert got == {("a", "m", "cold", "t"): pytest.approx(0.3), ("b", "m", "cold", "t"): pytest.approx(0.7)}
