"""Grouped statistics: mergeable climatologies, wide and long forms, contingency, digests, pooled errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import percentiles


def count_events(df: DataFrame, cell: Sequence[str], value: str, threshold: float, day: str = "day") -> DataFrame:
    """(cell, n_hours, n_days, largest) of values at or above a threshold."""
    return df.where(F.col(value) >= threshold).groupBy(*cell).agg(F.count(F.lit(1)).alias("n_hours"), F.countDistinct(day).alias("n_days"), F.max(value).alias("largest"))


def stats_by_group(df: DataFrame, variables: Sequence[str], groups: dict[str, Column], quantiles: Sequence[float]) -> DataFrame:
    """(variable, group, n, mean, sd, q): statistics of each variable over overlapping groups, from one scan."""
    member = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]))
    parts = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])
    long = df.select(F.explode(member).alias("group"), parts.alias("p")).select("group", F.explode("p").alias("p")).select("group", "p.*")
    moments = long.groupBy("variable", "group").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return moments.join(percentiles(long, "value", quantiles, ["variable", "group"]), ["variable", "group"], "left")


def additive_climatology(df: DataFrame, keys: Sequence[str], value: str, time: str) -> DataFrame:
    """(keys, total, squares, n_obs, n_times): sums that merge by addition."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*keys).agg(F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.count(v).alias("n_obs"), F.countDistinct(time).alias("n_times"))


def merge_climatologies(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Sum of additive tables over disjoint times."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("total", "squares", "n_obs", "n_times")])


def climatology_moments(sums: DataFrame) -> DataFrame:
    """Adds mean and sample deviation (null below two values)."""
    n, s, q = F.col("n_obs"), F.col("total"), F.col("squares")
    return sums.withColumn("mean", s / n).withColumn("sd", F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))))


def slots_wide(df: DataFrame, keys: Sequence[str], values: Sequence[str], slots: Sequence[int]) -> DataFrame:
    """One row per key with columns ``<value>_h<slot>``; the slots are given, so no pass is spent on finding them."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("slot") == s, F.col(v))).alias(f"{v}_h{s}") for v in values for s in slots])


def slots_long(wide: DataFrame, keys: Sequence[str], values: Sequence[str], slots: Sequence[int]) -> DataFrame:
    """The inverse of :func:`slots_wide`: (keys, slot, values)."""
    parts = F.array(*[F.struct(F.lit(s).alias("slot"), *[F.col(f"{v}_h{s}").alias(v) for v in values]) for s in slots])
    return wide.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*")


def norm_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, low, high, mean, sd) with population deviation."""
    wide = df.agg(*[x for c in columns for x in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"), F.avg(c).alias(f"c_{c}"), F.stddev_pop(c).alias(f"d_{c}"))])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"{k}_{c}").cast("double").alias(n) for k, n in zip("abcd", ("low", "high", "mean", "sd"), strict=True)]) for c in columns])).alias("v")).select("v.*")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): inverse square root of frequency, scaled to mean 1 over classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.avg(1 / F.sqrt("n")).alias("_m"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (1 / F.sqrt("n") / F.col("_m")).alias("weight"))


def confusion(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.groupBy(truth, prediction).agg(F.count(F.lit(1)).alias("n"))


def digest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(digest): SHA-1 of the ordered counts per key; the counts are as few as the keys."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    line = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("n").cast("string"))
    return counts.agg(F.sha1(F.array_join(F.sort_array(F.collect_list(line)), "|")).alias("digest"))


def overlap(df: DataFrame, a: Column, b: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, both, either, iou) of two boolean expressions."""
    out = df.groupBy(*keys).agg(F.count_if(a & b).alias("both"), F.count_if(a | b).alias("either"))
    return out.withColumn("iou", F.col("both") / F.nullif(F.col("either"), F.lit(0)))


def overlaps(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """(a, b, iou) of all pairs of named boolean expressions, in one aggregate."""
    names = list(masks)
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    wide = df.agg(*[(F.count_if(masks[x] & masks[y]) / F.nullif(F.count_if(masks[x] | masks[y]), F.lit(0))).alias(f"{x}|{y}") for x, y in pairs])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{x}|{y}`").alias("iou")) for x, y in pairs])).alias("p")).select("p.*")


def known_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, fraction) of rows with a value."""
    wide = df.agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("fraction")) for c in columns])).alias("v")).select("v.*")


def binned_median(df: DataFrame, value: str, by: str, width: float) -> DataFrame:
    binned = df.select(F.floor(F.col(by) / width).alias("bin"), F.col(value).alias("_x")).where("bin IS NOT NULL")
    medians = percentiles(binned, "_x", [0.5], ["bin"]).select("bin", F.col("q")[0].alias("median"))
    return binned.groupBy("bin").agg(F.count("_x").alias("n")).join(medians, "bin", "left").select("bin", "median", "n")


def histogram2d(df: DataFrame, x: str, y: str, dx: float, dy: float, over: Column, min_count: int) -> DataFrame:
    """(ix, iy, n, pct_over) of bins with enough rows."""
    out = df.groupBy(F.floor(F.col(x) / dx).alias("ix"), F.floor(F.col(y) / dy).alias("iy")).agg(F.count(F.lit(1)).alias("n"), (100.0 * F.avg(over.cast("int"))).alias("pct_over"))
    return out.where(F.col("n") >= min_count)


def column_slope(df: DataFrame, keys: Sequence[str], x: str, y: str, low: float, high: float, fallback: float, fewest: int = 3, span: float = 0.0) -> DataFrame:
    """(keys, slope): least squares within keys, clipped; the fallback where points or their span are too few."""
    fit = F.regr_slope(y, x)
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    good = (n >= fewest) & (F.max(x) - F.min(x) > span) & fit.isNotNull()
    return df.groupBy(*keys).agg(F.when(good, F.greatest(F.lit(low), F.least(F.lit(high), fit))).otherwise(F.lit(fallback)).alias("slope"))


def hypsometric_height(df: DataFrame, cell: Sequence[str], temperature: str, sea_level: str, surface: str) -> DataFrame:
    """(cell, height): elevation from time means, ``(R T / g) ln(p0 / p)``, not below 0."""
    means = df.groupBy(*cell).agg(*[F.avg(c).alias(f"_{i}") for i, c in enumerate((temperature, sea_level, surface))])
    return means.select(*cell, F.greatest(F.lit(0.0), 287.05 * F.col("_0") / 9.80665 * F.log(F.col("_1") / F.col("_2"))).alias("height"))


def pooled_rmse(df: DataFrame, keys: Sequence[str], n: str, rmse: str, bias: str) -> DataFrame:
    """(keys, n, rmse, bias): errors pooled by their counts."""
    w = F.col(n)
    return df.groupBy(*keys).agg(F.sum(w).alias("n"), F.sqrt(F.sum(w * F.col(rmse) * F.col(rmse)) / F.sum(w)).alias("rmse"), (F.sum(w * F.col(bias)) / F.sum(w)).alias("bias"))


def coverage_bank(df: DataFrame, cycle: Column, keys: Sequence[str], seen: Column, day: str, enough: int = 5) -> DataFrame:
    """(cycle_day, keys, n_seen, n_days, frequency, enough): how often a cell is observed by day of the cycle."""
    out = df.groupBy(cycle.alias("cycle_day"), *keys).agg(F.count_if(seen).alias("n_seen"), F.countDistinct(day).alias("n_days"), F.avg(seen.cast("int")).alias("frequency"))
    return out.withColumn("enough", F.col("n_days") >= enough)


def zero_fraction(df: DataFrame, value: Column, by: Column) -> DataFrame:
    return df.groupBy(by.alias("bin")).agg(F.avg((value == 0).cast("int")).alias("zero_fraction"), F.count(F.lit(1)).alias("n"))


def matrix(df: DataFrame, row: str | Sequence[str], column: str, columns: Sequence[int], value: str) -> DataFrame:
    """A pivot of fixed geometry: one column ``c<k>`` per listed key, missing cells null."""
    return df.groupBy(*([row] if isinstance(row, str) else row)).agg(*[F.max(F.when(F.col(column) == k, F.col(value))).alias(f"c{k}") for k in columns])


def spread_factor(df: DataFrame, u: str, v: str, u_sd: str, v_sd: str, members: str, pressure: str, least_pressure: float = 850.0, fewest: int = 5) -> DataFrame:
    """(n, factor): mean spread of the winds over their mean speed, of low boxes with enough members; null without any."""
    ok = (F.col(pressure) >= least_pressure) & (F.col(members) >= fewest)
    boxes = df.where(ok).dropna(subset=[u, v, u_sd, v_sd])
    length = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    return boxes.agg(F.count(F.lit(1)).alias("n"), (F.avg(length(u_sd, v_sd)) / F.nullif(F.avg(length(u, v)), F.lit(0.0))).alias("factor"))
