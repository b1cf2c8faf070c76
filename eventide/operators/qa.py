"""Quality checks: each gives one row (check, status, value, detail) with PASS, WARN, FAIL or SKIP."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import dilate
from .inference import partial_correlation
from .rank import average_rank, percentiles

RESULT = ("check", "status", "value", "n")


def verdict(df: DataFrame, name: str, value: Column, n: Column, passed: Column, warned: Column | None = None) -> DataFrame:
    """One row from a one-row frame; SKIP without rows or without a value."""
    bad = F.when(warned, "WARN").otherwise("FAIL") if warned is not None else F.lit("FAIL")
    status = F.when((n == 0) | value.isNull(), "SKIP").when(passed, "PASS").otherwise(bad)
    return df.select(F.lit(name).alias("check"), status.alias("status"), value.cast("double").alias("value"), n.cast("long").alias("n"))


def interior_closure(surface: DataFrame, value: str, reach: int, at_least: float) -> DataFrame:
    """Median over cells with no missing cell within reach lies between the bound and 1."""
    near = dilate(surface.where(F.col(value).isNull()), [], reach)
    inside = surface.where(F.col(value).isNotNull()).join(near, ["lat", "lon"], "left_anti")
    m = inside.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(percentiles(inside, value, [0.5]))).withColumn("m", F.col("q")[0])
    return verdict(m, "closure", F.col("m"), F.col("n"), (F.col("m") >= at_least) & (F.col("m") <= 1 + 1e-9))


def upwind_alignment(df: DataFrame, dx: str, dy: str, u: str, v: str, at_least: float, most_wrong: float) -> DataFrame:
    """Displacements point against the wind: median cosine with the reversed wind, few on the wrong side."""
    length = F.sqrt(F.col(dx) ** 2 + F.col(dy) ** 2) * F.sqrt(F.col(u) ** 2 + F.col(v) ** 2)
    c = -(F.col(dx) * F.col(u) + F.col(dy) * F.col(v)) / F.nullif(length, F.lit(0.0))
    known = df.select(c.alias("c")).where("c IS NOT NULL")
    m = known.agg(F.avg((F.col("c") < 0).cast("int")).alias("w"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(percentiles(known, "c", [0.5]))).withColumn("m", F.col("q")[0])
    return verdict(m, "alignment", F.col("m"), F.col("n"), (F.col("m") >= at_least) & (F.col("w") <= most_wrong))


def lag_profile(df: DataFrame, group: str, lag: str, weight: str, most_early: float) -> DataFrame:
    """Mean lag grows with the group and little mass arrives at lag 0 in the last one."""
    g = df.groupBy(group).agg((F.sum(F.col(lag) * F.col(weight)) / F.sum(weight)).alias("c"), (F.sum(F.when(F.col(lag) == 0, F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("e"))
    m = g.agg(F.corr(group, "c").alias("m"), F.max_by("e", group).alias("e"), F.count(F.lit(1)).alias("n"))
    return verdict(m, "lag_profile", F.col("m"), F.col("n"), (F.col("m") > 0) & (F.col("e") <= most_early))


def magnitude(df: DataFrame, group: str, value: str, low: float, high: float, top: float) -> DataFrame:
    """Medians of all groups within a range and the 99th percentile below a bound."""
    g = percentiles(df, value, [0.5, 0.99], [group]).select(F.col("q")[0].alias("m"), F.col("q")[1].alias("p"))
    m = g.agg(F.max("p").alias("p"), F.min("m").alias("a"), F.max("m").alias("b"), F.count(F.lit(1)).alias("n"))
    return verdict(m, "magnitude", F.col("p"), F.col("n"), (F.col("a") >= low) & (F.col("b") <= high) & (F.col("p") <= top))


def size_leakage(df: DataFrame, value: str, target: str, count: str, most: float) -> DataFrame:
    """The value's relation to the target survives once the sample size is partialled out."""
    m = partial_correlation(df, value, target, count).withColumn("n", F.lit(1))
    return verdict(m, "size_leakage", F.abs(F.col("r") - F.col("partial")), F.col("n"), F.abs(F.col("r") - F.col("partial")) <= most)


def monotonicity(df: DataFrame, value: str, flag: str, below: float = -0.5) -> DataFrame:
    """Spearman correlation of decile and event rate is below a bound."""
    ranked = average_rank(df.where(F.col(value).isNotNull() & F.col(flag).isNotNull()), value, out="_r")
    rates = ranked.groupBy(F.least(F.lit(9), F.floor(F.col("_r") * 10)).alias("d")).agg(F.avg(F.col(flag).cast("int")).alias("rate"))
    ranks = average_rank(rates, "rate", out="_q")
    m = ranks.agg(F.corr("d", "_q").alias("m"), F.count(F.lit(1)).alias("n"))
    return verdict(m, "monotonicity", F.col("m"), F.col("n"), F.col("m") < below, F.col("m") < 0)


def coverage(df: DataFrame, region: Column, seen: Column, day: str) -> DataFrame:
    """(region, n, seen_fraction, n_days) for an audit by region."""
    return df.groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("n"), F.avg(seen.cast("int")).alias("seen_fraction"), F.countDistinct(F.when(seen, F.col(day))).alias("n_days"))


def battery(checks: Sequence[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
