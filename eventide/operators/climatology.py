"""Seasonal climatologies, anomalies and interpolation in month and hour."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import interpolated_or_nearest

YEAR = 365.25


def harmonics(day: str, n: int) -> list[Column]:
    """1, cos and sin of the first n harmonics of the year."""
    t = 2 * np.pi / YEAR * F.dayofyear(day)
    return [F.lit(1.0)] + [f(k * t) for k in range(1, n + 1) for f in (F.cos, F.sin)]


def harmonic_fit(df: DataFrame, cell: Sequence[str], value: str, cell_schema: str, n: int = 2, day: str = "day", per_parameter: int = 3) -> DataFrame:
    """(cell, beta array): least squares per cell from its normal equations; null where values are too few.

    Spark sums the products, a few dozen numbers per cell, so rows never leave the JVM; the small solves run per batch of cells.
    """
    x = harmonics(day, n)
    m = len(x)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    v = F.col(value)
    sums = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs] + [F.sum(x[i] * v).alias(f"q{i}") for i in range(m)]
    eq = df.where(v.isNotNull()).groupBy(*cell).agg(F.count(v).alias("_n"), *sums)

    def solve(batches):
        for pdf in batches:
            a = np.zeros((len(pdf), m, m))
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = pdf[f"p{i}_{j}"]
            b = pdf[[f"q{i}" for i in range(m)]].to_numpy()
            betas = [np.linalg.lstsq(p, q, rcond=None)[0].tolist() if k >= per_parameter * m else None for p, q, k in zip(a, b, pdf["_n"], strict=True)]
            yield pdf[list(cell)].assign(beta=pd.Series(betas, index=pdf.index, dtype=object))

    return eq.mapInPandas(solve, f"{cell_schema}, beta array<double>")


def deseasonalise(df: DataFrame, fit: DataFrame, cell: Sequence[str], value: str, out: str, n: int = 2, day: str = "day") -> DataFrame:
    """Value minus the fitted seasonal cycle; null where there is no fit."""
    x = harmonics(day, n)
    cycle = F.col("beta")[0] * x[0]
    for i in range(1, len(x)):
        cycle = cycle + F.col("beta")[i] * x[i]
    return df.join(fit, list(cell), "left").withColumn(out, F.col(value) - cycle).drop("beta")


def overpass_to_slots(df: DataFrame, group: Sequence[str], value: str, slot: int, out: str) -> DataFrame:
    """The value at one slot, on all slots of its group."""
    from pyspark.sql import Window

    return df.withColumn(out, F.max(F.when(F.col("slot") == slot, F.col(value))).over(Window.partitionBy(*group)))


def bracket_weights(known: Sequence[float], wanted: Sequence[float]) -> list[tuple[int, int, float]]:
    """(wanted index, known index, weight): linear weights of the two known hours around each wanted one; none outside."""
    order = sorted(range(len(known)), key=lambda i: known[i])
    out = []
    for w, h in enumerate(wanted):
        below = [i for i in order if known[i] <= h]
        above = [i for i in order if known[i] >= h]
        if below and above:
            a, b = below[-1], above[0]
            share = 0.0 if known[a] == known[b] else (h - known[a]) / (known[b] - known[a])
            out += [(w, a, 1 - share)] + ([(w, b, share)] if share else [])
    return out


def interpolate_slots(df: DataFrame, keys: Sequence[str], value: str, known: Sequence[float], wanted: Sequence[float]) -> DataFrame:
    """(keys, wanted_slot, value): values at other hours; null if a value with weight is missing.

    The weight table has one row per pair of hours and is broadcast.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(bracket_weights(known, wanted), "wanted_slot int, slot int, w double")
    need = table.groupBy("wanted_slot").agg(F.count(F.lit(1)).alias("_need"))
    w = F.broadcast(table.join(need, "wanted_slot"))
    out = df.join(w, "slot").groupBy(*keys, "wanted_slot").agg(F.sum(F.col(value) * F.col("w")).alias("_v"), F.count(value).alias("_c"), F.first("_need").alias("_need"))
    return out.select(*keys, "wanted_slot", F.when(F.col("_c") == F.col("_need"), F.col("_v")).alias(value))


def monthly_diurnal(df: DataFrame, clim: DataFrame, cell: Sequence[str], month: Column, hour: Column, value: str, out: str, step: int = 3) -> DataFrame:
    """Monthly climatology on regular hours, linear in the hour, the last wrapping to the first."""
    slots = 24 // step
    base = df.withColumn("_m", month.cast("int")).withColumn("_s", F.floor(hour / step).cast("int")).withColumn("_u", (hour - F.floor(hour / step) * step) / step)
    a = clim.select(*cell, F.col("month").alias("_m"), F.col("slot").alias("_s"), F.col(value).alias("_a"))
    b = clim.select(*cell, F.col("month").alias("_m"), F.pmod(F.col("slot") - 1, F.lit(slots)).cast("int").alias("_s"), F.col(value).alias("_b"))
    both = base.join(a, [*cell, "_m", "_s"], "left").join(b, [*cell, "_m", "_s"], "left")
    return both.withColumn(out, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_u")).drop("_m", "_s", "_u", "_a", "_b")


def cell_report(slots: DataFrame, samples: DataFrame, cell: Sequence[str], day: str, time: str, sample_time: str, value: str, slot_numbers: Sequence[int], max_gap: int = 10_800, tolerance: int = 5_400) -> DataFrame:
    """(cell, day, <value>_<slot>...): one row per cell and day with the value at each slot's time (seconds), read from irregular samples.

    Between two samples close enough it is interpolated, at the edges the nearest sample within the tolerance stands in.
    """
    found = interpolated_or_nearest(slots, samples, cell, time, sample_time, value, max_gap, tolerance, "_value")
    return found.groupBy(*cell, day).agg(*[F.max(F.when(F.col("slot") == k, F.col("_value"))).alias(f"{value}_{k}") for k in slot_numbers])
