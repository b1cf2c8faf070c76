"""Filling gaps in fields, and hold-out validation of the fills.  One field (a bounded grid) per task call."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many known points one dense system is solved; more are solved by conjugate gradients from blocks of distances.
DENSE_POINTS = 3000
BLOCK = 1000


def kriged(lat: np.ndarray, lon: np.ndarray, v: np.ndarray, nugget: float = 1e-6) -> np.ndarray:
    """Ordinary kriging with a linear variogram from all known points; the mean from fewer than ten, nothing from none."""
    known = np.flatnonzero(~np.isnan(v))
    gaps = np.flatnonzero(np.isnan(v))
    out = v.copy()
    if not len(known) or not len(gaps):
        return out
    if len(known) < 10:
        out[gaps] = v[known].mean()
        return out
    xy = np.column_stack([lat, lon]).astype(float)
    away = lambda rows: np.sqrt(((xy[rows][:, None] - xy[known][None]) ** 2).sum(axis=2)) + nugget
    # Dual form: c and m with A c + m = v and sum(c) = 0 serve all gaps at once.
    c, m = (dense_weights if len(known) <= DENSE_POINTS else gradient_weights)(away, known, v[known], nugget)
    for part in np.array_split(gaps, -(-len(gaps) // BLOCK)):
        out[part] = away(part) @ c + m
    return out


def dense_weights(away, known: np.ndarray, v: np.ndarray, nugget: float) -> tuple[np.ndarray, float]:
    n = len(known)
    a = np.ones((n + 1, n + 1))
    a[:n, :n] = away(known) - nugget * np.eye(n)
    a[n, n] = 0
    x = np.linalg.lstsq(a, np.append(v, 0.0), rcond=None)[0]
    return x[:n], x[n]


def gradient_weights(away, known: np.ndarray, v: np.ndarray, nugget: float, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """The same weights without the matrix: minus the distances are positive definite among weights that sum to nothing."""
    parts = np.array_split(np.arange(len(known)), -(-len(known) // BLOCK))

    def product(x: np.ndarray) -> np.ndarray:
        return np.concatenate([away(known[p]) @ x for p in parts]) - nugget * x

    centred = lambda x: x - x.mean()
    c, rest = np.zeros(len(v)), -centred(v)
    step, size = rest.copy(), rest @ rest
    least = tolerance**2 * max(size, 1e-300)
    for _ in range(10 * len(v)):
        if size <= least:
            break
        image = -centred(product(step))
        length = size / (step @ image)
        c, rest = c + length * step, rest - length * image
        size, before = rest @ rest, size
        step = rest + size / before * step
    else:
        if size > least:
            raise ArithmeticError(f"kriging weights of {len(v)} points have not converged: residual {math.sqrt(size):.3g}, wanted {math.sqrt(least):.3g}")
    return c, float((v - product(c)).mean())


def nearest(lat: np.ndarray, lon: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each gap takes the nearest known value; the earliest in (lat, lon) order of equally near ones."""
    known, gaps = np.flatnonzero(~np.isnan(v)), np.flatnonzero(np.isnan(v))
    out = v.copy()
    if len(known):
        order = known[np.lexsort((lon[known], lat[known]))]
        for part in np.array_split(gaps, max(1, len(gaps) // 1000)):
            d = (lat[part, None] - lat[order]) ** 2 + (lon[part, None] - lon[order]) ** 2
            out[part] = v[order][d.argmin(axis=1)]
    return out


def fill(df: DataFrame, keys: Sequence[str], key_schema: str, value: str, method: str) -> DataFrame:
    """(keys, lat, lon, value, filled, gap_type): ``krige`` or ``nearest`` per field; gap_type 0 known, 1 filled, -1 left."""
    if method not in ("krige", "nearest"):
        raise ValueError(f"unknown method {method!r}")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lat", "lon"], ignore_index=True)
        v = pdf[value].to_numpy(float)
        lat, lon = pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float)
        filled = kriged(lat, lon, v) if method == "krige" else nearest(lat, lon, v)
        kind = np.where(~np.isnan(v), 0, np.where(np.isnan(filled), -1, 1)).astype(np.int8)
        return pdf[[*keys, "lat", "lon", value]].assign(filled=filled, gap_type=kind)

    out = df.select(*keys, "lat", "lon", value).groupBy(*keys).applyInPandas(one, f"{key_schema}, lat int, lon int, {value} double, filled double, gap_type byte")
    return out.withColumn("filled", F.when(~F.isnan("filled"), F.col("filled"))).withColumn(value, F.when(~F.isnan(value), F.col(value)))


def fill_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.withColumn("filled", F.coalesce(F.col(value), F.avg(value).over(Window.partitionBy(*keys))))


def hidden(df: DataFrame, value: str, hide: Column) -> DataFrame:
    """The truth kept aside and hidden where a condition holds."""
    return df.withColumn("truth", F.col(value)).withColumn(value, F.when(~hide, F.col(value)))


def reconstruction_metrics(df: DataFrame, strata: dict[str, Column]) -> DataFrame:
    """(kind, stratum, n, bias, rmse, corr) of filled against truth over overlapping strata, from one scan."""
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("stratum")) for k, c in strata.items()])
    rows = df.where("truth IS NOT NULL AND filled IS NOT NULL").select("truth", "filled", F.explode(parts).alias("s")).where("s.stratum IS NOT NULL")
    d = F.col("filled") - F.col("truth")
    return rows.groupBy("s.kind", "s.stratum").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.corr("filled", "truth").alias("corr"))


def two_source(primary: DataFrame, backup: DataFrame, keys: Sequence[str], value: str, fewest: float) -> DataFrame:
    """(keys, value, source): the primary source where its valid share suffices, else the backup, else null."""
    a = primary.select(*keys, F.col(value).alias("_a"), "valid_frac")
    b = backup.select(*keys, F.col(value).alias("_b"))
    good = F.coalesce(F.col("valid_frac") >= fewest, F.lit(False)) & F.col("_a").isNotNull()
    return a.join(b, list(keys), "full").select(*keys, F.when(good, F.col("_a")).otherwise(F.col("_b")).alias(value), F.when(good, "primary").when(F.col("_b").isNotNull(), "backup").alias("source"))
