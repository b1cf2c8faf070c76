"""Derived columns and features: projections, level mixing, influence features, hulls, guards."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import ratio


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")


def grid_mean(conditional: Column, count: Column, cells: int = 81) -> Column:
    """Grid mean from a conditional mean and the number of cells that carry it."""
    return conditional * count / cells


def category_shares(df: DataFrame, keys: Sequence[str], category: str, count: str, wet: Sequence[str], unclassified: Sequence[str]) -> DataFrame:
    """(keys, classified, frac_<c>, share_<c>): fractions of all classified counts and of the wet ones; null where there are none."""
    n = F.col(count)
    of = lambda names: F.coalesce(F.sum(F.when(F.col(category).isin(*names), n)), F.lit(0))
    sums = df.groupBy(*keys).agg((F.sum(n) - of(unclassified)).alias("classified"), of(wet).alias("_wet"), *[of([c]).alias(f"_{c}") for c in wet])
    return sums.select(*keys, "classified", *[ratio(F.col(f"_{c}"), F.col("classified")).alias(f"frac_{c}") for c in wet], *[ratio(F.col(f"_{c}"), F.col("_wet")).alias(f"share_{c}") for c in wet])


def first_true(flags: dict[str, Column], none: str = "none") -> Column:
    """Name of the first flag that holds, in order of priority."""
    out: Column = F.lit(none)
    for name, c in reversed(list(flags.items())):
        out = F.when(F.coalesce(c, F.lit(False)), name).otherwise(out)
    return out


def complete_samples(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which all listed columns are known."""
    return df.dropna(subset=list(columns))


def mix_levels(df: DataFrame, profile: str, weights: Sequence[Sequence[tuple[int, float]]], out: str) -> DataFrame:
    """Weighted averages over levels of an array column, renormalised over known levels.

    ``weights[i]`` lists (level, weight) of output level i; the matrix is a literal, so nothing is joined or exploded.
    """
    p = F.col(profile)

    def level(pairs: Sequence[tuple[int, float]]) -> Column:
        terms = [(F.get(p, F.lit(j)), w) for j, w in pairs]
        top = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in terms), F.lit(0.0))
        low = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in terms), F.lit(0.0))
        return ratio(top, low)

    return df.withColumn(out, F.array(*[level(w) for w in weights]))


def influence(footprint: DataFrame, receptor: Sequence[str], mass: str, n_parcels: Column, depth: str, density: float = 1.1) -> DataFrame:
    """(receptor, phi, m_star, omega): supplied energy per parcel, the column mass it mixes into, and their ratio."""
    out = footprint.groupBy(*receptor).agg((F.sum(F.col(mass) * 3600) / F.nullif(F.max(n_parcels), F.lit(0))).alias("phi"), (density * F.max(depth)).alias("m_star"))
    return out.withColumn("omega", ratio(F.col("phi"), F.col("m_star")))


def nearest_cell(df: DataFrame, lat: str, lon: str, step: float) -> DataFrame:
    """Adds the indices of the nearest cell of a regular grid."""
    return df.withColumns({"ilat": F.rint(F.col(lat) / step).cast("int"), "ilon": F.rint(F.col(lon) / step).cast("int")})


def on_skeleton(df: DataFrame, axes: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The rows on the full product of the given axis tables, absent ones missing."""
    grid = axes[0]
    for a in axes[1:]:
        grid = grid.crossJoin(a)
    return grid.join(df, list(keys), "left")


def hull_cells(df: DataFrame, keys: Sequence[str], key_schema: str) -> DataFrame:
    """(keys, lat, lon): integer cells inside the convex hull of each key's cells (its grid is bounded)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = sorted({(int(a), int(b)) for a, b in zip(pdf["lat"], pdf["lon"], strict=True)})
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

        def chain(points):
            out = []
            for p in points:
                while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        hull = chain(pts) + chain(pts[::-1]) if len(pts) > 1 else pts
        lo, hi = np.min(pts, axis=0), np.max(pts, axis=0)
        i, j = (x.ravel() for x in np.mgrid[lo[0] : hi[0] + 1, lo[1] : hi[1] + 1])
        inside = np.ones(len(i), bool)
        for a, b in zip(hull, hull[1:] + hull[:1], strict=True):
            inside &= (b[0] - a[0]) * (j - a[1]) - (b[1] - a[1]) * (i - a[0]) >= 0
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame(head | {"lat": i[inside], "lon": j[inside]})[[*keys, "lat", "lon"]]

    return df.select(*keys, "lat", "lon").groupBy(*keys).applyInPandas(one, f"{key_schema}, lat int, lon int")


def pooled_legs(df: DataFrame, name: str, pattern: str, keys: Sequence[str], value: str, digest: str) -> DataFrame:
    """(leg, keys, n, value, same_sample): folds of one leg pooled by name; pooled values only where all digests agree."""
    leg = F.regexp_replace(F.col(name), pattern, "")
    out = df.groupBy(leg.alias("leg"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("_v"), (F.countDistinct(digest) <= 1).alias("same_sample"))
    return out.select("leg", *keys, "n", F.when(F.col("same_sample"), F.col("_v")).alias(value), "same_sample")


def require_same(manifest: DataFrame, now: dict[str, str]) -> None:
    """An error if a written manifest (name, value) disagrees with the current settings."""
    wrong = [r for k, v in now.items() for r in manifest.where((F.col("name") == k) & ~F.col("value").eqNullSafe(F.lit(v))).limit(1).collect()]
    if wrong:
        raise ValueError(f"results were made under other settings: {wrong}")


def seeded_folds(df: DataFrame, day: str, folds: int, seed: int) -> DataFrame:
    """Adds ``fold``: days dealt by a seeded hash, the same whatever the partitioning."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(day).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (h % folds).cast("int"))
