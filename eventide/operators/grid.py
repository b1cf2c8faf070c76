"""Neighbourhoods, stencils, rasters and objects on grids in long form (one row per step and cell).

Neighbourhood sums copy each cell to the cells it touches and group there; the fan-out is fixed by the window, so
nothing is a product of tables.  Connected objects and convex shapes need a whole grid at once; these run per time step,
whose grid is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(half: int, centre: bool = True) -> Column:
    """The (di, dj) steps of a square window as an array."""
    cells = [(a, b) for a in range(-half, half + 1) for b in range(-half, half + 1) if centre or (a, b) != (0, 0)]
    return F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in cells])


def spread(df: DataFrame, half: int, i: str = "lat", j: str = "lon", centre: bool = True) -> DataFrame:
    """Each row once for every cell of the window around it, as that cell."""
    moved = df.withColumn("_o", F.explode(offsets(half, centre)))
    return moved.withColumns({i: F.col(i) + F.col("_o.di"), j: F.col(j) + F.col("_o.dj")}).drop("_o")


def neighbourhood(df: DataFrame, keys: Sequence[str], value: str, half: int, aggs: dict[str, Column], i: str = "lat", j: str = "lon", centre: bool = True) -> DataFrame:
    """Aggregates over the window around each *existing* cell: (keys, i, j, aggs)."""
    around = spread(df.select(*keys, i, j, value), half, i, j, centre).groupBy(*keys, i, j).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.select(*keys, i, j).join(around, [*keys, i, j], "left")


def neighbourhood_mean(df: DataFrame, keys: Sequence[str], value: str, half: int, fewest: int, out: str, centre: bool = True) -> DataFrame:
    n = neighbourhood(df, keys, value, half, {"_s": F.avg(value), "_n": F.count(value)}, centre=centre)
    return n.select(*keys, "lat", "lon", F.when(F.col("_n") >= fewest, F.col("_s")).alias(out))


def dilate(on: DataFrame, keys: Sequence[str], n: int, i: str = "lat", j: str = "lon") -> DataFrame:
    """Cells within n eight-connected steps of a marked cell: (keys, i, j)."""
    return spread(on.select(*keys, i, j), n, i, j).distinct()


def closing(on: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Dilation followed by erosion: a dilated cell stays if its whole window is dilated."""
    wide = dilate(on, keys, n)
    full = (2 * n + 1) ** 2
    return spread(wide, n).groupBy(*keys, "lat", "lon").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == full).join(wide, [*keys, "lat", "lon"], "left_semi").drop("_n")


def structure_features(df: DataFrame, keys: Sequence[str], value: str, wet: float) -> DataFrame:
    """(keys, lat, lon, value, max3, wet_neighbours, log_value, peak_ratio, is_core)."""
    around = neighbourhood(df, keys, value, 1, {"max3": F.max(value), "_wet": F.count_if(F.col(value) > wet)})
    out = df.select(*keys, "lat", "lon", value).join(around, [*keys, "lat", "lon"])
    own = F.coalesce((F.col(value) > wet).cast("int"), F.lit(0))
    return out.select(*keys, "lat", "lon", value, "max3", (F.col("_wet") - own).alias("wet_neighbours"), F.log1p(F.greatest(F.col(value), F.lit(0.0))).alias("log_value"), (F.col(value) / F.nullif(F.col("max3"), F.lit(0.0))).alias("peak_ratio"), (F.col(value) == F.col("max3")).alias("is_core"))


def complete_grid(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(n_rows, n_cells, complete): whether the rows are the full product of their axes."""
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.countDistinct(a).alias(f"_{a}") for a in axes])
    product = F.lit(1)
    for a in axes:
        product = product * F.col(f"_{a}")
    return wide.select("n_rows", product.alias("n_cells"), (F.col("n_rows") == product).alias("complete"))


def gradient(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, lat, lon, gx, gy, magnitude): central differences; null at edges and gaps."""
    wi, wj = Window.partitionBy(*keys, "lon").orderBy("lat"), Window.partitionBy(*keys, "lat").orderBy("lon")

    def step(w, axis):
        at = lambda k: F.first(value).over(w.rangeBetween(k, k))
        return (at(1) - at(-1)) / 2

    out = df.select(*keys, "lat", "lon", step(wj, "lon").alias("gx"), step(wi, "lat").alias("gy"))
    return out.withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def thermal_front(df: DataFrame, keys: Sequence[str], value: str, screen: float) -> DataFrame:
    """(keys, lat, lon, tfp, front): minus the gradient of the gradient's magnitude along the gradient; a front where it changes sign to a neighbour and the gradient is strong."""
    g = gradient(df, keys, value)
    gg = gradient(g.select(*keys, "lat", "lon", "magnitude"), keys, "magnitude").select(*keys, "lat", "lon", F.col("gx").alias("mx"), F.col("gy").alias("my"))
    t = g.join(gg, [*keys, "lat", "lon"]).withColumn("tfp", -(F.col("mx") * F.col("gx") + F.col("my") * F.col("gy")) / F.nullif(F.col("magnitude"), F.lit(0.0)))
    wi, wj = Window.partitionBy(*keys, "lon").orderBy("lat"), Window.partitionBy(*keys, "lat").orderBy("lon")
    turn = (F.col("tfp") * F.first("tfp").over(wi.rangeBetween(1, 1)) < 0) | (F.col("tfp") * F.first("tfp").over(wj.rangeBetween(1, 1)) < 0)
    return t.select(*keys, "lat", "lon", "tfp", F.coalesce(turn & (F.col("magnitude") >= screen), F.lit(False)).alias("front"))


def rasterise(points: DataFrame, line: Sequence[str], order: str, x: str, y: str, width: float, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(line, ilat, ilon): grid points within half a width of a polyline (round caps), sentinels (null points) cut lines.

    Every segment is compared only with the grid points of its own bounding box.  ``box`` is the grid, if it has ends: first and last
    ilat, first and last ilon; lines run on beyond it, but there is nothing to mark there.
    """
    w = Window.partitionBy(*line).orderBy(order)
    half = width / 2
    s = points.select(*line, F.col(x).alias("_x0"), F.col(y).alias("_y0"), F.lead(x).over(w).alias("_x1"), F.lead(y).over(w).alias("_y1")).where("_x0 IS NOT NULL AND _y0 IS NOT NULL AND _x1 IS NOT NULL AND _y1 IS NOT NULL")
    reach = lambda a, b: (F.ceil(F.least(a, b) - half - 1e-9), F.floor(F.greatest(a, b) + half + 1e-9))
    (i0, i1), (j0, j1) = reach("_y0", "_y1"), reach("_x0", "_x1")
    if box:
        i0, i1, j0, j1 = F.greatest(i0, F.lit(box[0])), F.least(i1, F.lit(box[1])), F.greatest(j0, F.lit(box[2])), F.least(j1, F.lit(box[3]))
    i, j = F.sequence(i0, i1), F.sequence(j0, j1)
    boxed = s.where((i0 <= i1) & (j0 <= j1))
    g = boxed.withColumn("ilat", F.explode(i)).withColumn("ilon", F.explode(j))
    dx, dy = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    length = dx * dx + dy * dy
    along = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("ilon") - F.col("_x0")) * dx + (F.col("ilat") - F.col("_y0")) * dy) / length)))
    d2 = F.pow(F.col("ilon") - (F.col("_x0") + along * dx), 2) + F.pow(F.col("ilat") - (F.col("_y0") + along * dy), 2)
    return g.where(F.sqrt(d2) <= half + 1e-9).select(*line, "ilat", "ilon").distinct()


def class_grid(marked: DataFrame, keys: Sequence[str], kind: str, priority: Sequence[str], out: str = "class") -> DataFrame:
    """(keys, class): the marked class of highest priority per cell."""
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(kind))
    return marked.where(order > 0).groupBy(*keys).agg(F.min_by(kind, order).alias(out))


def regrid(df: DataFrame, keys: Sequence[str], value: str, coarse: float) -> DataFrame:
    """(keys, ilat, ilon, value): bilinear weights of fractional positions onto a regular grid, renormalised over known values.

    Each native point gives its value to the four grid points around it.
    """
    u, v = F.col("lat") / coarse, F.col("lon") / coarse
    i, j = F.floor(u), F.floor(v)
    corners = F.array(*[F.struct((i + a).alias("ilat"), (j + b).alias("ilon"), ((1 - F.abs(u - i - a)) * (1 - F.abs(v - j - b))).alias("w")) for a in (0, 1) for b in (0, 1)])
    p = df.where(F.col(value).isNotNull()).select(*keys, value, F.explode(corners).alias("c")).where("c.w > 0")
    return p.groupBy(*keys, "c.ilat", "c.ilon").agg((F.sum(F.col(value) * F.col("c.w")) / F.sum("c.w")).alias(value))


def shifted(df: DataFrame, keys: Sequence[str], di: Column, dj: Column, box: tuple[int, int, int, int]) -> DataFrame:
    """Cells moved rigidly by rounded offsets; what leaves the box goes."""
    out = df.withColumns({"lat": (F.col("lat") + F.rint(di)).cast("int"), "lon": (F.col("lon") + F.rint(dj)).cast("int")})
    return out.where(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]))


def objects(df: DataFrame, keys: Sequence[str], value: str, wet: float, core: float, steps: int, schema_keys: str) -> DataFrame:
    """(keys, lat, lon, object, seeds, cells, storm): eight-connected wet objects; a cell is storm if it lies within ``steps`` moves of a core inside its object.

    One task call per key, whose grid is bounded.
    """

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[value].fillna(-np.inf).to_numpy()
        i, j = pdf["lat"].to_numpy() - pdf["lat"].min() + 1, pdf["lon"].to_numpy() - pdf["lon"].min() + 1
        shape = (i.max() + 2, j.max() + 2)
        grid, near = np.zeros(shape, np.int64), np.zeros(shape, bool)
        mask = np.zeros(shape, bool)
        mask[i, j] = v > wet
        grid[mask] = np.arange(1, mask.sum() + 1)
        near[i, j] = (v > core) & (v > wet)

        def grown(a: np.ndarray) -> np.ndarray:
            out = a.copy()
            for di in (-1, 0, 1):
                for dj in (-1, 0, 1):
                    out = np.maximum(out, np.roll(a, (di, dj), (0, 1)))
            return np.where(mask, out, 0).astype(a.dtype)

        while True:
            bigger = grown(grid)
            if np.array_equal(bigger, grid):
                break
            grid = bigger
        seeds = near.copy()
        for _ in range(steps):
            near = grown(near)
        own = grid[i, j]
        out = pdf[[*keys, "lat", "lon"]].assign(object=own, storm=near[i, j])
        out["cells"] = out.groupby("object")["object"].transform("size").where(own > 0, 0)
        out["seeds"] = pd.Series(seeds[i, j].astype(int)).groupby(own).transform("sum").where(own > 0, 0).to_numpy()
        return out[[*keys, "lat", "lon", "object", "seeds", "cells", "storm"]]

    return df.select(*keys, "lat", "lon", value).groupBy(*keys).applyInPandas(label, f"{schema_keys}, lat int, lon int, object long, seeds long, cells long, storm boolean")


def distance_to_known(df: DataFrame, keys: Sequence[str], value: str, schema_keys: str) -> DataFrame:
    """(keys, lat, lon, distance): distance in cells from each gap to the nearest known cell of its step; null without any."""

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[value].notna().to_numpy()
        at = pdf[["lat", "lon"]].to_numpy(float)
        gaps = pdf.loc[~known, [*keys, "lat", "lon"]]
        if not known.any() or not len(gaps):
            return gaps.assign(distance=np.nan if not known.any() else 0.0)
        d = np.concatenate([np.sqrt(((a[:, None] - at[known][None]) ** 2).sum(axis=2)).min(axis=1) for a in np.array_split(at[~known], max(1, len(gaps) // 512))])
        return gaps.assign(distance=d)

    out = df.select(*keys, "lat", "lon", value).groupBy(*keys).applyInPandas(near, f"{schema_keys}, lat int, lon int, distance double")
    return out.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))


def envelope(observed: DataFrame, keys: Sequence[str], schema_keys: str, flag: str, rounds: int = 1) -> DataFrame:
    """(keys, lat, lon, inside): the area that scattered observations cover on a full grid per key.

    Closing by ``rounds`` of the 3 x 3 element, then holes that do not reach the border are filled.  Beyond the border nothing is
    observed.  One task call per key, whose grid is bounded.
    """

    def grown(a: np.ndarray) -> np.ndarray:
        p = np.pad(a, 1)
        return np.any([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)], axis=0)

    def worn(a: np.ndarray) -> np.ndarray:
        p = np.pad(a, 1)
        return np.all([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)], axis=0)

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["lat"].to_numpy() - pdf["lat"].min(), pdf["lon"].to_numpy() - pdf["lon"].min()
        closed = np.zeros((i.max() + 1, j.max() + 1), bool)
        closed[i, j] = pdf[flag].fillna(False).to_numpy(bool)
        for step in (grown, worn):
            for _ in range(rounds):
                closed = step(closed)
        outside = np.pad(~closed, 1, constant_values=True)
        reached = np.zeros_like(outside)
        reached[0, 0] = True
        while True:
            more = reached.copy()
            more[1:] |= reached[:-1]
            more[:-1] |= reached[1:]
            more[:, 1:] |= reached[:, :-1]
            more[:, :-1] |= reached[:, 1:]
            more &= outside
            if np.array_equal(more, reached):
                break
            reached = more
        return pdf[[*keys, "lat", "lon"]].assign(inside=~reached[1:-1, 1:-1][i, j])

    return observed.select(*keys, "lat", "lon", flag).groupBy(*keys).applyInPandas(cover, f"{schema_keys}, lat int, lon int, inside boolean")


def gap_class(observed: Column, inside: Column, domain: Column | None = None) -> Column:
    """observed, cloud (a gap inside the covered area), out_of_swath, or out_of_domain."""
    kind = F.when(observed, "observed").when(inside, "cloud").otherwise("out_of_swath")
    return kind if domain is None else F.when(F.coalesce(domain, F.lit(False)), kind).otherwise("out_of_domain")


def bicubic(df: DataFrame, keys: Sequence[str], value: str, spacing: float, least: float = 0.5) -> DataFrame:
    """(keys, ilat, ilon, value): a field on whole degrees at points ``spacing`` apart, by 4 x 4 cubic convolution.

    Known cells share their weights anew; null where they carry no more than ``least`` of the weight.
    """

    def targets(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - 2) / spacing) + 1, F.ceil((F.col(c) + 2) / spacing) - 1)

    def tap(distance: Column) -> Column:  # the cubic through its neighbours' mean slopes
        d = F.abs(distance)
        return F.when(d < 1, (1.5 * d - 2.5) * d * d + 1).when(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2).otherwise(0.0)

    taps = df.where(F.col(value).isNotNull()).withColumn("ilat", F.explode(targets("lat"))).withColumn("ilon", F.explode(targets("lon")))
    w = tap(F.col("lat") - F.col("ilat") * spacing) * tap(F.col("lon") - F.col("ilon") * spacing)
    sums = taps.withColumn("_w", w).groupBy(*keys, "ilat", "ilon").agg(F.sum(F.col(value) * F.col("_w")).alias("_s"), F.sum("_w").alias("_w"))
    return sums.select(*keys, "ilat", "ilon", F.when(F.col("_w") > least, F.col("_s") / F.col("_w")).alias(value))


def lowest_level(df: DataFrame, keys: Sequence[str], level: str, temperature: str, altitude: str, ground: str, carry: Sequence[str] = (), lapse: float = 0.0065, most_above: float = 1500.0) -> DataFrame:
    """(keys, temperature at the ground, carry, above): from each column's deepest level on which all is known.

    Temperature goes down to the ground at a constant lapse rate, never up; the rest is taken as it is.  Columns whose
    deepest level lies more than ``most_above`` over the ground are missing.
    """
    known = df.dropna(subset=[temperature, altitude, ground, *carry])
    best = known.groupBy(*keys).agg(F.max_by(F.struct(temperature, altitude, ground, *carry), level).alias("b"))
    above = F.col(f"b.{altitude}") - F.col(f"b.{ground}")
    down = F.col(f"b.{temperature}") + lapse * F.greatest(above, F.lit(0.0))
    return best.where(above <= most_above).select(*keys, down.alias(temperature), *[F.col(f"b.{c}").alias(c) for c in carry], above.alias("above"))


def expected_swath(steps: DataFrame, bank: DataFrame, keys: Sequence[str], day: str, hour: str, cycle: Column, fewest_days: int, least: float) -> DataFrame:
    """(day, hour, lat, lon, expected): the area that the overpass of a day usually covers, from a bank of the repeat cycle.

    ``bank`` has cycle_day, hour, lat, lon, n_days and frequency.  ``steps`` are the (keys) asked for, ``day`` and ``hour`` among them.  Steps whose
    cycle day and hour the bank lacks, or knows from fewer than ``fewest_days`` overpasses, have no rows.
    """
    known = bank.where(F.col("n_days") >= fewest_days).select("cycle_day", F.col("hour").alias("_hour"), "lat", "lon", (F.col("frequency") >= least).alias("expected"))
    asked = steps.select(*keys).distinct().withColumn("_cycle", cycle)
    return asked.join(known, (F.col("_cycle") == F.col("cycle_day")) & (F.col(hour) == F.col("_hour"))).select(*keys, "lat", "lon", "expected")


def gap_types(observed: DataFrame, bank: DataFrame | None, keys: Sequence[str], schema_keys: str, flag: str, day: str, hour: str, cycle: Column, fewest_days: int = 5, least: float = 0.5, domain: Column | None = None, rounds: int = 1) -> DataFrame:
    """(keys, lat, lon, inside, source, gap): the class of every cell, by the expected swath or else by the day's own envelope.

    A fully overcast stretch leaves nothing to close, but the bank still knows that the satellite was there.  A step that the
    bank knows uses it for all its cells (a cell that the bank lacks is outside); all other steps use the morphological envelope, and only these are grouped.
    """
    if bank is None:
        own = observed.join(envelope(observed, keys, schema_keys, flag, rounds), [*keys, "lat", "lon"]).withColumn("source", F.lit("envelope"))
    else:
        expected = expected_swath(observed, bank, keys, day, hour, cycle, fewest_days, least)
        steps = expected.select(*keys).distinct()
        by_bank = observed.join(steps, list(keys), "left_semi").join(expected, [*keys, "lat", "lon"], "left").withColumn("inside", F.coalesce("expected", F.lit(False))).drop("expected").withColumn("source", F.lit("bank"))
        rest = observed.join(steps, list(keys), "left_anti")
        by_day = rest.join(envelope(rest, keys, schema_keys, flag, rounds), [*keys, "lat", "lon"]).withColumn("source", F.lit("envelope"))
        own = by_bank.unionByName(by_day)
    return own.withColumn("gap", gap_class(F.coalesce(F.col(flag), F.lit(False)), F.col("inside"), domain)).select(*keys, "lat", "lon", "inside", "source", "gap")
