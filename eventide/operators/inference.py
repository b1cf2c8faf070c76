"""Uncertainty of skill: bin-by-day sufficient statistics, bootstraps, trends, false discovery control.

Rows are reduced in Spark to counts per (test, rank bin, day); only these bounded matrices reach NumPy, one test per call,
so many tests run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .rank import equal_count_bins, places, running_totals, value_groups

RESULT = "n long, n_events long, gini double, ci_lo double, ci_hi double, p double, se_naive double, se_block double, inflation double, n_days int"


def two_sided(boot: np.ndarray, point: float) -> float:
    """p of a point under resampled values moved to their mean; at least one over their number plus one."""
    around = boot - boot.mean()
    return min(1.0, max(2 * min((around >= point).mean(), (around <= point).mean()), 1 / (len(boot) + 1)))


def bin_day_matrix(df: DataFrame, keys: Sequence[str], value: str, flag: str, day: str, tie: str, bins: int = 512) -> DataFrame:
    """(keys, bin, day, n, e): counts and events by equal-count rank bin and day."""
    rows = df.where(F.col(value).isNotNull() & F.col(flag).isNotNull())
    return equal_count_bins(rows, keys, value, tie, bins).groupBy(*keys, "bin", day).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("e"))


def binned_gini(n: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Gini of (bins, replicates) counts; NaN without rows or events."""
    total, events = n.sum(axis=0), e.sum(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        below = np.cumsum(e, axis=0) - e / 2
        return np.where((total > 0) & (events > 0), 1 - 2 * (n * below).sum(axis=0) / (total * events), np.nan)


def day_weights(n_days: int, block: int, reps: int, rng: np.random.Generator) -> np.ndarray:
    """(days, replicates) multiplicities of circular moving blocks of days, cut to the number of days."""
    starts = rng.integers(0, n_days, size=(-(-n_days // block), reps))
    picked = ((starts[:, None, :] + np.arange(block)[None, :, None]) % n_days).reshape(-1, reps)[:n_days]
    out = np.zeros((n_days, reps))
    np.add.at(out, (picked, np.arange(reps)[None, :]), 1.0)
    return out


def row_replicates(n: np.ndarray, e: np.ndarray, reps: int, rng: np.random.Generator, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row bootstrap from the bins alone: rows fall into bins multinomially, events inside a bin binomially."""
    drawn = rng.multinomial(int(size or n.sum()), n / n.sum(), size=reps).T
    rate = np.divide(e, n, out=np.zeros(len(n)), where=n > 0)
    return drawn.astype(float), rng.binomial(drawn, rate[:, None]).astype(float)


def bootstrap(matrix: DataFrame, keys: Sequence[str], key_schema: str, day: str = "day", reps: int = 500, block: int = 7, confidence: float = 0.95, seed: int = 0, method: str = "block") -> DataFrame:
    """Gini, interval, both standard errors, two-sided p and their ratio per test, from :func:`bin_day_matrix`."""
    if method not in ("block", "iid"):
        raise ValueError(f"unknown method {method!r}")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf.pivot_table(index="bin", columns=day, values="n", fill_value=0, aggfunc="sum").sort_index()
        e = pdf.pivot_table(index="bin", columns=day, values="e", fill_value=0, aggfunc="sum").sort_index().to_numpy(float)
        days, n = n.shape[1], n.to_numpy(float)
        point = binned_gini(n.sum(axis=1, keepdims=True), e.sum(axis=1, keepdims=True))[0]
        rng = np.random.default_rng(seed)
        w = day_weights(days, min(block, days), reps, rng)
        blocks = binned_gini(n @ w, e @ w)
        iid = binned_gini(*row_replicates(n.sum(axis=1), e.sum(axis=1), reps, rng))
        boot = (blocks if method == "block" else iid)[~np.isnan(blocks if method == "block" else iid)]
        row = {k: pdf[k].iloc[0] for k in keys} | {"n": int(n.sum()), "n_events": int(e.sum()), "n_days": days}
        if np.isnan(point) or len(boot) < 2:
            row |= dict.fromkeys(("gini", "ci_lo", "ci_hi", "p", "se_naive", "se_block", "inflation"))
        else:
            lo, hi = np.quantile(boot, [(1 - confidence) / 2, (1 + confidence) / 2])
            p = two_sided(boot, point)
            a, b = np.nanstd(iid, ddof=1), np.nanstd(blocks, ddof=1)
            row |= {"gini": point, "ci_lo": lo, "ci_hi": hi, "p": p, "se_naive": a, "se_block": b, "inflation": b / a if a > 0 else None}
        return pd.DataFrame([row])

    return matrix.groupBy(*keys).applyInPandas(one, f"{key_schema}, {RESULT}")


def resampled_error(matrix: DataFrame, parts: int, reps: int = 500, seed: int = 0) -> DataFrame:
    """(sigma): standard error of the Gini of a sample ``1 / parts`` the size, by resampling the bins of all rows.

    ``matrix`` comes from :func:`bin_day_matrix` without keys; Spark sums it over days, so one task sees a row a bin.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n, e = pdf.sort_values("bin")["n"].to_numpy(float), pdf.sort_values("bin")["e"].to_numpy(float)
        drawn = binned_gini(*row_replicates(n, e, reps, np.random.default_rng(seed), int(n.sum() // parts)))
        return pd.DataFrame({"sigma": [np.nanstd(drawn, ddof=1)]})

    per_bin = matrix.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    return per_bin.groupBy(F.isnull("bin")).applyInPandas(one, "sigma double")  # one group: bins are never null


def stratum_significance(df: DataFrame, value: str, flag: str, stratum: str, day: str, tie: str, parts: int, bins: int = 64) -> DataFrame:
    """(stratum, n, n_events, gini, needed): Gini per stratum and the difference that two strata need to differ, 2 sqrt(2) sigma."""
    from .skill import gini

    sigma = resampled_error(bin_day_matrix(df, [], value, flag, day, tie, bins), parts)
    needed = (2 * 2**0.5 * F.col("sigma")).alias("needed")
    return gini(df, value, flag, [stratum]).crossJoin(F.broadcast(sigma)).select(stratum, "n", "n_events", "gini", needed)


def fdr(df: DataFrame, p: str = "p", alpha: float = 0.05, out: str = "fdr_significant") -> DataFrame:
    """Benjamini-Hochberg over the rows of a results table; a null p is never significant."""
    ranks = running_totals(value_groups(df.where(~F.isnan(F.col(p))), [], p, {"n": F.count(F.lit(1))}), [], p, ["n"])
    passed = F.col(p) <= alpha * (F.col("before_n") + F.col("n")) / F.col("all_n")
    cut = ranks.agg(F.max(F.when(passed, F.col(p))).alias("_cut"))  # one number
    return df.crossJoin(F.broadcast(cut)).withColumn(out, F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def trend(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, slope, se, significant): least squares and whether the slope exceeds two standard errors."""
    n = F.regr_count(y, x)
    out = df.groupBy(*keys).agg(n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("_xx"), F.regr_syy(y, x).alias("_yy"), F.regr_sxy(y, x).alias("_xy"))
    rest = F.greatest(F.lit(0.0), F.col("_yy") - F.col("slope") * F.col("_xy"))
    out = out.withColumn("se", F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2) / F.col("_xx"))))
    return out.select(*keys, "n", "slope", "se", (F.abs("slope") > 2 * F.col("se")).alias("significant"))


def partial_correlation(df: DataFrame, x: str, y: str, control: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, r, partial): correlation of x and y, and with the linear part of a control removed."""
    c = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(control).isNotNull()).groupBy(*keys).agg(F.corr(x, y).alias("r"), F.corr(x, control).alias("_a"), F.corr(y, control).alias("_b"))
    scale = F.sqrt((1 - F.col("_a") * F.col("_a")) * (1 - F.col("_b") * F.col("_b")))
    return c.select(*keys, "r", ((F.col("r") - F.col("_a") * F.col("_b")) / F.nullif(scale, F.lit(0.0))).alias("partial"))


def origin_slope(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(x) * F.col(y)) / F.nullif(F.sum(F.when(F.col(y).isNotNull(), F.col(x) * F.col(x))), F.lit(0.0))).alias("slope"))


def counts_bootstrap(counts: DataFrame, keys: Sequence[str], day: str, columns: Sequence[str], score: Column, reps: int = 200, block: int = 3, seed: int = 0) -> DataFrame:
    """(keys, ci_lo, ci_hi): percentile interval of a score of pooled daily counts under circular blocks of days.

    The multiplicities are a table of (replicate, day); the number of days and replicates bounds it, not the rows.
    """
    spark = counts.sparkSession
    days = [r[0] for r in counts.select(day).distinct().orderBy(day).collect()]
    w = day_weights(len(days), min(block, len(days)), reps, np.random.default_rng(seed))
    picked = spark.createDataFrame([(int(r), d, float(w[i, r])) for i, d in enumerate(days) for r in range(reps) if w[i, r]], f"rep int, {day} {counts.schema[day].dataType.simpleString()}, w double")
    pooled = counts.join(picked, day).groupBy("rep", *keys).agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in columns])
    return pooled.withColumn("_s", score).groupBy(*keys).agg(F.percentile("_s", 0.025).alias("ci_lo"), F.percentile("_s", 0.975).alias("ci_hi"))


def with_others(df: DataFrame, columns: Sequence[str], key: str, seed: int, salts: Sequence[str] = ()) -> DataFrame:
    """Adds ``_<column>``: the columns of the row that one permutation of all rows (or inside groups) puts in each row's place.

    Places by a seeded hash are matched to places by key, both with the groups first, so that groups of equal size meet.
    All columns share the permutation.  Null keys go last in both.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    groups = [F.col(s).asc_nulls_first() for s in salts]
    own = places(df, [*groups, F.col(key).asc_nulls_last()], "_place")
    hashed = df.select(*salts, key, *[F.col(c).alias(f"_{c}") for c in columns], h.alias("_h"))
    others = places(hashed, [*groups, F.col("_h").asc_nulls_last(), F.col(key).asc_nulls_last()], "_place")
    return own.join(others.select("_place", *[f"_{c}" for c in columns]), "_place").drop("_place")


def permuted(df: DataFrame, column: str, key: str, seed: int, salts: Sequence[str] = ()) -> DataFrame:
    """One column permuted over all rows (or inside groups), see :func:`with_others`."""
    return with_others(df, [column], key, seed, salts).withColumn(column, F.col(f"_{column}")).drop(f"_{column}")


def permutation_importance(df: DataFrame, columns: Sequence[str], score: Callable[[dict[str, Column]], Column], flag: str, key: str, seed: int) -> DataFrame:
    """(permuted, n, n_events, gini): Gini of a score of the columns as they are ("none"), and with each of them permuted over the rows.

    Rows are permuted once for all columns, and all scores are summed per distinct value in one pass; each name has a row, without scores too.
    """
    from .skill import gini_of_groups

    names = ["none", *columns]
    scores = [F.struct(F.lit(n).alias("permuted"), score({c: F.col(f"_{c}" if c == n else c) for c in columns}).alias("score")) for n in names]
    rows = with_others(df.select(key, flag, *columns), columns, key, seed).where(F.col(flag).isNotNull())
    stacked = rows.select(flag, F.explode(F.array(*scores)).alias("_s")).select(flag, "_s.*")
    groups = value_groups(stacked, ["permuted"], "score", {"n": F.count(F.lit(1)), "e": F.count_if(F.col(flag))})
    found = gini_of_groups(written(groups, "scores"), ["permuted"], "score", few=True)
    every = df.sparkSession.createDataFrame([(n,) for n in names], "permuted string")
    return every.join(F.broadcast(found), "permuted", "left")
