"""Windows over calendar days, slots and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import SORTED, percentiles
from .segments import neighbours, segmented, totals

DAY0 = "1970-01-01"


def day_number(day: str = "day") -> Column:
    return F.datediff(F.col(day), F.lit(DAY0).cast("date"))


def calendar_lags(df: DataFrame, cell: Sequence[str], value: str, lags: Sequence[int], day: str = "day") -> DataFrame:
    """Adds ``<value>_lag<k>``: the value exactly k days earlier, null where that day is absent."""
    w = Window.partitionBy(*cell).orderBy("_d")
    df = df.withColumn("_d", day_number(day))
    return df.withColumns({f"{value}_lag{k}": F.first(value).over(w.rangeBetween(-k, -k)) for k in lags}).drop("_d")


def antecedent_mean(df: DataFrame, cell: Sequence[str], value: str, start: int, end: int, out: str, day: str = "day") -> DataFrame:
    """Mean over the days t - end ... t - start, null unless all of them are known."""
    w = Window.partitionBy(*cell).orderBy("_d").rangeBetween(-end, -start)
    df = df.withColumn("_d", day_number(day))
    return df.withColumn(out, F.when(F.count(value).over(w) == end - start + 1, F.avg(value).over(w))).drop("_d")


def step_difference(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Difference to the previous slot, missing counting as 0, and its maximum over the group as ``<out>_max``."""
    known = F.coalesce(F.col(value), F.lit(0.0))
    df = df.withColumn(out, known - F.coalesce(F.lag(known, 1).over(Window.partitionBy(*group).orderBy("slot")), F.lit(0.0)))
    return df.withColumn(f"{out}_max", F.max(out).over(Window.partitionBy(*group)))


def this_or_next(df: DataFrame, group: Sequence[str], value: str, threshold: float, out: str) -> DataFrame:
    """Whether this or the next slot exceeds a threshold; null only if both are unknown."""
    w = Window.partitionBy(*group).orderBy("slot")
    return df.withColumn(out, F.greatest(F.col(value), F.lead(value).over(w)) > threshold)


def box_smooth(df: DataFrame, keys: Sequence[str], axis: str, value: str, half: int, out: str) -> DataFrame:
    """Centred mean along one axis with as many neighbours as there are."""
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(*keys).orderBy(axis).rangeBetween(-half, half)))


def smooth3(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Weights 1/4, 1/2, 1/4; the ends stay as they are."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn(out, F.when(before.isNull() | after.isNull(), F.col(value)).otherwise(0.25 * before + 0.5 * F.col(value) + 0.25 * after))


def path_length(df: DataFrame, path: Sequence[str], order: str, x: str, y: str, most: int = SORTED) -> DataFrame:
    """Adds ``travelled`` (so far) and ``remaining`` (to the end) along straight pieces; paths of more than ``most`` rows are scanned in ranges."""
    rows, group = segmented(df, path, [order], most)
    rows = neighbours(rows, path, group, [order], {"_px": F.col(x), "_py": F.col(y)}, {})
    dx, dy = F.col(x) - F.col("_px"), F.col(y) - F.col("_py")
    rows = rows.withColumn("_piece", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    rows = totals(rows, path, group, [order], {"travelled": F.col("_piece")}, {"_all": F.col("_piece")})
    return rows.select(*df.columns, "travelled", (F.col("_all") - F.col("travelled")).alias("remaining"))


def residence_hours(df: DataFrame, path: Sequence[str], order: str, hours: str, out: str, most: int = SORTED) -> DataFrame:
    """Trapezoidal residence time of each point: half the distance in time to its neighbours."""
    rows, group = segmented(df, path, [order], most)
    t = F.col(hours)
    rows = neighbours(rows, path, group, [order], {"_before": t}, {"_after": t})
    held = (F.coalesce(t - F.col("_before"), F.lit(0.0)) + F.coalesce(F.col("_after") - t, F.lit(0.0))) / 2
    return rows.select(*df.columns, held.alias(out))


def terciles(rank: Column, labels: Sequence[str] = ("low", "mid", "high")) -> Column:
    """Label of a percentage rank; null stays null."""
    return F.when(rank <= 1 / 3, labels[0]).when(rank <= 2 / 3, labels[1]).when(rank.isNotNull(), labels[2])


def quantile_bins(df: DataFrame, value: str, quantiles: Sequence[float], out: str) -> DataFrame:
    """Number of quantile edges below the value (bins closed on the right)."""
    edges = percentiles(df, value, quantiles, out="_e")
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(F.col(value).isNotNull(), F.size(F.filter("_e", lambda e: e < F.col(value))))).drop("_e")


def zscore(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(x - mean) / population deviation within keys; null where the deviation is 0."""
    w = Window.partitionBy(*keys)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))


def draw_per_group(df: DataFrame, group: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows per group by a seeded hash of a key: the same rows whatever the partitioning."""
    w = Window.partitionBy(*group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
