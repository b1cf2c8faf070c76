"""Pooled percentile thresholds and event flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import percentiles as quantiles


def percentile_thresholds(df: DataFrame, column: str, percentiles: Sequence[float]) -> list[float]:
    """Exact, linearly interpolated, null-ignoring percentiles (0-100), as few numbers."""
    return list(quantiles(df, column, [p / 100 for p in percentiles]).first()["q"])


def threshold_table(df: DataFrame, column: str, percentiles: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pct, threshold) as rows."""
    found = quantiles(df, column, [p / 100 for p in percentiles], keys, "_t")
    return found.select(*keys, F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in percentiles]).alias("pct"), F.col("_t").alias("threshold"))).alias("_z")).select(*keys, "_z.pct", "_z.threshold")


def conditional_percentile(df: DataFrame, column: str, condition: Column, percentile: float) -> DataFrame:
    """(threshold): a percentile among the rows that meet a condition."""
    return quantiles(df.where(condition), column, [percentile / 100]).select(F.col("q")[0].alias("threshold"))


def exceeds(column: str | Column, threshold: float | Column) -> Column:
    """Strictly above the threshold; a missing value is no event."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column > threshold, F.lit(False))


def event_flags(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds one boolean column per rule; a rule that is null counts as false."""
    return df.withColumns({f"flag_{n}": F.coalesce(c, F.lit(False)) for n, c in rules.items()})
