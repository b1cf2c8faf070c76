"""Sample screens: which rows, slots and cell-days take part.

Two kinds of missing value rule exist side by side.  A screen that *drops* rows beyond a limit keeps rows whose value is
unknown; a screen that *requires* a condition drops them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import poisoned_max


def unless(condition: Column) -> Column:
    """Keep unless the condition is known to hold."""
    return F.coalesce(~condition, F.lit(True))


def all_slots_present(df: DataFrame, group: Sequence[str], n_slots: int) -> DataFrame:
    """Rows of groups that have all their slots."""
    return df.withColumn("_n", F.count("slot").over(Window.partitionBy(*group))).where(F.col("_n") == n_slots).drop("_n")


def step_report(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """(step, n_rows): rows left after each screen in turn, counted in one pass."""
    so_far, counts = F.lit(True), [F.count(F.lit(1)).alias("input")]
    for name, c in steps.items():
        so_far = so_far & F.coalesce(c, F.lit(False))
        counts.append(F.count_if(so_far).alias(name))
    names = ["input", *steps]
    wide = df.agg(*counts)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(n).alias("n_rows")) for i, n in enumerate(names)])).alias("s")).select("s.*")


def apply_screens(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    for c in steps.values():
        df = df.where(c)
    return df


def onset_slot(wet: Column, group: Sequence[str]) -> Column:
    """First wet slot of the row's group (window)."""
    return F.min(F.when(wet, F.col("slot"))).over(Window.partitionBy(*group))


def until_onset(df: DataFrame, wet: Column, group: Sequence[str]) -> DataFrame:
    """Drop slots strictly after the first wet one and whole groups that are wet in slot 0; unknown counts as dry."""
    first = F.coalesce(F.min(F.col("_onset")).over(Window.partitionBy(*group)), F.lit(1 << 30))
    marked = df.withColumn("_onset", F.when(wet, F.col("slot"))).withColumn("_first", first)
    return marked.where((F.col("_first") > 0) & (F.col("slot") <= F.col("_first"))).drop("_onset", "_first")


def onset_table(df: DataFrame, wet: Column, group: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """(group, onset, carried values of the first wet row)."""
    return df.where(wet).groupBy(*group).agg(F.min("slot").alias("onset"), *[F.min_by(c, F.struct("slot", c)).alias(c) for c in carry])


def master_components(df: DataFrame, group: Sequence[str], height: str, target: str, valid: Sequence[str], dry_slots: Sequence[int] = (0, 1)) -> DataFrame:
    """(group, height_max, dry_start, all_valid): the sufficient statistics of a screen, so that its limits can move freely."""
    early = F.max(F.when(F.col("slot").isin(list(dry_slots)), F.col(target)))
    known = [F.bool_and(F.col(v).isNotNull()) for v in valid]
    both = known[0]
    for k in known[1:]:
        both = both & k
    return df.groupBy(*group).agg(poisoned_max(height).alias("height_max"), early.alias("dry_start"), both.alias("all_valid"))


def master_mask(components: DataFrame, height_below: float, dry_below: float) -> DataFrame:
    """Groups that pass; unknown heights and starts fail."""
    return components.where((F.col("height_max") < height_below) & (F.col("dry_start") <= dry_below) & F.col("all_valid"))


def steps_without_gaps(df: DataFrame, step: str, value: str) -> DataFrame:
    """Rows of time steps in which no value is missing."""
    gaps = df.where(F.col(value).isNull()).select(step).distinct()
    return df.join(gaps, step, "left_anti")


def physical_report(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(variable, low, high, n_missing, ok): range check of each variable in one pass."""
    wide = df.agg(*[x for n in bounds for x in (F.min(n).alias(f"lo_{n}"), F.max(n).alias(f"hi_{n}"), F.count_if(F.col(n).isNull()).alias(f"na_{n}"))])
    parts = [F.struct(F.lit(n).alias("variable"), F.col(f"lo_{n}").cast("double").alias("low"), F.col(f"hi_{n}").cast("double").alias("high"), F.col(f"na_{n}").alias("n_missing"), ((F.col(f"lo_{n}") >= a) & (F.col(f"hi_{n}") <= b)).alias("ok")) for n, (a, b) in bounds.items()]
    return wide.select(F.explode(F.array(*parts)).alias("v")).select("v.*")
