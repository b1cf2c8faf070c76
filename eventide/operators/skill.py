"""How well a numeric column ranks rare events: capture curves, Gini skill, AUC and their relatives.

Ties are handled by expectation: all rows of one value form a group in which events accrue linearly, which is the mean
over all random orders of the tied rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .rank import equal_count_bins, percentiles, running_totals, value_groups


def gini_of_groups(groups: DataFrame, keys: Sequence[str], value: str, few: bool = False) -> DataFrame:
    """(keys, n, n_events, gini) from (keys, value, n, e); null without events; ``few`` as in :func:`running_totals`.

    Gini is twice the area between the diagonal and the capture curve of rows sorted by value:
    ``1 - 2 / (N E) * sum n_i (E_before_i + e_i / 2)``.
    """
    r = running_totals(groups, keys, value, ["n", "e"], few=few)
    area = F.sum(F.col("n") * (F.col("before_e") + F.col("e") / 2))
    out = r.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("e").alias("n_events"), area.alias("_a"))
    return out.select(*keys, "n", "n_events", F.when(F.col("n_events") > 0, 1 - 2 * F.col("_a") / (F.col("n") * F.col("n_events"))).alias("gini"))


def gini(df: DataFrame, value: str, flag: str | Column, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(keys, n, n_events, gini): exact, optionally weighted; rows with a null value or flag go."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    w = F.col(weight) if weight else F.lit(1)
    rows = df.where(flag.isNotNull())
    return gini_of_groups(value_groups(rows, keys, value, {"n": F.sum(w), "e": F.sum(F.when(flag, w).otherwise(0))}), keys, value)


def gini_by_threshold(df: DataFrame, values: Sequence[str], target: str, thresholds: dict[float, float]) -> DataFrame:
    """(predictor, pct, n, n_events, gini) for every value column and event threshold, from one scan.

    The columns are stacked, and the events of all thresholds are summed as columns per distinct value before rows multiply.
    """
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(v).alias("predictor"), F.col(v).cast("double").alias("value")) for v in values])).alias("s"), F.col(target).alias("t")).select("s.*", "t")
    sums = {"n": F.count(F.lit(1))} | {f"e{i}": F.count_if(F.col("t") > x) for i, x in enumerate(thresholds.values())}
    groups = value_groups(stacked.where("t IS NOT NULL"), ["predictor"], "value", sums)
    # All thresholds share one ranking; rows per threshold appear only in the final, tiny aggregate.
    names = [f"e{i}" for i in range(len(thresholds))]
    r = running_totals(groups, ["predictor"], "value", ["n", *names])
    areas = r.groupBy("predictor").agg(F.sum("n").alias("n"), *[x for e in names for x in (F.sum(e).alias(e), F.sum(F.col("n") * (F.col(f"before_{e}") + F.col(e) / 2)).alias(f"_{e}"))])
    levels = F.array(*[F.struct(F.lit(float(p)).alias("pct"), F.col(e).alias("n_events"), F.col(f"_{e}").alias("area")) for p, e in zip(thresholds, names, strict=True)])
    out = areas.select("predictor", "n", F.explode(levels).alias("l")).select("predictor", "l.pct", "n", "l.n_events", "l.area")
    return out.select("predictor", "pct", "n", "n_events", F.when(F.col("n_events") > 0, 1 - 2 * F.col("area") / (F.col("n") * F.col("n_events"))).alias("gini"))


def capture_curve(df: DataFrame, value: str, flag: str, tie: str, bins: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, sample_fraction, event_fraction): the curve at the upper edge of each equal-count bin."""
    rows = equal_count_bins(df.where(F.col(value).isNotNull() & F.col(flag).isNotNull()), keys, value, tie, bins)
    per_bin = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("e"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return per_bin.select(*keys, "bin", ((F.col("bin") + 1) / bins).alias("sample_fraction"), (F.sum("e").over(upto) / F.nullif(F.sum("e").over(whole), F.lit(0))).alias("event_fraction"))


def gini_from_curve(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, gini): trapezoid of a curve that starts at the origin."""
    w = Window.partitionBy(*keys).orderBy("bin")
    x0, y0 = (F.coalesce(F.lag(c).over(w), F.lit(0.0)) for c in ("sample_fraction", "event_fraction"))
    steps = curve.select(*keys, ((F.col("sample_fraction") - x0) * ((F.col("sample_fraction") - F.col("event_fraction")) + (x0 - y0))).alias("_a"))
    return steps.groupBy(*keys).agg(F.sum("_a").alias("gini"))


def detection_at(curve: DataFrame, fraction: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pod): share of events above a sample fraction, the curve interpolated linearly."""
    w = Window.partitionBy(*keys).orderBy("bin")
    x0, y0 = (F.coalesce(F.lag(c).over(w), F.lit(0.0)).alias(f"_{c[0]}0") for c in ("sample_fraction", "event_fraction"))
    spans = curve.select("*", x0, y0).where((F.col("_s0") < fraction) & (F.col("sample_fraction") >= fraction))
    y = F.col("_e0") + (F.col("event_fraction") - F.col("_e0")) * (fraction - F.col("_s0")) / (F.col("sample_fraction") - F.col("_s0"))
    return spans.select(*keys, (1 - y).alias("pod"))


def conditional_gini(df: DataFrame, value: str, flag: str, control: str, tie: str, control_bins: int = 5, min_events: int = 20) -> DataFrame:
    """(control_bin, n, n_events, gini): Gini inside equal-count bins of a control with enough events."""
    rows = equal_count_bins(df.where(f"`{control}` IS NOT NULL AND `{value}` IS NOT NULL AND `{flag}` IS NOT NULL"), [], control, tie, control_bins, "control_bin")
    return gini(rows, value, flag, ["control_bin"]).where(F.col("n_events") >= min_events)


def pooled_gini(per_bin: DataFrame) -> DataFrame:
    """(n_bins, n_events, gini): event-weighted mean of per-bin Ginis."""
    return per_bin.where("gini IS NOT NULL").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("n_events").alias("n_events"), (F.sum(F.col("gini") * F.col("n_events")) / F.sum("n_events")).alias("gini"))


def event_rate_curve(df: DataFrame, value: str, flag: str, tie: str, bins: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, n, median, rate, se) over equal-count bins of the value."""
    known = written(df.where(f"`{value}` IS NOT NULL AND `{flag}` IS NOT NULL").select(*keys, value, flag, tie), "values")
    rows = written(equal_count_bins(known, keys, value, tie, bins).select(*keys, "bin", value, flag), "binned")  # read by every pass for the medians
    rates = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).cast("int")).alias("rate"))
    out = rates.join(percentiles(rows, value, [0.5], [*keys, "bin"], "m"), [*keys, "bin"]).select(*keys, "bin", "n", F.col("m")[0].alias("median"), "rate")
    return out.withColumn("se", F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n")))


def auc(df: DataFrame, value: str, flag: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n_pos, n_neg, auc): Mann-Whitney AUC from average ranks; null if a class is empty."""
    groups = value_groups(df.where(F.col(flag).isNotNull()), keys, value, {"n": F.count(F.lit(1)), "e": F.count_if(F.col(flag))})
    r = running_totals(groups, keys, value, ["n"])
    out = r.groupBy(*keys).agg(F.sum("e").alias("n_pos"), (F.sum("n") - F.sum("e")).alias("n_neg"), F.sum(F.col("e") * (F.col("before_n") + (F.col("n") + 1) / 2)).alias("_r"))
    return out.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), (F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def tail_capture(df: DataFrame, value: str, flag: str, percentile: float = 90) -> DataFrame:
    """(threshold, n_events, captured): share of the events at or above a percentile of the value."""
    cut = percentiles(df, value, [percentile / 100]).select(F.col("q")[0].alias("threshold"))
    return df.crossJoin(F.broadcast(cut)).groupBy("threshold").agg(F.count_if(F.col(flag)).alias("n_events"), (F.count_if(F.col(flag) & (F.col(value) >= F.col("threshold"))) / F.nullif(F.count_if(F.col(flag)), F.lit(0))).alias("captured"))


def r_squared(df: DataFrame, truth: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, r2): one minus residual over total sum of squares, of rows where both are known."""
    both = df.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    t, p = F.col(truth), F.col(prediction)
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (1 - F.sum((t - p) * (t - p)) / (F.var_pop(t) * F.count(F.lit(1)))).alias("r2"))
