"""Forecast verification on masks and probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import contingency_scores
from .grid import dilate, spread


def contingency(truth: DataFrame, pred: DataFrame, keys: Sequence[str], dilation: int, weight: Column) -> DataFrame:
    """(keys, dilation, pred_hit, pred_miss, truth_hit, truth_miss): symmetric neighbourhood counts of marked cells.

    A predicted cell hits if truth lies within ``dilation`` cells, and the other way round.
    """
    cell = [*keys, "lat", "lon"]

    def side(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        wide = dilate(b, keys, dilation).withColumn("_hit", F.lit(True))
        marked = a.select(*cell).distinct().join(wide, cell, "left")
        return marked.groupBy(*keys).agg(F.sum(F.when(F.col("_hit"), weight).otherwise(0.0)).alias(f"{name}_hit"), F.sum(F.when(F.col("_hit").isNull(), weight).otherwise(0.0)).alias(f"{name}_miss"))

    both = side(pred, truth, "pred").join(side(truth, pred, "truth"), list(keys), "full")
    return both.select(*keys, F.lit(dilation).alias("dilation"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pred_hit", "pred_miss", "truth_hit", "truth_miss")])


def scores(counts: DataFrame, keys: Sequence[str], ieee: bool = False) -> DataFrame:
    """Pooled counts and their scores; shares of nothing are null, or with ``ieee`` infinite or NaN."""
    cs = ("pred_hit", "pred_miss", "truth_hit", "truth_miss")
    out = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cs])
    return out.withColumns(contingency_scores(*[F.col(c) for c in cs], ieee))


def threshold_sweep(probs: DataFrame, truth: DataFrame, keys: Sequence[str], p: str, dilation: int, thresholds: int = 99) -> DataFrame:
    """(keys, threshold, pred_hit, pred_miss, truth_hit, truth_miss) at thresholds k / (thresholds + 1).

    Truth is dilated once.  A true cell is hit at a threshold exactly if the largest probability in its
    neighbourhood reaches it, so one maximum filter stands in for a dilation per threshold; counts per
    probability level are then summed from the top.
    """
    cell, n = [*keys, "lat", "lon"], thresholds + 1
    level = F.least(F.lit(thresholds), F.floor(F.col(p) * n + 1e-9)).cast("int")
    wide = dilate(truth, keys, dilation).withColumn("_hit", F.lit(True))
    preds = probs.join(wide, cell, "left").select(*keys, level.alias("k"), F.col("_hit").isNotNull().cast("int").alias("ph"), F.col("_hit").isNull().cast("int").alias("pm"), F.lit(0).alias("th"))
    top = spread(probs.select(*cell, p), dilation).groupBy(*cell).agg(F.max(p).alias(p))
    hits = truth.select(*cell).distinct().join(top, cell, "left").select(*keys, F.coalesce(level, F.lit(0)).alias("k"), F.lit(0).alias("ph"), F.lit(0).alias("pm"), F.lit(1).alias("th"))
    by_level = preds.unionByName(hits).groupBy(*keys, "k").agg(*[F.sum(c).alias(c) for c in ("ph", "pm", "th")])
    axis = by_level.select(*keys).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(thresholds))))
    w = Window.partitionBy(*keys).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    full = axis.join(by_level, [*keys, "k"], "left").fillna(0, ["ph", "pm", "th"])
    summed = full.select(*keys, "k", *[F.sum(c).over(w).alias(c) for c in ("ph", "pm", "th")], F.sum("th").over(Window.partitionBy(*keys)).alias("t"))
    return summed.where("k > 0").select(*keys, (F.col("k") / n).alias("threshold"), F.col("ph").alias("pred_hit"), F.col("pm").alias("pred_miss"), F.col("th").alias("truth_hit"), (F.col("t") - F.col("th")).alias("truth_miss"))


def hard_class(probs: str, scale: Sequence[float], classes: Sequence[str]) -> Column:
    """Scaled arg-max of a probability array; the first of equal ones; null for null arrays."""
    scaled = F.zip_with(F.col(probs), F.array(*[F.lit(float(s)) for s in scale]), lambda a, b: a * b)
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(scaled, F.array_max(scaled)).cast("int"))


def reliability(df: DataFrame, p: str, flag: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, n, mean_p, rate)."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("int")
    return df.where(F.col(p).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(flag).cast("int")).alias("rate"))


def accuracy(confusion: DataFrame, truth: str, prediction: str) -> DataFrame:
    return confusion.agg((F.sum(F.when(F.col(truth) == F.col(prediction), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def roc(df: DataFrame, p: str, flag: str, levels: int = 20) -> DataFrame:
    """(threshold, tpr, fpr, precision) at regular thresholds, from one histogram."""
    k = F.least(F.lit(levels), F.floor(F.col(p) * levels + 1e-9)).cast("int")
    hist = df.groupBy(k.alias("k")).agg(F.count_if(F.col(flag)).alias("pos"), F.count_if(~F.col(flag)).alias("neg"))
    w, whole = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    s = hist.select("k", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))
    return s.select((F.col("k") / levels).alias("threshold"), (F.col("tp") / F.nullif(F.col("p"), F.lit(0))).alias("tpr"), (F.col("fp") / F.nullif(F.col("n"), F.lit(0))).alias("fpr"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"))
