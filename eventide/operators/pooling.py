"""Results of several runs put together: folds pooled by name, legs chosen by source, errors weighted by their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How a run's name ends: ``<leg>_fold<n>[_<source>]``.
FOLD = r"_fold([0-9]+)"
ENSEMBLE = r"-ens[0-9]+(_|$)"


def leg_parts(df: DataFrame, name: str) -> DataFrame:
    """Adds ``leg`` (the name without its fold), ``fold`` (null for runs without folds) and ``source`` (what follows the last ``_``; null if there is none)."""
    fold = F.nullif(F.regexp_extract(name, FOLD, 1), F.lit("")).cast("int")
    leg = F.regexp_replace(name, FOLD, "")
    return df.withColumns({"leg": leg, "fold": fold, "source": F.when(leg.rlike("^.+_[^_]*$"), F.regexp_extract(leg, "_([^_]*)$", 1))})


def for_fold(df: DataFrame, fold: int) -> DataFrame:
    """Rows of one fold, and those of runs without folds, which belong to every view."""
    return df.where(F.col("fold").isNull() | (F.col("fold") == fold))


def legs_for_source(df: DataFrame, source: str, benchmark: str) -> DataFrame:
    """The legs of one source and the benchmark, with their ``place``: the benchmark first, then ensembles, then the rest by name."""
    own = df.where((F.col("source") == source) | (F.col("leg") == benchmark))
    kind = F.when(F.col("leg") == benchmark, 0).when(F.col("leg").rlike(ENSEMBLE), 1).otherwise(2)
    legs = own.select("leg").distinct()
    placed = legs.withColumn("place", F.row_number().over(Window.orderBy(kind, "leg")))  # a few legs
    return own.join(placed, "leg")


def pooled_frames(df: DataFrame, keys: Sequence[str], means: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """(leg, keys, labels, means, n_frames): unweighted means over a leg's folds, which score the same steps; labels are carried, not averaged."""
    return df.groupBy("leg", *keys).agg(*[F.min(c).alias(c) for c in labels], *[F.avg(c).alias(c) for c in means], F.count(F.lit(1)).alias("n_frames"))


def weighted_frames(df: DataFrame, keys: Sequence[str], n: str, means: Sequence[str] = (), rms: Sequence[str] = (), deviations: dict[str, str] | None = None) -> DataFrame:
    """(keys, n, ...): partial results combined as if their samples were one.

    ``means`` are weighted by ``n``, ``rms`` by their squares, ``deviations`` (population deviation -> its mean) by the spread within and
    between the parts.  Parts without a value, or of no sample, do not count in it; no part with a value gives null.
    """
    w = lambda c: F.when(F.col(c).isNotNull() & (F.col(n) > 0), F.col(n))
    mean = lambda c: F.sum(w(c) * F.col(c)) / F.sum(w(c))
    out = [mean(c).alias(c) for c in means] + [F.sqrt(F.sum(w(c) * F.col(c) * F.col(c)) / F.sum(w(c))).alias(c) for c in rms]
    for c, m in (deviations or {}).items():
        within, second = F.sum(w(c) * F.col(c) * F.col(c)) / F.sum(w(c)), F.sum(w(c) * F.col(m) * F.col(m)) / F.sum(w(c))
        center = F.sum(w(c) * F.col(m)) / F.sum(w(c))
        out.append(F.sqrt(within + F.greatest(second - center * center, F.lit(0.0))).alias(c))
    return df.groupBy(*keys).agg(F.sum(n).alias(n), *out)


def permutation_costs(df: DataFrame, name: str, baseline: str, none: str, cost: str) -> DataFrame:
    """(source, leg, front, channel, cost): what shuffling a channel costs, pooled over folds.

    ``df`` has ``name`` (``<run>_<source>``), channel, stat, dilation, front and the cost.  Of each run the rows of its means count, or its single repeats where it
    has no means; only those at its coarsest dilation, without the baseline and the empty class.
    """
    run = Window.partitionBy(name)
    rows = df.where(F.col(name).rlike("^.+_[^_]*$") & (F.col("channel") != baseline)).withColumn("_means", F.max((F.col("stat") == "mean").cast("int")).over(run))
    rows = rows.where(F.col("stat") == F.when(F.col("_means") == 1, "mean").otherwise("raw"))
    rows = rows.withColumn("_widest", F.max("dilation").over(run)).where((F.col("dilation") == F.col("_widest")) & (F.col("front") != none))
    own = rows.groupBy(name, "front", "channel").agg(F.avg(cost).alias(cost))
    own = own.withColumns({"source": F.regexp_extract(name, "_([^_]*)$", 1), "leg": F.regexp_replace(F.regexp_extract(name, "^(.+)_[^_]*$", 1), FOLD, "")})
    return own.groupBy("source", "leg", "front", "channel").agg(F.avg(cost).alias(cost))
