"""Joins on time: exact, floored, nearest within a tolerance, bracketing, last before, and fallback chains.

No join here is a cartesian product: a time tolerance becomes an equi-join on time buckets of that width and their
neighbours; bracketing and last-before joins are one union and one window per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised_keys(df: DataFrame, keys: Sequence[str], digits: int = 3) -> DataFrame:
    """Floating-point keys rounded, so that equal coordinates join."""
    kinds = dict(df.dtypes)
    return df.withColumns({k: F.round(k, digits) for k in keys if kinds[k] in ("double", "float")})


def merge_left(left: DataFrame, right: DataFrame, keys: Sequence[str], digits: int = 3) -> DataFrame:
    """Left join on normalised keys; a column on both sides is an error, and so is a repeated right key (when run)."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    one = normalised_keys(right, keys, digits).groupBy(*keys).agg(*[F.first(c).alias(c) for c in right.columns if c not in keys], F.count(F.lit(1)).alias("_n"))
    checked = one.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated key on the right side")).cast("boolean")).otherwise(True))
    return normalised_keys(left, keys, digits).join(checked.where("_ok").drop("_ok", "_n"), list(keys), "left")


def floor_time(ts: str | Column, hours: int) -> Column:
    """Start of the regular interval that holds a time."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    seconds = F.unix_timestamp(ts.cast("timestamp"))
    return (seconds - F.pmod(seconds, F.lit(hours * 3600))).cast("long")


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, tolerance: int, left_id: str, carry: Sequence[str]) -> DataFrame:
    """Each left row with the nearest right row of its key at most ``tolerance`` seconds away (the earlier one of two equally near), or nulls.

    Times are numbers of seconds.  Right rows are copied to their bucket and its two neighbours.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    r = right.select(*keys, F.col(right_time).alias("_rt"), *carry).withColumn("_b", F.explode(F.sequence(cell("_rt") - 1, cell("_rt") + 1)))
    near = left.select(*keys, left_id, F.col(left_time).alias("_lt")).withColumn("_b", cell("_lt")).join(r, [*keys, "_b"])
    near = near.where(F.abs(F.col("_lt") - F.col("_rt")) <= tolerance)
    best = near.groupBy(left_id).agg(F.min_by(F.struct(F.col("_rt").alias(right_time), *carry), F.struct(F.abs(F.col("_lt") - F.col("_rt")), "_rt", *carry)).alias("_m"))
    return left.join(best.select(left_id, "_m.*"), left_id, "left")


def last_before(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, carry: Sequence[str], strictly: bool = True) -> DataFrame:
    """Each left row with the last known right values before it (or at its time).

    One union and one window over (keys, time); skewed keys cost sorting, never a product.
    """
    l_cols = [c for c in left.columns if c not in keys]
    empty = dict(left.dtypes)
    # At equal times a right row counts only if ``strictly`` is false.
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(0 if strictly else 1).alias("_o"), F.struct(*l_cols).alias("_l"), *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in carry], F.lit(None).cast(right.schema[right_time].dataType).alias("_rt"))
    kind = "struct<" + ",".join(f"`{c}`:{empty[c]}" for c in l_cols) + ">"
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(1 if strictly else 0).alias("_o"), F.lit(None).cast(kind).alias("_l"), *carry, F.col(right_time).alias("_rt"))
    w = Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    filled = both.select(*keys, "_l", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in carry], F.last("_rt", ignorenulls=True).over(w).alias(f"{right_time}_before"))
    return filled.where("_l IS NOT NULL").select(*keys, "_l.*", *carry, f"{right_time}_before")


def between(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """The left rows with ``_t`` (their time) and the known right samples around it, ``_a`` (at or before) and ``_b`` (at or after), as structs of _t and _v.

    One union and two windows, one in each direction, so that both frames only grow.
    """
    l_cols = [c for c in left.columns if c not in keys]
    kind = "struct<" + ",".join(f"`{c}`:{t}" for c, t in left.dtypes if c in l_cols) + ">"
    a = left.select(*keys, F.col(left_time).cast("double").alias("_t"), F.struct(*l_cols).alias("_l"), F.lit(None).cast("double").alias("_v"))
    b = right.where(F.col(value).isNotNull()).select(*keys, F.col(right_time).cast("double").alias("_t"), F.lit(None).cast(kind).alias("_l"), F.col(value).cast("double").alias("_v"))
    both = a.unionByName(b).withColumn("_p", F.when(F.col("_v").isNotNull(), F.struct("_t", "_v")))
    near = lambda order: F.last("_p", True).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_a", near(F.asc("_t"))).withColumn("_b", near(F.desc("_t")))
    return both.where("_l IS NOT NULL").select(*keys, "_l.*", "_t", "_a", "_b")


def mixed_between(max_gap: float) -> Column:
    """The linear mix of the samples of :func:`between`; null outside the series and across gaps wider than ``max_gap``."""
    t0, v0, t1, v1 = F.col("_a._t"), F.col("_a._v"), F.col("_b._t"), F.col("_b._v")
    return F.when(t0 == t1, v0).when(t1 - t0 <= max_gap, v0 + (v1 - v0) * (F.col("_t") - t0) / (t1 - t0))


def bracketed(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str, max_gap: float, out: str) -> DataFrame:
    """Linear interpolation of a right series at the left times: exact hits as they are, nothing outside the series or across gaps wider than ``max_gap`` (units of the numeric times)."""
    return between(left, right, keys, left_time, right_time, value).withColumn(out, mixed_between(max_gap)).drop("_t", "_a", "_b")


def interpolated_or_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str, max_gap: int, tolerance: int, out: str) -> DataFrame:
    """A right series at the left times: between two samples at most ``max_gap`` apart, else the nearest one within ``tolerance`` (the earlier one of two equally near).

    Of samples of one time the smallest value counts.
    """
    one = right.where(F.col(value).isNotNull()).groupBy(*keys, right_time).agg(F.min(value).alias(value))
    before, after = F.col("_t") - F.col("_a._t"), F.col("_b._t") - F.col("_t")
    early = before <= F.coalesce(after, F.lit(float("inf")))
    nearest = F.when(early, F.when(before <= tolerance, F.col("_a._v"))).when(after <= tolerance, F.col("_b._v"))
    found = between(left, one, keys, left_time, right_time, value)
    return found.withColumn(out, F.coalesce(mixed_between(max_gap), nearest)).drop("_t", "_a", "_b")


def fallback(df: DataFrame, sources: Sequence[tuple[str, DataFrame, Sequence[str], str]], out: str) -> DataFrame:
    """First known value of several lookups (name, frame, keys, value column), and the ``source`` it came from."""
    picks = []
    for i, (name, frame, keys, value) in enumerate(sources):
        df = df.join(frame.select(*keys, F.col(value).alias(f"_v{i}")), list(keys), "left")
        picks.append((name, F.col(f"_v{i}")))
    source = F.lit(None).cast("string")
    for name, c in reversed(picks):
        source = F.when(c.isNotNull(), name).otherwise(source)
    out_df = df.withColumn(out, F.coalesce(*[c for _, c in picks])).withColumn("source", source)
    return out_df.drop(*[f"_v{i}" for i in range(len(picks))])
