"""Scans along ordered paths of any length: neighbours and running totals without one task for one path.

Paths of up to a bounded number of rows are windows.  Longer ones are cut into ranges of the order column; windows run inside the
ranges, and what crosses a border (the last row before, the first row after, the totals so far) is carried from one record per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import RANGES, SORTED

#: Pieces in which a long path meets its cuts.
SALTS = 16


def segmented(df: DataFrame, path: Sequence[str], order: Sequence[str], most: int = SORTED, ranges: int | None = None) -> tuple[DataFrame, list[str]]:
    """(rows, group): the rows with a range number ``_seg`` if some path has more than ``most`` rows, and the columns of a group.

    Rows of equal ``order[0]`` share a range; rows without it lie in the first.
    """
    sizes = df.groupBy(*path).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= most:
        return df, list(path)
    ranges = ranges or max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = [i / ranges for i in range(1, ranges)]
    # One pass finds the cuts of all paths, and only those of long ones go on.
    edges = df.groupBy(*path).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(order[0], cuts, 20 * ranges).alias("_edges")).where(F.col("_n") > most)
    edges = edges.select(*[F.col(k).alias(f"_of_{k}") for k in path], "_edges", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_of_salt"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    same = F.col("_salt") == F.col("_of_salt")
    for k in path:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    seg = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(order[0]))), F.lit(0))
    rows = salted.join(edges, same, "left").withColumn("_seg", F.when(F.col("_edges").isNull(), 0).otherwise(seg))
    return rows.select(*df.columns, "_seg"), [*path, "_seg"]


def _carried(rows: DataFrame, path: Sequence[str], ends: DataFrame) -> DataFrame:
    """Rows with their range's record; ranges are as many as groups of the windows, so that nothing is shuffled again."""
    ends = ends.select(*[F.col(k).alias(f"_of_{k}") for k in [*path, "_seg"]], *[c for c in ends.columns if c not in (*path, "_seg")])
    same = F.col("_seg") == F.col("_of__seg")
    for k in path:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(ends, same, "left").drop(*[f"_of_{k}" for k in [*path, "_seg"]])


def neighbours(rows: DataFrame, path: Sequence[str], group: Sequence[str], order: Sequence[str], before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """Adds each column of ``before`` as the row before in the path has it, and of ``after`` as the next row has it; null at the ends."""
    w = Window.partitionBy(*group).orderBy(*order)
    near = {n: F.lag(c).over(w) for n, c in before.items()} | {n: F.lead(c).over(w) for n, c in after.items()}
    if list(group) == list(path):
        return rows.withColumns(near)
    place = F.struct(*order)
    last, first = (F.struct(*[c.alias(n) for n, c in what.items()]) if what else F.lit(None) for what in (before, after))
    ends = rows.groupBy(*group).agg(F.max_by(last, place).alias("_l"), F.min_by(first, place).alias("_f"))
    across = Window.partitionBy(*path).orderBy("_seg")  # one record a range
    ends = ends.select(*group, F.lag("_l").over(across).alias("_left"), F.lead("_f").over(across).alias("_right"))
    marked = rows.withColumns(near | {"_is_first": F.lag(F.lit(1)).over(w).isNull(), "_is_last": F.lead(F.lit(1)).over(w).isNull()})
    out = _carried(marked, path, ends)
    crossed = {n: F.when(F.col("_is_first"), F.col(f"_left.{n}")).otherwise(F.col(n)) for n in before}
    crossed |= {n: F.when(F.col("_is_last"), F.col(f"_right.{n}")).otherwise(F.col(n)) for n in after}
    return out.withColumns(crossed).drop("_left", "_right", "_is_first", "_is_last")


def totals(rows: DataFrame, path: Sequence[str], group: Sequence[str], order: Sequence[str], running: dict[str, Column] | None = None, whole: dict[str, Column] | None = None, least: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """Adds sums up to and with each row (``running``) and sums, least and largest values over its whole path."""
    running, whole, least, most = running or {}, whole or {}, least or {}, most or {}
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if list(group) == list(path):
        all_ = Window.partitionBy(*path)
        return rows.withColumns({n: F.sum(c).over(upto) for n, c in running.items()} | {n: f(c).over(all_) for f, what in ((F.sum, whole), (F.min, least), (F.max, most)) for n, c in what.items()})
    parts = [F.sum(c).alias(f"_r_{n}") for n, c in running.items()] + [f(c).alias(f"_w_{n}") for f, what in ((F.sum, whole), (F.min, least), (F.max, most)) for n, c in what.items()]
    ends = rows.groupBy(*group).agg(*parts)
    earlier, across = Window.partitionBy(*path).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*path)
    ends = ends.select(*group, *[F.sum(f"_r_{n}").over(earlier).alias(f"_o_{n}") for n in running], *[f(f"_w_{n}").over(across).alias(n) for f, what in ((F.sum, whole), (F.min, least), (F.max, most)) for n in what])
    out = _carried(rows.withColumns({n: F.sum(c).over(upto) for n, c in running.items()}), path, ends)
    # A sum is null as long as nothing was known, on either side of the border.
    return out.withColumns({n: F.coalesce(F.col(n) + F.col(f"_o_{n}"), F.col(n), F.col(f"_o_{n}")) for n in running}).drop(*[f"_o_{n}" for n in running])
