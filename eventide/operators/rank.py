"""Running totals and ranks over a whole table without a single-task window.

A global ``row_number()`` sorts all rows in one task.  Here rows are first grouped by value (ties become one row), the
value axis is cut into ranges by approximate quantiles, running sums are taken inside each range, and the totals of the
earlier ranges (a few hundred numbers per key) are added.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Ranges per key are as many as shuffle partitions, and at least so many.
RANGES = 64
#: One over the error of the approximate quantiles that bracket exact ones.
ACCURACY = 20_000
#: Even cuts of a part in later passes of a selection.
EVEN = 256
#: Every so many edges one is compared first.
STEP = 16
#: Equal values up to this number are put in order by one task each, more by running totals; and so many values of one key.
SORTED = 200_000


def value_groups(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """(keys, value, sums): one row per distinct value; rows with a null value go."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[c.alias(n) for n, c in sums.items()])


def count_below(df: DataFrame, edges: DataFrame, keys: Sequence[str], value: str, column: str, step: int, out: str, few: bool = False) -> DataFrame:
    """Joins ``edges`` (keys, a sorted array of bounded length) and adds the number of its numbers below the value.

    They are counted first among every step-th number, then among the step numbers that follow.  ``few`` tells that all keys fit
    into a broadcast, so that rows stay where they lie.
    """
    edges = edges.withColumn("_coarse", F.filter(column, lambda _, i: i % step == step - 1))
    df = df.join(F.broadcast(edges) if few else edges, list(keys)) if keys else df.crossJoin(F.broadcast(edges))
    below = lambda edges: F.size(F.filter(edges, lambda e: e < F.col(value)))
    df = df.withColumn("_first", below("_coarse") * step)
    return df.withColumn(out, F.col("_first") + below(F.slice(column, F.col("_first") + 1, step))).drop("_coarse", "_first")


def running_totals(groups: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], ranges: int | None = None, few: bool = False) -> DataFrame:
    """Adds ``before_<s>`` (sum over smaller values) and ``all_<s>`` (sum over all) for each column in ``sums``; ``few`` as in :func:`count_below`."""
    ranges = ranges or max(RANGES, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts, step = [i / ranges for i in range(1, ranges)], math.isqrt(ranges)
    # The condition always holds; naming all sums keeps this branch's shuffle the same as the other's, so it runs once.
    named = F.when(sum((F.col(s).cast("double") for s in sums), F.lit(0.0)) > -1e308, F.col(value))
    edges = groups.groupBy(*keys).agg(F.percentile_approx(named, cuts, 20 * ranges).alias("_edges"))
    # Written: edges computed anew may differ, and the totals must be those of the rows that a range holds.
    cut = written(count_below(groups, edges, keys, value, "_edges", step, "_range", few).drop("_edges"), "ranges")
    totals = cut.groupBy(*keys, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    order = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{s}").over(order), F.lit(0)).alias(f"_o_{s}") for s in sums], *[F.sum(f"_t_{s}").over(whole).alias(f"all_{s}") for s in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.repartition(*keys, "_range").join(offsets, [*keys, "_range"])  # as the windows need them, whatever the join
    for s in sums:
        out = out.withColumn(f"before_{s}", F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"_o_{s}"))
    return out.drop("_range", *[f"_o_{s}" for s in sums])


def places(df: DataFrame, order: Sequence[Column], out: str = "place") -> DataFrame:
    """Adds the 0-based place of each row in ``order``, rows that are equal in it one after another; every row is kept.

    Rows are sorted in ranges and written with their place inside their range; the sizes of the earlier ranges (one row each) are added.
    """
    ranged = written(df.sort(*order).withColumn("_id", F.monotonically_increasing_id()), "places")
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)  # number of the range, row inside it
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", earlier.alias("_before")))
    return ranged.withColumn("_part", part).join(offsets, "_part").withColumn(out, F.col("_before") + inside).drop("_id", "_part", "_before")


def average_rank(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "pct_rank") -> DataFrame:
    """Adds the average rank of ``value`` over the count of values (ties share their mean rank); null stays null."""
    ranked = running_totals(value_groups(df, keys, value, {"n": F.count(F.lit(1))}), keys, value, ["n"])
    ranked = ranked.select(*keys, value, ((F.col("before_n") + (F.col("n") + 1) / 2) / F.col("all_n")).alias(out))
    return df.join(ranked, [*keys, value], "left")


def percentiles(df: DataFrame, value: str, fractions: Sequence[float], keys: Sequence[str] = (), out: str = "q", most: int = SORTED) -> DataFrame:
    """(keys, out): the exact, linearly interpolated quantiles as one array, without a buffer of all values.

    Where no key has more than ``most`` values, each key's are sorted by one task.  Otherwise the two order statistics around each quantile
    are found by distributed selection (:func:`selected`).  Nulls do not count, null keys are keys; keys without values are left
    out, and without keys there is always a row, with null for quantiles of nothing.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    sizes = written(v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    fractions = [float(f) for f in fractions]
    at = lambda f: (F.col("_n") - 1) * f
    wanted = F.array(*map(F.lit, fractions))  # one constant: plans do not grow with the number of fractions

    asked = sizes.select(*keys, F.explode(F.array_distinct(F.flatten(F.transform(wanted, lambda f: F.array(F.floor(at(f)), F.ceil(at(f))))))).alias("_rank"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= most:
        found = at_ranks(v, asked, keys)
    else:
        wide = 3 / ACCURACY  # three times the error of the approximate quantiles
        near = sorted({x for f in fractions for x in (max(0.0, f - wide), min(1.0, f + wide))})
        found = selected(v, asked, keys, near, most)
    ranked = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    both = ranked.join(sizes, same_keys(ranked, sizes, keys)).select(*[ranked[k] for k in keys], "_at", "_n") if keys else ranked.crossJoin(F.broadcast(sizes))

    def mixed(f):
        low, high = F.element_at("_at", F.floor(at(f))), F.element_at("_at", F.ceil(at(f)))
        part = at(f) - F.floor(at(f))
        return F.when(part == 0, low).otherwise(low + part * (high - low))

    return both.select(*keys, F.transform(wanted, mixed).alias(out))


def at_ranks(rows: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _rank, _v): the values at 0-based ranks, where one task can sort the distinct values of a key."""
    groups = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_v"))
    # Each rank takes the value of the first group that reaches beyond it: the last one seen from above.
    both = groups.select(*keys, F.lit(None).cast("long").alias("_rank"), (upto - 0.5).alias("_place"), "_v").unionByName(asked.select(*keys, "_rank", F.col("_rank").cast("double").alias("_place"), F.lit(None).cast("double").alias("_v")))
    down = Window.partitionBy(*keys).orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_v", F.last("_v", True).over(down)).where("_rank IS NOT NULL").select(*keys, "_rank", "_v")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """The condition that two frames agree in the keys, nulls alike."""
    return functools.reduce(lambda x, k: x & a[k].eqNullSafe(b[k]), keys, F.lit(True))


def selected(rows: DataFrame, asked: DataFrame, keys: Sequence[str], near: Sequence[float], most: int, few: bool = False) -> DataFrame:
    """(keys, _rank, _v): the values ``_v`` of ``rows`` (keys, _v) at the 0-based ranks ``asked`` (keys, _rank) of each key.

    A pass cuts the values of each part at approximate quantiles, counts what lies in each gap and on each cut, and goes on with the
    gaps that hold an asked rank: in the first pass cuts lie close around the asked fractions (``near``), later ones are even.  A
    rank on a cut, or at an end of a gap, is answered at once, so common values need no more passes.  It ends when no gap has
    more than ``most`` rows; only these are sorted.  ``few`` tells that all keys fit into a broadcast, so that rows stay where they lie.
    """
    answers, rest, targets = narrowed(rows, asked, keys, near, most, few)
    order = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_v")) - 1
    placed = rest.withColumn("_place", order).alias("a").join(targets.alias("b"), functools.reduce(lambda x, k: x & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), [*keys, "_part"], F.col("a._place") == F.col("b._place")))
    return answers.unionByName(placed.select(*[F.col(f"b.{k}").alias(k) for k in keys], "b._rank", "a._v"))


def narrowed(rows: DataFrame, asked: DataFrame, keys: Sequence[str], near: Sequence[float], most: int, few: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, rest, targets): ranks answered on the way, the rows of the last gaps (keys, _part, _v), and the ranks sought there.

    No (keys, _part) of ``rest`` has more than ``most`` rows.
    """
    own = [*keys, "_part"]
    on = lambda a, b, columns: functools.reduce(lambda x, k: x & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")), columns, F.lit(True))
    rows = rows.withColumn("_part", F.lit(0).cast("long"))
    targets = asked.select(*keys, F.lit(0).cast("long").alias("_part"), "_rank", F.col("_rank").alias("_place"))
    probes, accuracy, answers = list(near), ACCURACY, None
    while True:
        edges = rows.groupBy(*own).agg(F.array_distinct(F.percentile_approx("_v", probes, accuracy)).alias("_edges"))
        # Written: approximate quantiles depend on the order in which parts arrive, and the rows that go on must lie in the gaps that were counted.
        edges = written(edges.withColumn("_coarse", F.filter("_edges", lambda _, i: i % STEP == STEP - 1)), "edges")
        cut = rows.alias("r").join(F.broadcast(edges).alias("e") if few or not keys and answers is None else edges.alias("e"), on("r", "e", own)).select(*[F.col(f"r.{k}").alias(k) for k in own], "_v", "_edges", "_coarse")
        below = lambda e: F.size(F.filter(e, lambda x: x < F.col("_v")))  # noqa: E731  (first among every STEP-th edge, then among those that follow)
        cut = cut.withColumn("_first", below("_coarse") * STEP).withColumn("_below", F.col("_first") + below(F.slice("_edges", F.col("_first") + 1, STEP)))
        cut = cut.withColumn("_gap", 2 * F.col("_below") + F.coalesce(F.get("_edges", F.col("_below")) == F.col("_v"), F.lit(False)).cast("int")).drop("_edges", "_coarse", "_first", "_below")
        gaps = cut.groupBy(*own, "_gap").agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("_m").over(Window.partitionBy(*own).orderBy("_gap").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        gaps = gaps.withColumn("_before", before)  # a few gaps for each part
        inside = on("t", "g", own) & (F.col("t._place") >= F.col("g._before")) & (F.col("t._place") < F.col("g._before") + F.col("g._m"))
        hit = targets.alias("t").join(gaps.alias("g"), inside)
        answer = F.when((F.col("_lo") == F.col("_hi")) | (F.col("_place") == F.col("_before")), F.col("_lo")).when(F.col("_place") == F.col("_before") + F.col("_m") - 1, F.col("_hi"))
        hit = written(hit.select(*[F.col(f"t.{k}").alias(k) for k in own], "_rank", (F.col("_place") - F.col("_before")).alias("_place"), "_gap", "_m", answer.alias("_v")), "ranks")
        known = hit.where("_v IS NOT NULL").select(*keys, "_rank", "_v")
        answers = known if answers is None else answers.unionByName(known)
        open_ = hit.where("_v IS NULL")
        wanted = open_.select(*own, "_gap").distinct()
        largest = open_.agg(F.max("_m")).first()[0]
        part = F.col("_part") * (2 * max(len(probes), EVEN) + 2) + F.col("_gap")
        rest = cut.alias("c").join(wanted.alias("w"), on("c", "w", [*own, "_gap"]), "left_semi").select(*keys, part.alias("_part"), "_v")
        targets = open_.select(*keys, part.alias("_part"), "_rank", "_place")
        if largest is None or largest <= most:
            return answers, rest, targets
        rows = written(rest, "gaps")
        probes, accuracy = [i / EVEN for i in range(1, EVEN)], 20 * EVEN


def bin_markers(groups: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """(keys, _values, _marks): per key the values at which a bin starts, at most ``bins`` of them, in order.

    ``groups`` has before_n, n and all_n.  A mark tells the bins of the value's first and last row and its rank.
    """
    first = F.floor(F.col("before_n") * bins / F.col("all_n"))
    last = F.floor((F.col("before_n") + F.col("n") - 1) * bins / F.col("all_n"))
    starts = (last > first) | (F.col("before_n") == 0) | (F.floor((F.col("before_n") - 1) * bins / F.col("all_n")) < first)
    mark = F.struct(F.col(value).alias("v"), first.alias("first"), last.alias("last"), "before_n", "n", "all_n")
    marks = groups.where(starts).groupBy(*keys).agg(F.sort_array(F.collect_list(mark)).alias("_marks"))
    return marks.select(*keys, F.col("_marks.v").alias("_values"), "_marks")


def equal_count_bins(df: DataFrame, keys: Sequence[str], value: str, tie: str, bins: int, out: str = "bin") -> DataFrame:
    """Adds ``floor(rank0 * bins / n)`` by value, equal values by the ``tie`` column (a number, date or time).

    Values whose rows all fall into one bin need no order among them.  The others are at most ``bins`` a key: the ties at which bins begin inside
    one are its order statistics, selected where it has more than ``SORTED`` rows, so that no task sorts a common value.  Where ``tie`` tells all rows apart, bins differ by
    at most one row; rows equal in both fall into one bin, rows without a ``tie`` first of their value; rows without a value go.
    """
    groups = written(running_totals(value_groups(df, keys, value, {"n": F.count(F.lit(1))}), keys, value, ["n"]), "groups")
    rows = df.where(F.col(value).isNotNull())
    if groups.count() <= SORTED:  # few values: each row takes the bins of its own
        first, last = F.floor(F.col("before_n") * bins / F.col("all_n")), F.floor((F.col("before_n") + F.col("n") - 1) * bins / F.col("all_n"))
        on, last_mark = [*keys, value], F.lit(None).cast("long")
        places = groups.select(*on, F.struct(F.col(value).alias("v"), first.alias("first"), last.alias("last"), "before_n", "n", "all_n").alias("_own"), last_mark.alias("_last"))
    else:
        marks = written(bin_markers(groups, keys, value, bins), "bin-markers")
        rows = count_below(rows, marks.select(*keys, "_values"), keys, value, "_values", max(1, math.isqrt(bins)), "_spot").drop("_values")
        # What a row needs of the marks around it: one small record for each place among them, not the whole array.
        on, places = [*keys, "_spot"], marks.select(*keys, "_marks", F.explode(F.sequence(F.lit(0), F.size("_marks"))).alias("_spot"))
        places = places.select(*on, F.get("_marks", F.col("_spot")).alias("_own"), F.get("_marks", F.col("_spot") - 1)["last"].alias("_last"))
    own = F.coalesce(F.col("_own.v") == F.col(value), F.lit(False))
    mixed = own & (F.col("_own.last") > F.col("_own.first"))
    bin_ = F.when(own, F.col("_own.first")).otherwise(F.col("_last"))
    common = places.where("_own.last > _own.first")
    most = common.agg(F.max("_own.n")).first()[0]  # rows of the most common value in which a bin begins
    if most is None:
        return rows.join(F.broadcast(places), on).withColumn(out, bin_.cast("int")).drop("_spot", "_own", "_last")
    tied = rows.join(F.broadcast(places), on).where(mixed).select(*on, F.col(tie).alias("_v"))
    places = places.join(tie_borders(tied, common, on, bins, most), on, "left")
    place = F.col("_own.first") + F.when(F.col(tie).isNull(), 0).otherwise(F.col("_free") + F.size(F.filter("_borders", lambda b: b < F.col(tie))))
    return rows.join(F.broadcast(places), on).withColumn(out, F.when(mixed, place).otherwise(bin_).cast("int")).drop("_spot", "_own", "_last", "_free", "_borders")


def tie_borders(tied: DataFrame, mixed: DataFrame, on: Sequence[str], bins: int, most: int) -> DataFrame:
    """(on, _borders, _free): where bins begin inside a common value.

    ``tied`` (on, _v) holds the tie column of its rows, ``mixed`` (on, _own) the mark of each such value.  A row lies behind each border that its
    tie exceeds, and any row with a tie behind ``_free`` more.  Only the rows around the borders are sorted, where a value has more than ``SORTED`` rows.
    """
    tied = written(tied, "tied")
    sizes = tied.groupBy(*on).agg(F.count("_v").alias("_known"))
    begins = F.explode(F.sequence(F.col("_own.first") + 1, F.col("_own.last"))).alias("_b")
    borders = mixed.join(sizes, list(on)).select(*on, "_own", "_known", begins)
    # The first rank of a bin, less one: the row before it, among those with a tie.
    before = F.expr(f"(_b * _own.all_n + {bins - 1}) div {bins}") - F.col("_own.before_n") - 1 - (F.col("_own.n") - F.col("_known"))
    borders = written(borders.select(*on, before.alias("_rank")), "borders")
    asked, known = borders.where("_rank >= 0").distinct(), tied.where("_v IS NOT NULL")
    if most <= SORTED:
        order = F.row_number().over(Window.partitionBy(*on).orderBy("_v")) - 1
        found = known.withColumn("_rank", order.cast("long")).join(asked, [*on, "_rank"])
    else:
        found = selected(known, asked, on, [i / EVEN for i in range(1, EVEN)], SORTED, few=True)
    per_value = borders.join(found.select(*on, "_rank", "_v"), [*on, "_rank"], "left").groupBy(*on)
    return written(per_value.agg(F.collect_list("_v").alias("_borders"), F.count_if(F.col("_rank") < 0).alias("_free")), "tie-borders")
