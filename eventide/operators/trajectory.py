"""Trajectories, footprints and influence kernels in sparse form (one row per receptor, lag and source cell)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .rank import SORTED, running_totals, value_groups
from .segments import neighbours, segmented, totals
from .windows import path_length, residence_hours

#: Points of a task that spreads them over cells.
SPREAD = 50_000


def apply_kernel(kernel: DataFrame, surface: DataFrame, receptor: Sequence[str], source: Sequence[str], weight: str, value: str, min_coverage: float = 0.0) -> DataFrame:
    """(receptor, value, coverage): weighted mean of a gappy surface, renormalised by the weight on known cells; null below the coverage."""
    known = F.when(F.col(value).isNotNull(), F.col(weight))
    out = kernel.join(surface, list(source), "left").groupBy(*receptor).agg(F.sum(F.col(weight) * F.col(value)).alias("_s"), F.coalesce(F.sum(known), F.lit(0.0)).alias("_k"), F.sum(weight).alias("_w"))
    coverage = F.col("_k") / F.nullif(F.col("_w"), F.lit(0))
    return out.select(*receptor, F.when(coverage >= min_coverage, F.col("_s") / F.nullif(F.col("_k"), F.lit(0))).alias("value"), coverage.alias("coverage"))


def resample(points: DataFrame, path: Sequence[str], time: str, values: Sequence[str], step: int, most: int = SORTED) -> DataFrame:
    """(path, time, values) on a regular grid of ``step`` seconds from each path's first time, and its exact last point.

    Only the leading run of complete points counts.  Values mix linearly between neighbouring points.  Paths of more than ``most`` points are
    scanned in ranges of time.
    """
    order = [time, *values]  # the values order points of one time
    good = F.lit(True)
    for v in values:
        good = good & F.col(v).isNotNull()
    rows, group = segmented(points.select(*path, time, *values), path, order, most)
    rows = neighbours(rows, path, group, order, {}, {"_b": F.col(time), "_good": good} | {f"_b_{v}": F.col(v) for v in values})
    rows = totals(rows, path, group, order, {"_bad": (~good).cast("int")}, least={"_t0": F.col(time)})
    b = lambda c: F.when(F.col("_good"), F.col(c))  # noqa: E731  (the run ends before an incomplete point)
    spans = rows.where("_bad = 0").select(*path, F.col(time).alias("_a"), b("_b").alias("_b"), "_t0", *[x for v in values for x in (F.col(v).alias(f"_a_{v}"), b(f"_b_{v}").alias(f"_b_{v}"))])
    first = F.col("_t0") + F.ceil((F.col("_a") - F.col("_t0")) / step) * step
    inner = spans.where((F.col("_b") > F.col("_a")) & (first < F.col("_b"))).withColumn(time, F.explode(F.sequence(first, F.col("_b") - 1, F.lit(step).cast("long"))))
    mix = (F.col(time) - F.col("_a")) / (F.col("_b") - F.col("_a"))
    inner = inner.select(*path, time, *[(F.col(f"_a_{v}") + (F.col(f"_b_{v}") - F.col(f"_a_{v}")) * mix).alias(v) for v in values])
    last = spans.where("_b IS NULL").select(*path, F.col("_a").alias(time), *[F.col(f"_a_{v}").alias(v) for v in values])
    return inner.unionByName(last)


def deposit(points: DataFrame, receptor: Sequence[str], lat: str, lon: str, sigma: str, mass: str, cell: float = 1.0, cut: float = 4.0, most: int = SPREAD) -> DataFrame:
    """(receptor, ilat, ilon, mass): each point's mass spread by a discrete two-dimensional Gaussian.

    Distances are in units of ``cell``; cells within ``cut`` sigma take part, weights are normalised per point so that
    mass is conserved, and a spread below half a cell puts all of it into the nearest cell.

    Points go to the tasks by receptor before they multiply, about ``most`` a task; a receptor with more is spread over several, whose cells are
    added afterwards.  So a task holds the cells of a bounded number of points, however long the table.
    """
    points = written(points.select(*receptor, lat, lon, sigma, mass), "points")
    parts = max(points.sparkSession.sparkContext.defaultParallelism, -(-points.count() // most))
    large = points.groupBy(*receptor).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    large = written(large.select(*[F.col(c).alias(f"_large_{c}") for c in receptor], "_n"), "large")
    own, spread = list(receptor), not large.isEmpty()
    if spread:  # few: each has more than ``most`` points
        same = reduce(lambda on, c: on & F.col(c).eqNullSafe(F.col(f"_large_{c}")), receptor, F.lit(True))
        share = F.pmod(F.xxhash64(lat, lon, sigma, mass, F.monotonically_increasing_id()), F.ceil(F.col("_n") / most))
        own = [*receptor, "_share"]
        points = points.join(F.broadcast(large), same, "left").select(*points.columns, F.coalesce(share, F.lit(0)).alias("_share"))
    points = points.repartition(parts, *own)
    reach = F.when(F.col(sigma) < cell / 2, 0).otherwise(F.ceil(F.col(sigma) * cut / cell)).cast("int")
    p = points.select(*own, lat, lon, F.col(sigma).alias("_s"), F.col(mass).alias("_m"), reach.alias("_r"), F.rint(F.col(lat) / cell).cast("int").alias("_i"), F.rint(F.col(lon) / cell).cast("int").alias("_j"))
    # Row by row of cells: only the span of columns that the circle covers is made, a little wider for rounding, then tested.
    away = lambda i: i * cell - F.col(lat)
    half = lambda i: F.sqrt(F.greatest(F.pow(F.col("_s") * cut, 2) - F.pow(away(i), 2), F.lit(0.0))) * (1 + 1e-9) / cell + 1e-9
    columns = lambda i: F.when(F.col("_r") == 0, F.array(F.col("_j"))).otherwise(F.filter(F.sequence(F.ceil(F.col(lon) / cell - half(i)).cast("int"), F.floor(F.col(lon) / cell + half(i)).cast("int") + 1), lambda j: F.abs(j * cell - F.col(lon)) <= half(i) * cell + 1e-9))

    def cells(i):
        """Columns and weights of one row of cells."""
        d2 = lambda j: F.pow(away(i), 2) + F.pow(j * cell - F.col(lon), 2)
        weight = lambda j: F.when(F.col("_r") == 0, 1.0).when(d2(j) <= F.pow(F.col("_s") * cut, 2), F.exp(-d2(j) / (2 * F.col("_s") * F.col("_s")))).otherwise(0.0)
        return F.transform(columns(i), lambda j: F.struct(i.alias("ilat"), j.alias("ilon"), weight(j).alias("w")))

    rows = F.filter(F.sequence(F.col("_i") - F.col("_r"), F.col("_i") + F.col("_r")), lambda i: (F.col("_r") == 0) | (F.abs(away(i)) <= F.col("_s") * cut))
    p = p.withColumn("_c", F.flatten(F.transform(rows, cells)))
    p = p.withColumn("_t", F.aggregate("_c", F.lit(0.0), lambda acc, c: acc + c["w"]))
    flat = p.select(*own, "_m", "_t", F.explode(F.filter("_c", lambda c: c["w"] > 0)).alias("c"))
    found = flat.groupBy(*own, "c.ilat", "c.ilon").agg(F.sum(F.col("_m") * F.col("c.w") / F.col("_t")).alias("mass"))
    return found if not spread else found.repartition(parts, *receptor, "ilat", "ilon").groupBy(*receptor, "ilat", "ilon").agg(F.sum("mass").alias("mass"))


def containment(members: DataFrame, group: Sequence[str], x: str, y: str, share: float = 0.9, fewest: int = 20) -> DataFrame:
    """(group, cx, cy, radius): the circle around the mean position that holds a share of the members; groups below ``fewest`` stay open (null radius)."""
    # Written: a mean computed anew adds in another order, and the last digits of the distances would differ between the steps of the ranking.
    centre = written(members.groupBy(*group).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count(F.lit(1)).alias("_n")), "centres")
    d = F.sqrt(F.pow(F.col(x) - F.col("cx"), 2) + F.pow(F.col(y) - F.col("cy"), 2))
    away = members.join(centre, list(group)).select(*group, d.alias("_d"))
    ranks = running_totals(value_groups(away, group, "_d", {"_m": F.count(F.lit(1))}), group, "_d", ["_m"])
    # The member of rank ceil(share * n) is the largest one with fewer than so many nearer ones.
    radius = ranks.groupBy(*group).agg(F.max(F.when(F.col("before__m") < F.ceil(share * F.col("all__m")), F.col("_d"))).alias("_r"))
    return centre.join(radius, list(group), "left").select(*group, "cx", "cy", F.when(F.col("_n") >= fewest, F.col("_r")).alias("radius"))


def normalise_per_lag(kernel: DataFrame, receptor: Sequence[str], lag: str, raw: str, masked: str) -> DataFrame:
    """Adds ``kernel`` (mass share inside receptor and lag; the unmasked mass where the mask left nothing) and ``lag_weight`` (the lag's share of the receptor)."""
    per_lag, per_receptor = Window.partitionBy(*receptor, lag), Window.partitionBy(*receptor)
    used = F.when((F.sum(masked).over(per_lag) == 0) & (F.sum(raw).over(per_lag) > 0), F.col(raw)).otherwise(F.col(masked))
    k = kernel.withColumn("_u", used)
    return k.withColumn("kernel", F.col("_u") / F.nullif(F.sum("_u").over(per_lag), F.lit(0))).withColumn("lag_weight", F.sum("_u").over(per_lag) / F.nullif(F.sum("_u").over(per_receptor), F.lit(0))).drop("_u")


def kernel_shape(kernel: DataFrame, receptor: Sequence[str], weight: str, dlat: str, dlon: str, lag: str) -> DataFrame:
    """(receptor, total, clat, clon, fetch, mean_lag): centroid of the influence, its distance and the mean lag."""
    w = F.col(weight)
    out = kernel.groupBy(*receptor).agg(F.sum(w).alias("total"), (F.sum(w * F.col(dlat)) / F.sum(w)).alias("clat"), (F.sum(w * F.col(dlon)) / F.sum(w)).alias("clon"), (F.sum(w * F.col(lag)) / F.sum(w)).alias("mean_lag"))
    return out.withColumn("fetch", F.sqrt(F.col("clat") * F.col("clat") + F.col("clon") * F.col("clon")))


def mass_region(kernel: DataFrame, receptor: Sequence[str], weight: str, distance: str, share: float = 0.9) -> DataFrame:
    """Rows in order of distance until they hold a share of the receptor's mass (the row that crosses it included)."""
    w = Window.partitionBy(*receptor)
    upto = F.sum(weight).over(w.orderBy(distance).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before = upto - F.sum(weight).over(Window.partitionBy(*receptor, distance))
    return kernel.withColumn("_b", before).withColumn("_t", F.sum(weight).over(w)).where(F.col("_b") < share * F.col("_t")).drop("_b", "_t")


def footprint(points: DataFrame, receptor: Sequence[str], path: Sequence[str], hours: str, lat: str, lon: str, *, contact: Column, sigma: Column, land: Column | None = None, energy: Column | None = None, discount: Column | None = None, most_lag: int = 72, lag_hours: int = 1) -> DataFrame:
    """(receptor, lag, ilat, ilon, mass): where the air of each receptor touched the ground, and how long before.

    The mass of a point is its contact, times its residence time, times the shares of land and retained moisture and the energy
    where given; it is spread by a Gaussian.  ``sigma`` may use the columns ``back`` (distance along the path to its end, in the units of
    lat and lon) and ``lag_h`` (hours to its end).  The lag is that time to the nearest ``lag_hours``, up to ``most_lag`` hours.
    """
    df = path_length(residence_hours(points, path, hours, hours, "_res"), path, hours, lat, lon)
    rows, group = segmented(df, path, [hours])
    df = totals(rows, path, group, [hours], most={"_end": F.col(hours)})
    df = df.withColumns({"back": F.col("remaining"), "lag_h": F.col("_end") - F.col(hours)})
    mass = F.col("_res") * contact
    for factor in (land, energy, discount):
        mass = mass if factor is None else mass * factor
    df = df.withColumns({"_mass": mass, "_sigma": sigma, "lag": F.rint(F.col("lag_h") / lag_hours).cast("int")})
    return deposit(df.where((F.col("_mass") > 0) & (F.col("lag_h") <= most_lag)), [*receptor, "lag"], lat, lon, "_sigma", "_mass")
