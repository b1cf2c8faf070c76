"""Parcels to receptors: which arrivals belong to which target, and the kernels of all targets at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trajectory import footprint

#: Pieces into which each bucket of the box join is dealt, so that a receptor with a large share of all arrivals is no single task.
SALTS = 16


def in_band(alt: str | Column, band: tuple[float, float]) -> Column:
    """Within the altitude band, both ends included; a missing altitude is outside."""
    alt = F.col(alt) if isinstance(alt, str) else alt
    return F.coalesce((alt >= band[0]) & (alt <= band[1]), F.lit(False))


def within_box(arrivals: DataFrame, receptors: DataFrame, keys: Sequence[str], lat: str, lon: str, half: float, receptor_lat: str = "rlat", receptor_lon: str = "rlon", alt: str | None = None, band: tuple[float, float] | None = None, salts: int = SALTS) -> DataFrame:
    """All pairs of an arrival and a receptor of the same ``keys`` within ``half`` degrees in both directions, edges included.

    An interval join on both axes as one equi-join: the plane is cut into squares as wide as the box, a receptor stands in the
    squares that its box touches (at most four, and never two for one arrival), an arrival in its own; the exact test follows.
    Boxes may overlap, so an arrival can belong to several receptors.  Columns of both sides stay; ``keys`` stand once.
    """
    size, reach = 2 * half, half * (1 + 1e-9)  # a little more than the box, so that rounding cannot part a pair before the test
    square = lambda x: F.floor(x / size).cast("long")
    squares = lambda x: F.explode(F.sequence(square(F.col(x) - reach), square(F.col(x) + reach)))
    targets = receptors.where(F.col(receptor_lat).isNotNull() & F.col(receptor_lon).isNotNull())
    targets = targets.withColumn("_i", squares(receptor_lat)).withColumn("_j", squares(receptor_lon))
    targets = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = arrivals if band is None else arrivals.where(in_band(alt, band))
    rows = rows.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    dealt = F.pmod(F.xxhash64(lat, lon, *[c for c in arrivals.columns if c not in (lat, lon)]), F.lit(salts)).cast("int")
    rows = rows.withColumns({"_i": square(F.col(lat)), "_j": square(F.col(lon)), "_salt": dealt})
    near = (F.abs(F.col(lat) - F.col(receptor_lat)) <= half) & (F.abs(F.col(lon) - F.col(receptor_lon)) <= half)
    return rows.join(targets, [*keys, "_i", "_j", "_salt"]).where(near).drop("_i", "_j", "_salt")


def nearest_target(arrivals: DataFrame, lat: str, lon: str, lat0: float, lon0: float, step: float, n_lat: int, n_lon: int, alt: str | None = None, band: tuple[float, float] | None = None) -> DataFrame:
    """Adds ``tlat`` and ``tlon``, the centre of the single nearest cell of a regular grid; arrivals off the grid or the band go.

    Midway between two centres the even one takes the arrival, so that no arrival counts twice.
    """
    i, j = F.rint((F.col(lat) - lat0) / step).cast("int"), F.rint((F.col(lon) - lon0) / step).cast("int")
    rows = arrivals if band is None else arrivals.where(in_band(alt, band))
    rows = rows.withColumns({"_i": i, "_j": j}).where(F.col("_i").between(0, n_lat - 1) & F.col("_j").between(0, n_lon - 1))
    return rows.withColumns({"tlat": F.col("_i") * step + lat0, "tlon": F.col("_j") * step + lon0}).drop("_i", "_j")


def receptor_kernels(points: DataFrame, members: DataFrame, path: Sequence[str], receptor: Sequence[str], step: str, hours: str, lat: str, lon: str, *, contact: Column, sigma: Column, land: Column | None = None, energy: Column | None = None, discount: Column | None = None, most_lag: int = 72, lag_hours: int = 1, window: float | None = None, target: tuple[str, str] | None = None) -> DataFrame:
    """(receptor, lag, ilat, ilon, mass, n_parcels): footprints of all receptors, arrival steps among their columns, in one job.

    ``members`` has a row per arrival: ``path``, ``receptor`` (which may hold the arrival step) and ``step``, the point at which the path arrives.  Only points up to the arrival
    count, and their lags run back from it.  With ``window`` and the ``target`` columns only source cells within so many degrees are kept.
    """
    arrived = members.select(*path, *receptor, F.col(step).alias("_arrival"))
    counts = arrived.groupBy(*receptor).agg(F.count(F.lit(1)).alias("n_parcels"))
    before = points.join(arrived, list(path)).where(F.col(step) <= F.col("_arrival"))
    prints = footprint(before, receptor, [*path, *[r for r in receptor if r not in path], "_arrival"], hours, lat, lon, contact=contact, sigma=sigma, land=land, energy=energy, discount=discount, most_lag=most_lag, lag_hours=lag_hours)
    if window is not None:
        prints = prints.where((F.abs(F.col("ilat") - F.col(target[0])) <= window) & (F.abs(F.col("ilon") - F.col(target[1])) <= window))
    return prints.join(counts, list(receptor))
