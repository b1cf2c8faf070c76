"""Reading one cell of a large archive: tables laid out by day and band of latitude, sorted by cell inside."""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Degrees of latitude in one partition.
BAND = 10.0


def lay_out(df: DataFrame, path: str, lat: str = "lat", lon: str = "lon", day: str = "day", band: float = BAND, files: int = 4) -> None:
    """Write ``df`` for point reads: folders by day and band, up to ``files`` sorted files in each, so that footers tell which can hold a cell.

    Rows are dealt by day, band and a slice of the longitude, which spreads a day or band with a large share of the rows.
    """
    placed = df.withColumns({"band": F.floor(F.col(lat) / band).cast("int"), "_slice": F.pmod(F.floor(F.col(lon) / 5), F.lit(files)).cast("int")})
    dealt = placed.repartition(day, "band", "_slice").sortWithinPartitions(day, "band", lat, lon).drop("_slice")
    dealt.write.mode("overwrite").partitionBy(day, "band").parquet(path)


def nearest_index(at: float, first: float, step: float) -> float:
    """The coordinate of the grid nearest to ``at``; midway, the even index."""
    return first + step * round((at - first) / step)


def point_profile(spark: SparkSession, path: str, at: tuple[float, float], first_day: datetime.date, days: int = 2, grid: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 1.0), (0.0, 1.0)), positive: Sequence[str] = (), denser: str | None = None, lat: str = "lat", lon: str = "lon", day: str = "day", band: float = BAND) -> DataFrame:
    """The rows of the cell nearest to ``at`` on ``days`` days from ``first_day``; a day that is absent is left out.

    Only the folders of these days and of the cell's band are listed and only files whose range holds the cell are read.  ``grid`` has origin and step of
    both axes.  Zeros of the ``positive`` columns stand for missing values.  A ``denser`` archive laid out the same way replaces the days that it has.
    """
    cell = [nearest_index(a, *g) for a, g in zip(at, grid, strict=True)]
    half = [abs(g[1]) / 4 for g in grid]  # coordinates may be stored as floats

    def read(where: str) -> DataFrame:
        rows = spark.read.parquet(where)
        wanted = [first_day + datetime.timedelta(days=i) for i in range(days)]
        bands = sorted({math.floor((cell[0] + d) / band) for d in (-half[0], half[0])})
        rows = rows.where(F.col(day).isin(wanted) & F.col("band").isin(bands))
        return rows.where(F.col(lat).between(cell[0] - half[0], cell[0] + half[0]) & F.col(lon).between(cell[1] - half[1], cell[1] + half[1])).drop("band")

    out = read(path)
    if denser is not None:
        better = read(denser)
        out = out.join(better.select(day).distinct(), day, "left_anti").select(*out.columns).unionByName(better, allowMissingColumns=True)
    return out.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in positive})
