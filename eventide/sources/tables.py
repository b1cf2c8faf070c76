"""Table sources and sinks: pruned scans, versioned caches, sparse kernels, resumable partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """A Parquet scan with pushed-down filter and pruned columns."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def optional(spark: SparkSession, path: str, schema: str, required: bool = False) -> DataFrame:
    """The table, or an empty one of the given schema if it is absent (an error if required)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        if required:
            raise
        return spark.createDataFrame([], schema)


def cached(spark: SparkSession, root: str, key: str, build) -> DataFrame:
    """The table under a digest of what it depends on; built and written if it is not there yet."""
    path = f"{root}/{key}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def newest(spark: SparkSession, root: str, stem: str, version: int) -> DataFrame:
    """The table ``<stem>-v<version>``, or else the newest older version of it; an error if there is none."""
    for v in range(version, 0, -1):
        try:
            return spark.read.parquet(f"{root}/{stem}-v{v}")
        except AnalysisException:
            continue
    raise FileNotFoundError(f"no version of {stem} up to {version} in {root}")


def files_by_date(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, stamp): files below a folder whose names hold a stamp (first group of the pattern); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.withColumn("stamp", F.regexp_extract("path", pattern, 1)).where("stamp <> ''")


def write_sparse(kernel: DataFrame, value: str, path: str) -> None:
    """Only cells that hold something are stored."""
    kernel.where(F.col(value) != 0).write.mode("overwrite").parquet(path)


def read_dense(spark: SparkSession, path: str, value: str, axes: dict[str, DataFrame]) -> DataFrame:
    """The stored cells on a full grid of the given axis tables (their product is the result itself)."""
    sparse = spark.read.parquet(path)
    grid = None
    for a in axes.values():
        grid = a if grid is None else grid.crossJoin(a)
    return grid.join(sparse, list(axes), "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def one_hot(df: DataFrame, column: str, classes: Sequence[str], inside: Column) -> DataFrame:
    """One 0/1 channel per class, null outside the domain."""
    return df.withColumns({f"is_{c}": F.when(inside, F.coalesce((F.col(column) == c).cast("int"), F.lit(0))) for c in classes})


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def still_to_do(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def upsert(results: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return results.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def append_columns(df: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add or overwrite columns by key without touching the others."""
    fresh = [c for c in extra.columns if c not in keys]
    return df.drop(*fresh).join(extra, list(keys), "left")


def count_samples(labels: DataFrame, sources: DataFrame, keys: Sequence[str], by: Column) -> DataFrame:
    """(part, n): how many labelled steps have a source step, without reading the sources' values."""
    return labels.join(sources.select(*keys).distinct(), list(keys), "left_semi").groupBy(by.alias("part")).agg(F.count(F.lit(1)).alias("n"))


def stale_parts(labels: DataFrame, by: Column, setting: str, now) -> DataFrame:
    """(part): parts with labels made under another setting, or none; only these need new labels."""
    return labels.where(~F.col(setting).eqNullSafe(F.lit(now))).select(by.alias("part")).distinct()
