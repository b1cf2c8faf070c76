"""Missing values and schema checks at the boundary: missing is NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame, fills: Sequence[float] = ()) -> DataFrame:
    """NaN and the given fill values become NULL in all floating-point columns."""

    def clean(c: str) -> Column:
        keep = ~F.isnan(c)
        for f in fills:
            keep = keep & (F.col(c) != f)
        return F.when(keep, F.col(c)).alias(c)

    return df.select(*[clean(f.name) if isinstance(f.dataType, T.FloatType | T.DoubleType) else F.col(f.name) for f in df.schema])


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else null."""
    return F.when(b > 0, a / b)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame itself; an error that names what is there if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {sorted(df.columns)}")
    return df


def with_columns_of(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Schema-stable: columns that are absent appear as typed nulls, in the order of ``schema``."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in schema.items()])


def in_box(df: DataFrame, **bounds: tuple[float, float]) -> DataFrame:
    """Rows inside inclusive bounds of the named columns."""
    for name, (low, high) in bounds.items():
        df = df.where(F.col(name).between(low, high))
    return df


def poisoned_max(column: str | Column) -> Column:
    """Aggregate: the maximum, null if any value is missing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(c) == F.count(F.lit(1)), F.max(c))


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Aggregate: mean of the known values, renormalised by the weight they carry."""
    v, w = (F.col(c) if isinstance(c, str) else c for c in (value, weight))
    return F.sum(v * w) / F.nullif(F.sum(F.when(v.isNotNull(), w)), F.lit(0))
