"""The base table of a configuration: compiled part by part, kept under digests, so that only what changed is built again."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.screens import apply_screens
from ..operators.thresholds import exceeds, percentile_thresholds
from ..sources.tables import cached


@dataclass(frozen=True)
class BaseConfig:
    """What rows the table holds: parts (years), slots, months and the box; ``version`` stands for the code that compiles a part."""

    parts: tuple[int, ...]
    slots: tuple[int, ...] = (0, 1, 2, 3, 4, 5)
    months: tuple[int, ...] = tuple(range(1, 13))
    lat_range: tuple[float, float] = (-90.0, 90.0)
    lon_range: tuple[float, float] = (-180.0, 180.0)
    version: int = 1

    def key(self) -> str:
        """A digest of all settings but the parts: a part's table does not depend on what other parts are asked for."""
        settings = {k: v for k, v in dataclasses.asdict(self).items() if k != "parts"}
        return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:12]

    def rows(self, df: DataFrame, part: Column) -> DataFrame:
        """The rows of the configuration, filters first so that they reach the scan."""
        return df.where(part.isin(*self.parts) & F.col("slot").isin(*self.slots) & F.month("day").isin(*self.months) & F.col("lat").between(*self.lat_range) & F.col("lon").between(*self.lon_range))


def digests(source: DataFrame, part: Column) -> dict[int, str]:
    """Part -> digest of its rows whatever their order, from one aggregation of one row a part."""
    h = F.xxhash64(*source.columns)
    sums = [F.count(F.lit(1)), F.sum((F.shiftrightunsigned(h, 32)).cast("decimal(38,0)")), F.sum(h.bitwiseAND(F.lit((1 << 32) - 1)).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("again"), *source.columns))]
    found = source.groupBy(part.alias("_part")).agg(*[s.cast("string").alias(f"_{i}") for i, s in enumerate(sums)]).collect()
    return {r["_part"]: hashlib.sha256("|".join(r[f"_{i}"] for i in range(len(sums))).encode()).hexdigest()[:12] for r in found}


def build_base_table(source: DataFrame, cfg: BaseConfig, root: str, compile_part: Callable[[DataFrame, int], DataFrame], part: Column | None = None) -> DataFrame:
    """All parts of the configuration, each compiled from its rows if no table under the digest of these rows and of the settings is there.

    ``part`` (the year of ``day`` if not given) tells what part a row belongs to.  A part without rows is an error, since it would look like one without events.
    Columns that only some parts have are null in the others.
    """
    part = F.year("day") if part is None else part
    rows = cfg.rows(source, part)
    known = digests(rows, part)
    if missing := sorted(set(cfg.parts) - set(known)):
        raise ValueError(f"no rows for the parts {missing}")
    slabs = [cached(source.sparkSession, root, f"part={p}-{cfg.key()}-{known[p]}", lambda p=p: compile_part(rows.where(part == p), p)) for p in cfg.parts]
    out = slabs[0]
    for s in slabs[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


@dataclass(frozen=True)
class Prepared:
    """A configuration's tables, ready for tests."""

    base: DataFrame
    table: DataFrame
    thresholds: dict[float, float]


def prepare(source: DataFrame, cfg: BaseConfig, root: str, compile_part: Callable[[DataFrame, int], DataFrame], target: str, percentiles: Sequence[float], screens: dict[str, Column], part: Column | None = None) -> Prepared:
    """Base table, thresholds from its unscreened rows, the screened rows with one flag per percentile."""
    base = build_base_table(source, cfg, root, compile_part, part)
    cuts = dict(zip(percentiles, percentile_thresholds(base, target, percentiles), strict=True))
    table = apply_screens(base, screens).withColumns({f"flag_p{p:g}": exceeds(target, cut) for p, cut in cuts.items()})
    return Prepared(base, table, cuts)
