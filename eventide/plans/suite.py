"""The hypothesis battery as one stacked job.

All tests (overall, within control bins, within strata) of all hypotheses become rows of one long table of
(test, control bin, value, flag, day).  One distributed ranking and one aggregation give the bin-by-day matrices of
every test, and the bootstraps run one test per task call.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.inference import bin_day_matrix, binned_gini, day_weights, fdr, row_replicates, two_sided
from ..operators.inversion import crossfit
from ..operators.rank import equal_count_bins, percentiles
from ..operators.screens import all_slots_present
from ..operators.skill import event_rate_curve
from ..sources.scratch import written
from .config import Hypothesis, RunConfig, select

ROW = "id string, scope string, n long, n_events long, gini double, ci_lo double, ci_hi double, p double, se_naive double, se_block double, inflation double, expected string"


def stacked(df: DataFrame, tests: Sequence[Hypothesis], strata: Mapping[str, Column], cfg: RunConfig, key: str, day: str) -> DataFrame:
    """(id, scope, expected, control_bin, x, flag, day, key) of all tests; control bins are equal-count over the whole sample."""
    controls = sorted({c for h in tests if cfg.run_controls for c in h.controls})
    if controls:  # all in one ranking; a row has a number for each control
        long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in controls])).alias("c")).select(key, "c.*")
        binned = equal_count_bins(long, ["name"], "value", key, cfg.control_bins, "bin").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "bin"))).alias("_bins"))
        df = df.join(written(binned, "control-bins"), key, "left").withColumns({f"_bin_{c}": F.col("_bins")[c] for c in controls}).drop("_bins")
    parts = []
    for h in tests:
        x, flag = F.col(h.predictor).cast("double"), F.col(h.flag)

        def one(scope, control_bin, keep, h=h, x=x, flag=flag):
            return F.when(keep, F.struct(F.lit(h.id).alias("id"), scope.alias("scope"), F.lit(h.expected).alias("expected"), control_bin.cast("int").alias("control_bin"), x.alias("x"), flag.alias("flag")))

        known = x.isNotNull() & flag.isNotNull()
        parts.append(one(F.lit("overall"), F.lit(-1), known))
        if cfg.run_controls:
            parts += [one(F.lit(f"ctrl:{c}"), F.col(f"_bin_{c}"), known & F.col(f"_bin_{c}").isNotNull()) for c in h.controls]
        for s in cfg.strata.get(h.id, h.strata):
            parts.append(one(F.concat(F.lit(f"{s}="), strata[s]), F.lit(-1), known & strata[s].isNotNull()))
    return df.select(key, day, F.explode(F.array_compact(F.array(*parts))).alias("t")).select("t.*", F.col(day).alias("day"), F.col(key).alias("key"))


def estimate(pdf: pd.DataFrame, cfg: RunConfig) -> dict:
    """Pooled Gini, its interval and errors from the matrices of one test (several control bins pool by events)."""
    days = np.unique(pdf["day"])
    rng = np.random.default_rng(cfg.seed)
    w = day_weights(len(days), min(cfg.block_days, len(days)), cfg.reps, rng)
    point, blocks, iid = [np.zeros(2)], [np.zeros((2, cfg.reps))], [np.zeros((2, cfg.reps))]
    conditional = pdf["control_bin"].iloc[0] >= 0
    used_n = used_e = 0
    for _, part in pdf.groupby("control_bin"):
        events = int(part["e"].sum())
        used_n, used_e = used_n + int(part["n"].sum()), used_e + events
        if conditional and events < cfg.min_events:
            continue
        index = pd.MultiIndex.from_product([np.unique(part["bin"]), days])
        grid = part.set_index(["bin", "day"])[["n", "e"]].reindex(index, fill_value=0)
        n, e = (grid[c].to_numpy(float).reshape(-1, len(days)) for c in ("n", "e"))
        for store, (a, b) in ((point, (n.sum(axis=1, keepdims=True), e.sum(axis=1, keepdims=True))), (blocks, (n @ w, e @ w)), (iid, row_replicates(n.sum(axis=1), e.sum(axis=1), cfg.reps, rng))):
            g, weight = binned_gini(a, b), b.sum(axis=0)
            good = ~np.isnan(g) & (weight > 0)
            add = np.array([np.where(good, np.nan_to_num(g) * weight, 0.0), np.where(good, weight, 0.0)])
            store.append(add[:, 0] if store is point else add)
    with np.errstate(invalid="ignore", divide="ignore"):
        pooled = [np.sum(s, axis=0) for s in (point, blocks, iid)]
        g, b, i = (np.where(p[1] > 0, p[0] / p[1], np.nan) for p in pooled)
    out = {"n": used_n, "n_events": used_e}
    boot = (b if cfg.inference == "block" else i)[~np.isnan(b if cfg.inference == "block" else i)]
    if np.isnan(g) or len(boot) < 2:
        return out | dict.fromkeys(("gini", "ci_lo", "ci_hi", "p", "se_naive", "se_block", "inflation"))
    p = two_sided(boot, g)
    lo, hi = np.quantile(boot, [0.025, 0.975])
    naive, block = (np.nanstd(x, ddof=1) for x in (i, b))
    return out | {"gini": float(g), "ci_lo": lo, "ci_hi": hi, "p": p, "se_naive": naive, "se_block": block, "inflation": block / naive if naive > 0 else None}


def run(df: DataFrame, registry: Sequence[Hypothesis], strata: Mapping[str, Column], cfg: RunConfig, key: str, day: str = "day") -> DataFrame:
    """One row per test, with false discovery control over the run."""
    tests = [h for h in select(registry, cfg.hypotheses) if h.testable]
    df = written(df, "sample")  # read once per inverted predictor and control
    for h in [h for h in tests if h.invert]:
        name = f"_{h.id}"
        index = crossfit(df.select(key, day, h.predictor, h.flag), h.predictor, h.flag, day, h.invert).select(key, F.col("index").alias(name))
        df = df.join(written(index, "index"), key, "left")
    tests = [h if not h.invert else Hypothesis(**(h.__dict__ | {"predictor": f"_{h.id}"})) for h in tests]
    long = written(stacked(df, tests, strata, cfg, key, day), "stacked")
    matrix = bin_day_matrix(long, ["id", "scope", "expected", "control_bin"], "x", "flag", "day", "key", cfg.rank_bins)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in ("id", "scope")}
        return pd.DataFrame([head | estimate(pdf, cfg) | {"expected": pdf["expected"].iloc[0]}])

    return fdr(matrix.groupBy("id", "scope").applyInPandas(one, ROW), alpha=cfg.alpha)


def verdict(results: DataFrame) -> DataFrame:
    """Adds ``verdict`` by expectation, sign and significance."""
    sign = F.when(F.col("gini") > 0, "+").otherwise("-")
    signed = F.when(~F.col("fdr_significant"), "null").when(sign == F.col("expected"), "supported").otherwise("contradicted")
    return results.withColumn("verdict", F.when(F.col("gini").isNull(), "no estimate").when(F.col("expected").isin("+", "-"), signed).when(F.col("expected") == "shape", "see event-rate curve").otherwise("see strata"))


def factor_deltas(results: DataFrame, factors: Sequence[str], factor: str, base, other, value: str) -> DataFrame:
    """(n, mean_delta): paired differences along one factor of an experiment grid, all other factors equal."""
    rest = [f for f in factors if f != factor]
    a = results.where(F.col(factor) == base).select(*rest, F.col(value).alias("_a"))
    b = results.where(F.col(factor) == other).select(*rest, F.col(value).alias("_b"))
    return a.join(b, rest).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_b") - F.col("_a")).alias("mean_delta"))


def formatted(form: str, columns: Sequence[str], otherwise: str) -> Column:
    """The columns as text, or ``otherwise`` where one of them is null."""
    known = [F.col(c).isNotNull() for c in columns]
    return F.when(reduce(and_, known), F.format_string(form, *columns)).otherwise(F.lit(otherwise))


def report_lines(results: DataFrame) -> DataFrame:
    """(id, line): one Markdown table row per overall verdict, in order of id."""
    v = verdict(results.where("scope = 'overall'"))
    ci = formatted("%+.3f [%+.3f, %+.3f]", ["gini", "ci_lo", "ci_hi"], "-")
    return v.select("id", F.concat_ws(" | ", F.lit("").cast("string"), F.col("id"), ci, formatted("%.3g", ["p"], "-"), "verdict", F.lit("")).alias("line"))


STRATIFIERS: dict[str, Callable[[], Column]] = {"slot_phase": lambda: F.when(F.col("slot") >= 3, "late").otherwise("early"), "event_type": lambda: F.col("event_type")}


def curves(df: DataFrame, tests: Sequence[Hypothesis], key: str, bins: int = 20) -> DataFrame:
    """(id, bin, n, median, rate, se): the event-rate curve of every test, from one stacked ranking."""
    parts = [F.struct(F.lit(h.id).alias("id"), F.col(h.predictor).cast("double").alias("x"), F.col(h.flag).alias("flag")) for h in tests]
    stacked = df.select(key, F.explode(F.array(*parts)).alias("t")).select(key, "t.*")
    return event_rate_curve(stacked, "x", "flag", key, bins, ["id"])


def write_curves(found: DataFrame, path: str, run: str) -> None:
    """Curves of one run; a run of the same name is replaced, others stay."""
    found.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "id").parquet(path)


def load_curves(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The curves that :func:`write_curves` stored for a run."""
    return spark.read.parquet(path).where(F.col("run") == run).drop("run").select("id", "bin", "n", "median", "rate", "se")


def tail_curves(df: DataFrame, scores: Mapping[str, str], target: str, levels: Mapping[str, float], key: str, absolute: bool = True, bins: int = 100) -> DataFrame:
    """(id, label, bin, n, n_events, cum_freq): how event rates accumulate over equal-count bins of each score, 1 the lowest.

    ``scores`` names one column per id.  Events are rows whose target exceeds a level, which is a value or, where ``absolute`` is false, a
    percentile of the target over all rows that have one.  One ranking serves all levels of a score.  Bins without rows repeat the one before;
    without events ``cum_freq`` is null; rows without score or target take no part.
    """
    needed = dict.fromkeys([key, target, *scores.values()])
    known = written(df.where(F.col(target).isNotNull()).select(*needed), "known")  # read by every pass of the ranking
    limits = {label: F.lit(float(at)) for label, at in levels.items()}
    if not absolute:  # one row, however long the table
        known = known.crossJoin(F.broadcast(percentiles(known, target, [at / 100 for at in levels.values()], out="_limits")))
        limits = {label: F.col("_limits")[i] for i, label in enumerate(levels)}
    events = F.array(*[F.col(target) > limit for limit in limits.values()]).alias("events")
    parts = F.array(*[F.struct(F.lit(name).alias("id"), F.col(c).cast("double").alias("x")) for name, c in scores.items()])
    long = known.select(key, events, F.explode(parts).alias("t")).select(key, "events", "t.*")
    counts = [F.count_if(F.col("events")[i]).alias(f"e{i}") for i in range(len(levels))]
    per_bin = equal_count_bins(long, ["id"], "x", key, bins).groupBy("id", "bin").agg(F.count(F.lit(1)).alias("n"), *counts)
    labels = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"e{i}").alias("n_events")) for i, label in enumerate(levels)])
    found = per_bin.select("id", (F.col("bin") + 1).alias("bin"), "n", F.explode(labels).alias("l")).select("id", "l.label", "bin", "n", "l.n_events")
    places = found.select("id", "label").distinct().select("id", "label", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    full = places.join(found, ["id", "label", "bin"], "left").fillna(0, ["n", "n_events"])
    of = Window.partitionBy("id", "label")
    rate = F.coalesce(F.try_divide(F.col("n_events"), F.col("n")), F.lit(0.0))
    upto = F.sum(rate).over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return full.select("id", "label", "bin", "n", "n_events", F.try_divide(upto, F.sum(rate).over(of)).alias("cum_freq"))


TAILS = "id string, label string, bin int, n long, n_events long, cum_freq double, sample string"


def write_tail_curves(found: DataFrame, path: str, sample: str) -> None:
    """Curves as one table by sample, id and label; those of the same three are replaced, others stay."""
    placed = found.withColumn("sample", F.lit(sample)).repartition("id", "label")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample", "id", "label").parquet(path)


def load_tail_curves(results: DataFrame, path: str, sample: str) -> DataFrame:
    """Stored curves of a sample, of ids in ``results`` alone: those of another sample, or left by dropped tests, are not seen."""
    stored = results.sparkSession.read.schema(TAILS).parquet(path).where(F.col("sample") == sample).drop("sample")
    return stored.join(results.select("id").distinct(), "id", "left_semi").select("id", "label", "bin", "n", "n_events", "cum_freq")


def csv_lines(df: DataFrame, file: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(id, file, line, text): a table as CSV lines per id, line 0 the header; ``order`` may not tie within an id."""
    body = df.select("id", F.row_number().over(Window.partitionBy("id").orderBy(*order)).alias("line"), F.to_csv(F.struct(*columns)).alias("text"))
    head = df.select("id").distinct().select("id", F.lit(0).alias("line"), F.lit(",".join(columns)).alias("text"))
    return head.unionByName(body).select("id", F.lit(file).alias("file"), "line", "text")


def write_folders(lines: DataFrame, path: str) -> None:
    """One folder per id with one text file per ``file`` (as Hive-style folders ``id=.../file=...``), lines in order.

    ``lines`` is any union of :func:`csv_lines` and (id, file, line, text) of other texts.  Folders of ids that have lines are rebuilt.
    """
    keys = ["id", "file"]
    ordered = lines.select(*keys, "line", "text").repartition(*keys).sortWithinPartitions(*keys, "line")
    ordered.select(*keys, "text").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).text(path)


def topline(results: DataFrame, titles: Mapping[str, str]) -> DataFrame:
    """(id, file, line, text): a short Markdown page per id with its title, overall Gini, interval, errors and verdict."""
    named = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])[F.col("id")]
    texts = [
        F.concat_ws(" ", F.lit("#"), "id", F.concat(F.lit("- "), named)),
        F.lit(""),
        F.concat(F.lit("- expected: "), F.coalesce("expected", F.lit("nothing")), F.lit(", found: "), "verdict"),
        F.concat(F.lit("- rows: "), F.col("n").cast("string"), F.lit(", events: "), F.col("n_events").cast("string")),
        F.concat(F.lit("- gini: "), formatted("%+.4f [%+.4f, %+.4f]", ["gini", "ci_lo", "ci_hi"], "no estimate")),
        F.concat(F.lit("- standard error: "), formatted("%.5f in blocks of days, %.5f of single rows", ["se_block", "se_naive"], "no estimate")),
    ]
    return verdict(results.where("scope = 'overall'")).select("id", F.lit("topline.md").alias("file"), F.posexplode(F.array(*texts)).alias("line", "text"))


def admitted(df: DataFrame, cfg: RunConfig, cell_day: Sequence[str], slots: int) -> DataFrame:
    """The sample of a configuration: rows on which all its products are known and, if asked for, only days with every slot."""
    known = df.dropna(subset=list(cfg.valid)) if cfg.valid else df
    return all_slots_present(known, cell_day, slots) if cfg.complete_days else known
