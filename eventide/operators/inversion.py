"""Rate-ordered indices of non-monotone predictors, cross-fitted over contiguous folds of days."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .rank import percentiles

#: A value that holds at least this share of the training rows gets an indicator of its own.
ATOM_SHARE = 0.05


def contiguous_folds(df: DataFrame, day: str, folds: int) -> DataFrame:
    """Adds ``fold``: the days cut in order into equal parts (as many rows as there are days pass one task)."""
    days = df.select(day).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    numbered = days.select(day, F.floor((F.row_number().over(Window.orderBy(day)) - 1) * folds / n).cast("int").alias("fold"))
    return df.join(F.broadcast(numbered), day)


def quadratic_logistic(train: DataFrame, score: DataFrame, x: str, flag: str) -> DataFrame:
    """Adds ``index``: P(event) from a logistic fit in z and z squared, and an indicator of an atom."""
    s = train.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("d"), F.avg(F.col(flag).cast("int")).alias("r"), F.count(F.lit(1)).alias("n")).first()
    if not s["n"] or s["r"] in (0.0, 1.0):
        return score.withColumn("index", F.lit(s["r"]))
    top = train.groupBy(x).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), x).first()
    atom = top[x] if top["c"] >= ATOM_SHARE * s["n"] else None
    mean, sd = s["m"], s["d"] or 1.0

    z = (F.col(x) - mean) / sd
    columns = [z, z * z] if atom is None else [z, z * z, (F.col(x) == atom).cast("double")]

    def design(df: DataFrame) -> DataFrame:
        return df.withColumn("_f", array_to_vector(F.array(*columns)))

    model = LogisticRegression(featuresCol="_f", labelCol="_y", probabilityCol="_p", predictionCol="_q", rawPredictionCol="_w", regParam=0.0, maxIter=100)
    fitted = model.fit(design(train).select("_f", F.col(flag).cast("double").alias("_y")))
    return fitted.transform(design(score)).withColumn("index", vector_to_array("_p")[1]).drop("_f", "_p", "_q", "_w")


def binned_rates(train: DataFrame, score: DataFrame, x: str, flag: str, bins: int = 20) -> DataFrame:
    """Adds ``index``: event rates of quantile bins, linear between the bins' medians, constant beyond them."""
    edges = sorted(set(e for e in percentiles(train, x, [i / bins for i in range(bins + 1)]).first()["q"] if e is not None))
    if len(edges) < 3:
        r = train.agg(F.avg(F.col(flag).cast("int"))).first()[0]
        return score.withColumn("index", F.lit(r))
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    which = F.size(F.filter(inner, lambda e: e <= F.col(x)))
    binned = train.withColumn("b", which)
    medians = percentiles(binned, x, [0.5], ["b"]).select("b", F.col("q")[0].alias("c"))
    per_bin = binned.groupBy("b").agg(F.avg(F.col(flag).cast("int")).alias("r")).join(medians, "b").orderBy("c").collect()  # one row a bin
    c, r = [p["c"] for p in per_bin], [p["r"] for p in per_bin]
    v = F.col(x)
    index: Column = F.lit(r[-1])
    for i in range(len(c) - 2, -1, -1):
        index = F.when(v <= c[i + 1], r[i] + (r[i + 1] - r[i]) * (v - c[i]) / (c[i + 1] - c[i])).otherwise(index)
    return score.withColumn("index", F.when(v.isNull(), None).when(v <= c[0], r[0]).otherwise(index))


def fold_curves(cut: DataFrame, x: str, flag: str, bins: int = 20) -> DataFrame:
    """(_k, _curve): for every fold the curve of :func:`binned_rates` that the rows of the other folds give, all fitted at once.

    A training row counts once for each fold that is not its own; edges, medians and rates are keyed by the fold that they serve.
    """
    known = cut.where(F.col(x).isNotNull() & F.col(flag).isNotNull())
    folds = cut.select("fold").distinct().agg(F.collect_set("fold").alias("_all"))  # a few numbers
    train = known.crossJoin(F.broadcast(folds)).select(F.col(x).cast("double").alias("_x"), F.col(flag).cast("int").alias("_y"), F.explode(F.filter("_all", lambda k: k != F.col("fold"))).alias("_k"))
    train = written(train, "folds-train")
    found = percentiles(train, "_x", [i / bins for i in range(bins + 1)], ["_k"], "_e")
    edges = found.select("_k", F.array_sort(F.array_distinct("_e")).alias("_e"))
    inner = F.when(F.size("_e") > 2, F.expr("slice(_e, 2, size(_e) - 2)")).otherwise(F.array().cast("array<double>"))
    edges = written(edges.select("_k", inner.alias("_e")), "fold-edges")
    binned = train.join(F.broadcast(edges), "_k").withColumn("_b", F.size(F.filter("_e", lambda e: e <= F.col("_x")))).drop("_e")
    medians = percentiles(binned, "_x", [0.5], ["_k", "_b"], "_c")
    rates = binned.groupBy("_k", "_b").agg(F.avg("_y").alias("r")).join(medians, ["_k", "_b"])
    curve = rates.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct(F.col("_c")[0].alias("c"), "r"))).alias("_curve"))  # one point a bin
    return written(curve, "fold-curves")


def along_curves(df: DataFrame, curves: DataFrame, x: str) -> DataFrame:
    """Adds ``index`` to rows with a ``fold``: their fold's curve at x, linear between its points, constant beyond; rows without x go."""
    scored = df.where(F.col(x).isNotNull()).join(F.broadcast(curves), F.col("fold") == F.col("_k"), "left")
    v, below = F.col(x).cast("double"), F.size(F.filter("_curve", lambda p: p["c"] < F.col(x)))
    scored = scored.withColumns({"_low": F.get("_curve", below - 1), "_high": F.get("_curve", below)})
    between = F.col("_low.r") + (F.col("_high.r") - F.col("_low.r")) * (v - F.col("_low.c")) / (F.col("_high.c") - F.col("_low.c"))
    return scored.withColumn("index", F.when(F.col("_low").isNull(), F.col("_high.r")).when(F.col("_high").isNull(), F.col("_low.r")).otherwise(between)).drop("_k", "_curve", "_low", "_high")


METHODS: dict[str, Callable] = {"quadratic": quadratic_logistic, "binned": binned_rates}


def crossfit(df: DataFrame, x: str, flag: str, day: str, method: str, folds: int = 5) -> DataFrame:
    """Adds ``index`` and ``fold``: every row scored by a fit on the other folds; rows without x get none."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {sorted(METHODS)}")
    cut = written(contiguous_folds(df, day, folds), "folds")
    if method == "binned":
        return along_curves(cut, fold_curves(cut, x, flag), x)
    known = F.col(x).isNotNull() & F.col(flag).isNotNull()
    parts = []
    for k in range(folds):
        train, score = cut.where(known & (F.col("fold") != k)), cut.where(F.col(x).isNotNull() & (F.col("fold") == k))
        parts.append(METHODS[method](train, score, x, flag).withColumn("index", F.col("index").cast("double")))
    return reduce(DataFrame.unionByName, parts)


def fold_stability(df: DataFrame, x: str, flag: str, day: str, method: str, folds: int = 5, points: int = 101) -> DataFrame:
    """(n_pairs, stability): mean Spearman correlation between the folds' fits, each evaluated on one grid of quantiles.

    A low value says that the fit follows noise.  The grid has ``points`` values whatever the rows.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {sorted(METHODS)}")
    known = written(contiguous_folds(df.where(F.col(x).isNotNull() & F.col(flag).isNotNull()), day, folds), "folds")
    at = [0.005 + 0.99 * i / (points - 1) for i in range(points)]
    grid = percentiles(known, x, at).select(F.posexplode("q").alias("place", x)).where(F.col(x).isNotNull())
    grid = written(grid, "grid")
    if method == "binned":
        every = grid.crossJoin(F.broadcast(known.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))))  # the grid once a fold
        curves = along_curves(every, fold_curves(known, x, flag), x).select("place", "fold", "index")
    else:
        parts = [METHODS[method](known.where(F.col("fold") != k), grid, x, flag).select("place", F.lit(k).alias("fold"), F.col("index").cast("double").alias("index")) for k in range(folds)]
        curves = reduce(DataFrame.unionByName, parts)
    by_fold = Window.partitionBy("fold")
    ranked = written(curves, "curves").withColumn("r", F.rank().over(by_fold.orderBy("index")) + (F.count(F.lit(1)).over(Window.partitionBy("fold", "index")) - 1) / 2)
    a, b = ranked.select("place", F.col("fold").alias("f"), F.col("r").alias("a")), ranked.select("place", F.col("fold").alias("g"), F.col("r").alias("b"))
    pairs = a.join(b, "place").where("f < g").groupBy("f", "g").agg(F.corr("a", "b").alias("c"))
    return pairs.agg(F.count("c").alias("n_pairs"), F.avg("c").alias("stability"))
