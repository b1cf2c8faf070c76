"""Forests, mixtures and storm classifiers on pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .skill import r_squared


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip").transform(df)


def forest_fit(train: DataFrame, features: Sequence[str], target: str, trees: int = 30, depth: int = 6, seed: int = 0):
    return RandomForestRegressor(featuresCol="_features", labelCol=target, predictionCol="predicted", numTrees=trees, maxDepth=depth, seed=seed).fit(assemble(train, features))


def block_comparison(df: DataFrame, base: Sequence[str], extra: Sequence[str], target: str, is_test: Column, trees: int = 20) -> DataFrame:
    """(block, n, r2): a forest with and without a block of features, on one sample that has them all."""
    sample = written(df.dropna(subset=[*base, *extra, target]).withColumn("_test", is_test), "comparison")
    out = []
    for name, features in (("base", list(base)), ("with_extra", [*base, *extra])):
        model = forest_fit(sample.where("NOT _test"), features, target, trees)
        out.append(r_squared(model.transform(assemble(sample.where("_test"), features)), target, "predicted").withColumn("block", F.lit(name)))
    return out[0].unionByName(out[1]).select("block", "n", "r2")


def importances(model, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance), one row per feature."""
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


def threshold_classify(df: DataFrame, rule: Column) -> DataFrame:
    return df.withColumn("convective", F.coalesce(rule, F.lit(False)))


def mixture_classify(df: DataFrame, features: Sequence[str], leading: str, k: int = 4, seed: int = 0) -> DataFrame:
    """Adds ``convective``: rows in the mixture component with the largest mean of the leading feature."""
    rows = assemble(df, features)
    scaled = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True).fit(rows).transform(rows)
    model = GaussianMixture(featuresCol="_scaled", predictionCol="component", probabilityCol="_probability", k=k, seed=seed, maxIter=50).fit(scaled)
    at = list(features).index(leading)
    best = max(range(k), key=lambda i: model.gaussians[i].mean.toArray()[at])
    return model.transform(scaled).withColumn("convective", F.col("component") == best).drop("_features", "_scaled", "_probability")


def forest_classify(df: DataFrame, features: Sequence[str], weak_label: Column, trees: int = 30, seed: int = 0) -> DataFrame:
    """Adds ``probability`` and ``convective`` from a forest trained on weak labels; rows whose label is null are only scored."""
    rows = assemble(df, features).withColumn("_label", weak_label.cast("double"))
    known = rows.where("_label IS NOT NULL")
    rate = known.agg(F.avg("_label")).first()[0] or 0.5
    weighted = known.withColumn("_w", F.when(F.col("_label") == 1, 0.5 / max(rate, 1e-6)).otherwise(0.5 / max(1 - rate, 1e-6)))
    model = RandomForestClassifier(featuresCol="_features", labelCol="_label", weightCol="_w", numTrees=trees, maxDepth=6, seed=seed).fit(weighted)
    out = model.transform(rows).withColumn("probability", vector_to_array("probability")[1])
    return out.withColumn("convective", F.col("probability") >= 0.5).drop("_features", "_label", "rawPrediction", "prediction")


def isotonic(train: DataFrame, score: DataFrame, p: str, flag: str) -> DataFrame:
    """Adds ``calibrated``: monotone calibration of a probability."""
    model = IsotonicRegression(featuresCol="_p", labelCol="_y", predictionCol="calibrated").fit(train.select(F.col(p).alias("_p"), F.col(flag).cast("double").alias("_y")))
    return model.transform(score.withColumn("_p", F.col(p))).drop("_p")
