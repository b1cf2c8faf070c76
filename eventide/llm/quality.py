"""Operator 7: document quality by regularised quadratic discriminant analysis.

Every text becomes a vector of transformed statistics (log lengths, logits of character shares, ratios of distinct
words and lines).  The class means and covariances are sums that Spark aggregates over *all* labelled rows
outside the held-out fold, so the driver sees a few hundred numbers whatever the size of the data.  Each class
covariance is shrunk towards the pooled one and towards a multiple of the identity; its Cholesky factor is kept, and a
score is the posterior of class 1 from the difference of the two Mahalanobis log densities.  Labels, language,
source and id are never inputs of a score.

Defined cases: very long texts are read whole; null and empty texts have the statistics of an empty text and get a score like any other; rows
without a label, or with a null one, are scored but not learnt from; several labels of one id each count; repeated rows each get a
row; equal texts get equal scores, and a score equal to the threshold is accepted; without labelled rows of both classes every score is 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialised, table

THRESHOLD = 0.3
FOLDS = 5
#: Shrinkage towards the pooled covariance, and of the result towards a multiple of the identity.
TO_POOLED, TO_SPHERE = 0.5, 0.02

FEATURES = (
    "log_chars", "log_words", "log_lines", "word_length", "line_length", "upper", "digit", "common_mark", "rare_mark",
    "blank", "wide", "distinct_words", "distinct_lines", "full_stops",
)

# Character classes of bytes.
_LOWER, _UPPER, _DIGIT, _COMMON, _RARE, _BLANK, _WIDE, _STOP = range(8)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _RARE, np.uint8)
    out[0x80:] = _WIDE
    for chars, c in (("abcdefghijklmnopqrstuvwxyz", _LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("0123456789", _DIGIT), (",;:'\"()-?", _COMMON), (" \t\r\n\x0b\x0c", _BLANK), (".", _STOP)):
        for x in chars:
            out[ord(x)] = c
    return out


CLASSES = _byte_classes()


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    share = np.log((np.bincount(CLASSES[raw], minlength=8) + 0.5) / (n + 4.0))
    words = text.split()
    lines = text.split("\n")
    n_words, n_lines = len(words), len(lines)
    log_words = math.log1p(n_words)
    return [
        math.log1p(n), log_words, math.log(n_lines), math.log1p((n - n_words) / (n_words + 1)), math.log1p(n / n_lines),
        float(share[_UPPER]), float(share[_DIGIT]), float(share[_COMMON]), float(share[_RARE]), float(share[_BLANK]), float(share[_WIDE]),
        math.log1p(len(set(words))) - log_words, math.log(len(set(lines)) / n_lines), float(share[_STOP]),
    ]


def statistics_of(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, x): the statistics of every whole text."""
    return map_texts(docs, keys, text_col, lambda: lambda texts: [[statistics(t) for t in texts]], [("x", "array<double>")])


@dataclass(frozen=True)
class Discriminant:
    """Class log priors, means, inverse Cholesky factors and log determinants of two classes."""

    log_prior: np.ndarray
    means: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for each row."""
        log_density = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.inverse[c].T
            log_density.append(self.log_prior[c] - 0.5 * (z * z).sum(axis=1) - 0.5 * self.log_det[c])
        return 1.0 / (1.0 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


class Undecided:
    """Stands in where a class has no rows."""

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5)


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(labelled: DataFrame, x_col: str = "x", label_col: str = "label", to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE) -> Discriminant | Undecided:
    """Fit on rows (x, label); only sums of x and of its products leave the executors."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col(x_col)[i] for i in range(d)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    rows = {int(r["label"]): r for r in labelled.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    if len(rows) < 2:
        return Undecided()
    n = np.array([rows[c]["n"] for c in (0, 1)], float)
    means = np.array([[rows[c][f"s{i}"] for i in range(d)] for c in (0, 1)]) / n[:, None]
    scatter = np.zeros((2, d, d))
    for c in (0, 1):
        for i, j in pairs:
            scatter[c, i, j] = scatter[c, j, i] = rows[c][f"p{i}_{j}"] - n[c] * means[c, i] * means[c, j]
    pooled = scatter.sum(axis=0) / n.sum()
    inverse, log_det = [], []
    for c in (0, 1):
        cov = (1 - to_pooled) * scatter[c] / n[c] + to_pooled * pooled
        cov = (1 - to_sphere) * cov + (to_sphere * np.trace(cov) / d + 1e-9) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(np.log(n / n.sum()), means, np.array(inverse), np.array(log_det))


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant | Undecided:
    """Fit on the labelled rows outside the held-out fold; the join moves statistics, not texts."""
    known = labels.select(F.col(id_col), F.col(label_col).alias("label")).where(F.col("label").isNotNull() & ~held_out(id_col))
    return fit(stats.join(known, id_col).select("x", "label"))


def score_column(model: Discriminant | Undecided, x: Column | str = "x") -> Column:
    @F.pandas_udf("double")
    def score(v):  # a Series of arrays
        import pandas as pd

        return pd.Series(model.scores(np.stack(v.to_numpy())) if len(v) else np.zeros(0))

    return score(x)


def text_score_column(model: Discriminant | Undecided, text: str = "text") -> Column:
    """The score straight from a text column, for filters that keep rows where they are."""

    @F.pandas_udf("double")
    def score(v):
        import pandas as pd

        return pd.Series(model.scores(np.array([statistics(t or "") for t in v])) if len(v) else np.zeros(0))

    return score(F.coalesce(F.col(text), F.lit("")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stats = materialised(statistics_of(docs, ["doc_id"]), "quality-statistics")
    model = train(stats, table(spark, sf_dir, "labels"))
    scored = stats.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
