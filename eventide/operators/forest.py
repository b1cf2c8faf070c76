"""Regression forests with several targets: trees grown level by level from histograms, a vector of means in each leaf.

Rows never move: in each level every task sends its rows down the trees so far (whose size is fixed by their number and depth) and
counts them by tree, node, feature and bin, with the sums of all targets; the counts meet in one aggregation, and the best split of
each node is chosen there.  What reaches the driver is one record per node.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .scoring import matrix, score

#: Numbers that the histograms of one pass may hold in a task; more trees than that take several passes.
MOST_CELLS = 4_000_000
#: Cumulative probabilities of a Poisson count of mean 1: how often a row is drawn for a tree.
DRAWN = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])


def draws(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row counts for a tree: Poisson by a hash of its id, the same in every pass."""
    z = ids.astype(np.uint64) + np.uint64((tree * 1_000_003 + seed * 7_919 + 1) % (1 << 40)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.searchsorted(DRAWN, u, side="right").astype(float)


class Tree:
    """Nodes as lists: feature (-1 in a leaf), threshold (at most goes left), children and the means of the targets."""

    def __init__(self) -> None:
        self.feature, self.threshold, self.left, self.right, self.value = [-1], [0.0], [-1], [-1], [None]

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, a, a + 1
        for _ in range(2):
            for part, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, None)):
                part.append(v)
        return a, a + 1

    def nodes_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, threshold, left, right = map(np.array, (self.feature, self.threshold, self.left, self.right))
        at, on = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            on = on[feature[at[on]] >= 0]
            if not len(on):
                return at
            own = at[on]
            at[on] = np.where(x[on, feature[own]] <= threshold[own], left[own], right[own])


class Forest:
    """Mean of its trees; ``predict`` gives a row of targets for each row of features."""

    def __init__(self, trees: Sequence[Tree], features: Sequence[str], targets: Sequence[str], gains: np.ndarray) -> None:
        self.trees, self.features, self.targets, self.gains = list(trees), list(features), list(targets), gains

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum(np.array(t.value, float)[t.nodes_of(x)] for t in self.trees) / len(self.trees)

    def importances(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits."""
        total = self.gains.sum()
        return dict(zip(self.features, (self.gains / total if total else self.gains).tolist(), strict=True))


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Candidate thresholds of each feature: approximate quantiles, from one scan."""
    cuts = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), cuts, 50 * bins).alias(f"_{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(e if e is not None else [], float)) for e in found]


def histograms(rows: DataFrame, trees: dict[int, Tree], open_: dict[int, list[int]], edges: list[np.ndarray], k: int, seed: int, bootstrap: bool) -> DataFrame:
    """(tree, node, feature, bin, n, s0 ... ): counts and sums of the rows of the open nodes."""
    n_bins, n_features = max(map(len, edges)) + 1, len(edges)
    names = ["tree", "node", "feature", "bin", "n", *[f"s{j}" for j in range(k)]]
    schema = "tree int, node int, feature int, bin int, n double, " + ", ".join(f"s{j} double" for j in range(k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {t: np.zeros((len(nodes), n_features, n_bins, 1 + k)) for t, nodes in open_.items()}
        for b in batches:
            ids, x, y = b.column("_id").to_numpy(), matrix(b, ["_x"]), matrix(b, ["_y"])
            binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
            for t, nodes in open_.items():
                place = np.full(len(trees[t].feature), -1)
                place[nodes] = np.arange(len(nodes))
                at = place[trees[t].nodes_of(x)]
                w = draws(ids, t, seed) if bootstrap else np.ones(len(ids))
                used = np.flatnonzero((at >= 0) & (w > 0))
                for f in range(n_features):
                    cell = at[used] * n_bins + binned[used, f]
                    for j in range(1 + k):
                        weight = w[used] if j == 0 else w[used] * y[used, j - 1]
                        counts[t][:, f, :, j] += np.bincount(cell, weight, len(nodes) * n_bins).reshape(-1, n_bins)
        for t, c in counts.items():
            node, feature, bin_ = np.nonzero(c[..., 0])
            own = c[node, feature, bin_]
            columns = [np.full(len(node), t), np.array(open_[t])[node] if len(node) else node, feature, bin_]
            yield pa.RecordBatch.from_arrays([*(pa.array(a, pa.int32()) for a in columns), *(pa.array(own[:, j]) for j in range(1 + k))], names=names)

    return rows.mapInArrow(run, schema).groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in names[4:]])


def best_splits(counts: DataFrame, k: int, fewest: float, share: float, seed: int) -> DataFrame:
    """(tree, node, n, total, split): per node its rows and sums, and the split that lowers the squared error of all targets most (null if none does)."""
    by = ["tree", "node", "feature"]
    upto, whole = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    sums = [f"s{j}" for j in range(k)]
    cut = counts.select(*by, "bin", F.sum("n").over(upto).alias("ln"), F.sum("n").over(whole).alias("n"), F.array(*[F.sum(s).over(upto) for s in sums]).alias("left"), F.array(*[F.sum(s).over(whole) for s in sums]).alias("total"))
    square = lambda a, n: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v) / n
    rn, right = F.col("n") - F.col("ln"), F.zip_with("total", "left", lambda t, v: t - v)
    gain = F.round(square(F.col("left"), F.col("ln")) + square(right, rn) - square(F.col("total"), F.col("n")), 9)
    drawn = F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1_000_000)) < int(share * 1_000_000)
    cut = cut.withColumn("gain", F.when((F.col("ln") >= fewest) & (rn >= fewest) & (drawn if share < 1 else F.lit(True)), gain))
    order = F.struct(F.col("gain"), -F.col("feature"), -F.col("bin"))
    split = F.when(F.col("gain") > 0, F.struct("feature", "bin", "ln", "left", "gain"))
    return cut.groupBy("tree", "node").agg(F.max("n").alias("n"), F.max_by("total", F.col("feature") * -1).alias("total"), F.max_by(split, F.when(F.col("gain") > 0, order)).alias("split"))


def fit_forest(df: DataFrame, features: Sequence[str], targets: Sequence[str], trees: int = 20, depth: int = 6, bins: int = 32, fewest: float = 5, share: float = 1.0, seed: int = 0, bootstrap: bool = True, edges: list[Sequence[float]] | None = None, key: Sequence[str] | None = None) -> Forest:
    """A forest of ``trees`` regression trees with the given targets in every leaf; rows with any missing column do not count.

    Thresholds are ``edges`` (one sorted list a feature) or about ``bins`` quantiles.  Each split may use a drawn ``share`` of the features and leaves
    at least ``fewest`` drawn rows on either side.  How often a row is drawn follows from a hash of the ``key`` columns (features and targets if not given).
    """
    arrays = lambda names: F.array(*[F.col(c).cast("double") for c in names])
    known = [*(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in dict.fromkeys([*features, *targets]))]
    usable = df
    for c in known:
        usable = usable.where(c)
    rows = written(usable.select(F.xxhash64(*(key or dict.fromkeys([*features, *targets]))).alias("_id"), arrays(features).alias("_x"), arrays(targets).alias("_y")), "forest-rows")
    edges = [np.unique(np.array(e, float)) for e in edges] if edges is not None else bin_edges(usable, features, bins)
    k, n_bins = len(targets), max(map(len, edges)) + 1
    grown, open_, gains = {t: Tree() for t in range(trees)}, {t: [0] for t in range(trees)}, np.zeros(len(features))
    for level in range(depth + 1):
        following: dict[int, list[int]] = {}
        for group in passes(open_, n_bins * len(features) * (1 + k)):
            counts = histograms(rows, {t: grown[t] for t in group}, {t: open_[t] for t in group}, edges, k, seed, bootstrap)
            for r in best_splits(counts, k, fewest, share, seed).collect():  # one record a node
                tree, s = grown[r["tree"]], r["split"]
                tree.value[r["node"]] = [v / r["n"] for v in r["total"]]
                if s is None or level == depth:
                    continue
                a, b = tree.split(r["node"], s["feature"], float(edges[s["feature"]][s["bin"]]))
                tree.value[a] = [v / s["ln"] for v in s["left"]]
                tree.value[b] = [(t - v) / (r["n"] - s["ln"]) for t, v in zip(r["total"], s["left"], strict=True)]
                gains[s["feature"]] += s["gain"]
                following.setdefault(r["tree"], []).extend((a, b))
        open_ = {t: sorted(n) for t, n in sorted(following.items())}
        if not open_ or level + 1 == depth:  # the last level's means are known already
            break
    if any(t.value[0] is None for t in grown.values()):
        if rows.isEmpty():
            raise ValueError("no complete row to fit a forest on")
        mean = rows.agg(*[F.avg(F.col("_y")[j]) for j in range(k)]).first()  # a tree that drew no row
        for t in grown.values():
            t.value[0] = list(mean) if t.value[0] is None else t.value[0]
    return Forest(list(grown.values()), features, targets, gains)


def passes(open_: dict[int, list[int]], cells: int) -> Iterator[list[int]]:
    """Trees in groups whose histograms fit into one task."""
    group, held = [], 0
    for t, nodes in open_.items():
        if group and held + len(nodes) * cells > MOST_CELLS:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(nodes) * cells
    if group:
        yield group


def predict_forest(df: DataFrame, forest: Forest, out: str = "predicted", keep: Sequence[str] | None = None) -> DataFrame:
    """Adds the forest's targets as an array; null where a feature is missing."""
    return score(df, forest, forest.features, out, width=len(forest.targets), keep=keep)


def r_squared_of(df: DataFrame, targets: Sequence[str], predicted: str = "predicted") -> DataFrame:
    """(target, n, r2) of an array of predictions against the targets' columns, from one scan."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"), F.get(predicted, F.lit(i)).alias("p")) for i, t in enumerate(targets)])
    rows = df.select(F.explode(pairs).alias("_r")).select("_r.*").where("y IS NOT NULL AND p IS NOT NULL AND NOT isnan(y) AND NOT isnan(p)")
    error, spread = F.sum((F.col("y") - F.col("p")) ** 2), F.var_pop("y") * F.count("y")
    return rows.groupBy("target").agg(F.count("y").alias("n"), (1 - error / F.nullif(spread, F.lit(0.0))).alias("r2"))


def experiment(df: DataFrame, is_test: Column, features: Sequence[str], targets: Sequence[str], mode: str = "wide", slot: str = "slot", **options) -> DataFrame:
    """(target, n, r2) on held-out rows, for one row per sample with the features and one target column per slot.

    ``wide``: one forest with all targets.  ``pooled``: one forest over a row per sample and slot, the slot's number being one more
    feature.  ``separate``: one forest for each target.
    """
    rows = written(df.select(*dict.fromkeys([*features, *targets]), F.coalesce(is_test, F.lit(False)).alias("_test")), "experiment")
    train, test = rows.where("NOT _test"), rows.where("_test")
    if mode == "wide":
        return r_squared_of(predict_forest(test, fit_forest(train, features, targets, **options)), targets)
    if mode == "separate":
        parts = [r_squared_of(predict_forest(test, fit_forest(train, features, [t], **options)), [t]) for t in targets]
        return functools.reduce(DataFrame.unionByName, parts)
    if mode != "pooled":
        raise ValueError("mode is wide, pooled or separate")
    long = lambda d: d.select(*features, F.posexplode(F.array(*[F.col(t).cast("double") for t in targets])).alias(slot, "_y"))
    forest = fit_forest(long(train), [*features, slot], ["_y"], **options)
    found = predict_forest(long(test), forest)
    wide = found.select(F.element_at(F.array(*map(F.lit, targets)), F.col(slot) + 1).alias("target"), "_y", "predicted")
    error, spread = F.sum((F.col("_y") - F.col("predicted")[0]) ** 2), F.var_pop("_y") * F.count("_y")
    return wide.where("_y IS NOT NULL AND predicted IS NOT NULL").groupBy("target").agg(F.count("_y").alias("n"), (1 - error / F.nullif(spread, F.lit(0.0))).alias("r2"))

