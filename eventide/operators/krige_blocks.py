"""Kriging of one field too large for a task: conjugate gradients whose products and local solutions are Spark tasks.

The weights of all known points solve one dense system, which is never formed.  Each iteration multiplies by the distances in blocks of rows,
one task a block, and is sped up by overlapping tiles: every tile solves its own points and a margin around them exactly (its inverse is
computed once and written), and a thinned set of points over the whole field carries the large scale.  The weights are the same as those
of the dense system; an iteration that does not get there is an error.

Points and weights are a few numbers for each known point and are broadcast; their number is checked first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Known points that may be broadcast: three doubles each.
MOST_POINTS = 2_000_000
#: Points of a tile, its margin as a share of its sides, points of the thinned set.
TILE, MARGIN, COARSE = 700, 0.35, 900
TOLERANCE, ROUNDS = 1e-11, 400


def boxes(xy: np.ndarray, most: int) -> list[np.ndarray]:
    """Positions of the points of each tile: halves at the median of the longer side until a tile is small enough."""
    out, stack = [], [np.arange(len(xy))]
    while stack:
        idx = stack.pop()
        if len(idx) <= most:
            out.append(idx)
            continue
        side = int(np.ptp(xy[idx], axis=0).argmax())
        order = idx[np.argsort(xy[idx, side], kind="stable")]
        stack += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt((a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2)


def local_inverse(xy: np.ndarray) -> np.ndarray:
    """Minus the distances, inverted among weights that sum to nothing."""
    n = len(xy)
    a = np.ones((n + 1, n + 1))
    a[:n, :n] = distances(xy, xy)
    a[n, n] = 0
    return -np.linalg.inv(a)[:n, :n]


class Solver:
    """The distributed system of one field's known points, which stand in the order of their tiles."""

    def __init__(self, spark: SparkSession, xy: np.ndarray, tile: int = TILE) -> None:
        parts = boxes(xy, tile)
        self.spark, self.order, self.n = spark, np.concatenate(parts), len(xy)
        self.xy = xy[self.order]
        ends = np.cumsum([len(p) for p in parts])
        self.spans = spark.createDataFrame([(i, int(e - len(p)), int(e)) for i, (p, e) in enumerate(zip(parts, ends, strict=True))], "tile int, a int, b int").repartition(max(1, min(len(parts), 4 * spark.sparkContext.defaultParallelism)), "tile")
        self.points = spark.sparkContext.broadcast(self.xy)
        thinned = spark.createDataFrame([(-1, 0, self.n)], "tile int, a int, b int")
        self.tiles = written(self.spans.unionByName(thinned).mapInArrow(self._tile_maker(), "tile int, members binary, inverse binary"), "krige-tiles")

    def _tile_maker(self) -> Callable:
        points = self.points

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            xy = points.value
            for batch in batches:
                for t, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    low, high = xy[a:b].min(axis=0), xy[a:b].max(axis=0)
                    margin = MARGIN * (high - low) + 1e-12
                    if t < 0:  # the thinned set
                        members = np.sort(np.random.default_rng(0).permutation(b)[:COARSE])
                    else:
                        members = np.flatnonzero(((xy >= low - margin) & (xy <= high + margin)).all(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([members.astype(np.int32).tobytes()], pa.binary()), pa.array([local_inverse(xy[members]).tobytes()], pa.binary())], names=["tile", "members", "inverse"])

        return run

    def product(self, x: np.ndarray) -> np.ndarray:
        """All distances times a vector, a block of rows in each task."""
        points, sent = self.points, self.spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            xy, x = points.value, sent.value
            for batch in batches:
                for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                    y = sum(distances(xy[a:b], xy[c : c + 4096]) @ x[c : c + 4096] for c in range(0, len(xy), 4096))
                    yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([y.tobytes()], pa.binary())], names=["a", "y"])

        out = np.empty(self.n)
        for r in self.spans.mapInArrow(run, "a int, y binary").collect():  # one number a point
            y = np.frombuffer(r["y"])
            out[r["a"] : r["a"] + len(y)] = y
        sent.unpersist()
        return out

    def corrected(self, rest: np.ndarray) -> np.ndarray:
        """The sum of all tiles' solutions for a residual, and of the thinned set's."""
        sent = self.spark.sparkContext.broadcast(rest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for members, inverse in zip(batch.column("members"), batch.column("inverse"), strict=True):
                    at = np.frombuffer(members.as_buffer(), np.int32)
                    y = np.frombuffer(inverse.as_buffer()).reshape(len(at), -1) @ sent.value[at]
                    yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["members", "y"])

        out = np.zeros(self.n)
        for r in self.tiles.select("members", "inverse").mapInArrow(run, "members binary, y binary").collect():
            out[np.frombuffer(r["members"], np.int32)] += np.frombuffer(r["y"])
        sent.unpersist()
        return out

    def weights(self, v: np.ndarray, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, float, int]:
        """(weights, constant, iterations) with distances * weights + constant = v and weights that sum to nothing."""
        v = v[self.order]
        centred = lambda x: x - x.mean()
        dot = lambda a, b: float((a * b).sum())
        c, rest = np.zeros(self.n), -centred(v)
        z = centred(self.corrected(rest))
        step, size = z.copy(), dot(rest, z)
        least = tolerance * max(dot(rest, rest) ** 0.5, 1e-300)
        for done in range(rounds + 1):
            if dot(rest, rest) ** 0.5 <= least:
                return c, float((v - self.product(c)).mean()), done
            image = -centred(self.product(step))
            length = size / dot(step, image)
            c, rest = c + length * step, rest - length * image
            z = centred(self.corrected(rest))
            size, before = dot(rest, z), size
            step = z + size / before * step
        raise ArithmeticError(f"kriging weights of {self.n} points have not converged in {rounds} iterations: residual {dot(rest, rest) ** 0.5:.3g}, wanted {least:.3g}")


def fill_large(field: DataFrame, lat: str, lon: str, value: str, tile: int = TILE, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """The field's rows with ``filled``: known values as they are, gaps by ordinary kriging (linear variogram) from all known points.

    Known values at one place are averaged.  From fewer than ten points gaps take their mean, from none they stay null; a gap at a known place takes that place's
    value.  A field of more than ``MOST_POINTS`` known places is an error: cut it into fields first.
    """
    spark = field.sparkSession
    known = field.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x")).agg(F.avg(F.col(value).cast("double")).alias("v")).where("y IS NOT NULL AND x IS NOT NULL")
    known = written(known, "krige-known")
    n = known.count()
    if n > MOST_POINTS:
        raise ValueError(f"{n} known places, more than {MOST_POINTS}")
    own = F.when(~F.isnan(value), F.col(value).cast("double"))
    if n < 10:
        mean = known.agg(F.avg("v").alias("_mean"))
        return field.crossJoin(F.broadcast(mean)).withColumn("filled", F.coalesce(own, F.col("_mean"))).drop("_mean")
    p = known.orderBy("y", "x").toPandas()  # at most MOST_POINTS rows
    solver = Solver(spark, p[["y", "x"]].to_numpy(), tile)
    c, m, _ = solver.weights(p["v"].to_numpy(), tolerance, rounds)
    points, sent = solver.points, spark.sparkContext.broadcast(c)
    names = field.columns
    source = field.select(*names, own.alias("_own"), F.col(lat).cast("double").alias("_y"), F.col(lon).cast("double").alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xy, c = points.value, sent.value
        for b in batches:
            out = b.column("_own").to_numpy(zero_copy_only=False).astype(float)
            at = np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("_y", "_x")])
            gaps = np.flatnonzero(np.isnan(out) & ~np.isnan(at).any(axis=1))
            for part in np.array_split(gaps, max(1, -(-len(gaps) // 512))):
                out[part] = m + sum(distances(at[part], xy[k : k + 4096]) @ c[k : k + 4096] for k in range(0, len(xy), 4096))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out, mask=np.isnan(out))], names=[*names, "filled"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return source.mapInArrow(run, StructType([*field.schema.fields, StructField("filled", DoubleType())]))
