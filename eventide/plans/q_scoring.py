"""Queries: given models over tables and grids, and parcels assigned to receptors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import physics as phys
from ..operators import forest, receptors, scoring
from .frames import DAILY, ROWS, cells, daily, rows
from .q_screens import PATH, paths


class Linear:
    """Weights and an intercept; the terms are added in order."""

    def __init__(self, weights, intercept: float) -> None:
        self.weights, self.intercept = weights, intercept

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, w in enumerate(self.weights):
            out = out + w * x[:, j]
        return out


class NearestCentre:
    """Scores of classes: minus the distance to each class's centre."""

    def __init__(self, centres) -> None:
        self.centres = np.array(centres, float)

    def predict(self, x: np.ndarray, batch_size: int = 64, verbose: int = 0) -> np.ndarray:
        return -np.abs(x[:, :1] - self.centres)


class BoxMean:
    """Mean of the known cells within a few rows and columns."""

    def __init__(self, half: int) -> None:
        self.half = half

    def predict(self, x: np.ndarray) -> np.ndarray:
        h, field = self.half, np.pad(x[..., 0], ((0, 0), (self.half,) * 2, (self.half,) * 2), constant_values=np.nan)
        known = ~np.isnan(field)
        total, n = (sum(a[:, i : i + x.shape[1], j : j + x.shape[2]] for i in range(2 * h + 1) for j in range(2 * h + 1)) for a in (np.where(known, field, 0), known.astype(int)))
        return total / np.maximum(n, 1)


@query("udf_linear_score", f"WITH {ROWS} SELECT event_id, round(0.25 + 0.5 * predictor - 0.125 * control + 2.0 * slot, 6) AS score FROM rows")
def linear_score(spark, sf_dir):
    out = scoring.score(rows(spark, sf_dir), Linear([0.5, -0.125, 2.0], 0.25), ["predictor", "control", "slot"], "score", keep=["event_id"])
    return out.withColumn("score", F.round("score", 6))


CENTRES = [5.0, 40.0, 90.0]


@query("udf_class_scores", f"""WITH {ROWS}, s AS (SELECT event_id, [-abs(predictor - 5), -abs(predictor - 40), -abs(predictor - 90)] AS s FROM rows)
SELECT event_id, CAST(list_position(s, list_max(s)) - 1 AS INT) AS class, round(list_max(s), 6) + 0.0 AS best FROM s""")
def class_scores(spark, sf_dir):
    out = scoring.score(rows(spark, sf_dir), NearestCentre(CENTRES), ["predictor"], "s", width=3, keep=["event_id"])
    return out.select("event_id", scoring.best_class("s").alias("class"), (F.round(F.array_max("s"), 6) + 0.0).alias("best"))


@query("udf_tile_score", f"""WITH {DAILY} SELECT d.day, d.lat, d.lon, round(avg(e.v), 9) AS score FROM daily d JOIN daily e ON e.day = d.day AND abs(e.lat - d.lat) <= 2 AND abs(e.lon - d.lon) <= 2 GROUP BY d.day, d.lat, d.lon""")
def tile_score(spark, sf_dir):
    """Grids of 12 by 12 cells in tiles of 5 with a halo of 2: the same as over the uncut field."""
    out = scoring.score_tiles(daily(spark, sf_dir), BoxMean(2), ["day"], "lat", "lon", ["v"], "score", tile=5, halo=2)
    return out.select("day", "lat", "lon", F.round("score", 9).alias("score"))


#: Arrivals on half degrees, so that many lie on the edges of boxes and midway between cells.
ARRIVALS = PATH + ", a AS (SELECT event_id, step % 3 AS wave, round(px / 10) / 2 AS y, round(py / 5) / 2 AS x, px * 20 AS alt FROM p), targets AS (SELECT DISTINCT CAST(lat AS INT) AS rlat, CAST(lon AS INT) AS rlon FROM rows WHERE (lat + lon) % 2 = 0)"


def arrivals(spark, sf_dir):
    half = lambda c, by: F.round(F.col(c) / by) / 2
    return paths(spark, sf_dir).select("event_id", (F.col("step") % 3).alias("wave"), half("px", 10).alias("y"), half("py", 5).alias("x"), (F.col("px") * 20).alias("alt"))


@query("trj_receptor_box", f"WITH {ARRIVALS} SELECT event_id, CAST(wave AS INT) AS wave, rlat, rlon FROM a JOIN targets ON abs(y - rlat) <= 0.5 AND abs(x - rlon) <= 0.5 WHERE alt BETWEEN 100 AND 1500")
def receptor_box(spark, sf_dir):
    """Every arrival in every box that catches it, three waves of arrivals at once."""
    targets = rows(spark, sf_dir).where("(lat + lon) % 2 = 0").select(F.col("lat").alias("rlat"), F.col("lon").alias("rlon")).distinct()
    waves = targets.withColumn("wave", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    out = receptors.within_box(arrivals(spark, sf_dir), waves, ["wave"], "y", "x", 0.5, alt="alt", band=(100, 1500))
    return out.select("event_id", "wave", "rlat", "rlon")


@query("trj_receptor_nearest", f"WITH {ARRIVALS} SELECT event_id, round_even(y, 0) AS tlat, round_even(x, 0) AS tlon FROM a WHERE alt BETWEEN 100 AND 1500 AND round_even(y, 0) BETWEEN 0 AND 8 AND round_even(x, 0) BETWEEN 0 AND 8")
def receptor_nearest(spark, sf_dir):
    return receptors.nearest_target(arrivals(spark, sf_dir), "y", "x", 0.0, 0.0, 1.0, 9, 9, alt="alt", band=(100, 1500)).select("event_id", "tlat", "tlon")


@query("trj_receptor_kernels", f"""WITH {PATH}, q AS (SELECT event_id, user_id, step, px / 20 AS y, py / 10 AS x, px * 20 AS alt, py * 15 AS depth, epoch_us(ts) / 3600000000 AS h FROM p),
n AS (SELECT user_id, max(step) AS most FROM q GROUP BY user_id), g AS (SELECT user_id, CAST(most - 1 AS INT) AS s FROM n WHERE most > 1 UNION ALL SELECT user_id, CAST(most AS INT) FROM n),
e AS (SELECT g.user_id, g.s, g.s - n.most AS wave, round_even(y, 0) AS tlat, round_even(x, 0) AS tlon FROM g JOIN n USING (user_id) JOIN q ON q.user_id = g.user_id AND q.step = g.s WHERE alt >= 100 AND round_even(y, 0) BETWEEN 0 AND 30 AND round_even(x, 0) BETWEEN 0 AND 30),
r AS (SELECT q.*, e.s, e.wave, tlat, tlon, (coalesce(h - lag(h) OVER w, 0) + coalesce(lead(h) OVER w - h, 0)) / 2 AS res, coalesce(sqrt(pow(y - lag(y) OVER w, 2) + pow(x - lag(x) OVER w, 2)), 0) AS piece, max(h) OVER (PARTITION BY q.user_id, e.s) - h AS lag_h FROM q JOIN e ON e.user_id = q.user_id AND q.step <= e.s WINDOW w AS (PARTITION BY q.user_id, e.s ORDER BY h)),
b AS (SELECT *, sum(piece) OVER (PARTITION BY user_id, s) - sum(piece) OVER (PARTITION BY user_id, s ORDER BY h) AS back FROM r),
m AS (SELECT *, 0.3 + 0.01 * back AS sg, res * CASE WHEN depth <= 0 OR alt < 0 THEN 0 WHEN alt <= depth THEN 1.0 WHEN alt >= depth * 1.2 THEN 0.0 ELSE 1 - (alt - depth) / (depth * 0.2) END AS mass FROM b WHERE lag_h <= 48),
k AS (SELECT *, CAST(CASE WHEN sg < 0.5 THEN 0 ELSE ceil(sg * 4) END AS BIGINT) AS rr FROM m WHERE mass > 0), i AS (SELECT *, CAST(round_even(y, 0) AS BIGINT) + UNNEST(range(-rr, rr + 1)) AS ilat FROM k), c AS (SELECT *, CAST(round_even(x, 0) AS BIGINT) + UNNEST(range(-rr, rr + 1)) AS ilon FROM i),
w AS (SELECT *, CASE WHEN rr = 0 THEN 1.0 WHEN pow(ilat - y, 2) + pow(ilon - x, 2) <= pow(sg * 4, 2) THEN exp(-(pow(ilat - y, 2) + pow(ilon - x, 2)) / (2 * sg * sg)) ELSE 0.0 END AS w FROM c), t AS (SELECT *, sum(w) OVER (PARTITION BY event_id, s) AS t FROM w),
z AS (SELECT CAST(wave AS INT) AS wave, tlat, tlon, CAST(round_even(lag_h / 24, 0) AS INT) AS lag, ilat, ilon, sum(mass * w / t) AS mass FROM t WHERE w > 0 GROUP BY ALL), cnt AS (SELECT CAST(wave AS INT) AS wave, tlat, tlon, count(*) AS n_parcels FROM e GROUP BY ALL)
SELECT z.wave, z.tlat, z.tlon, lag, CAST(ilat AS INT) AS ilat, CAST(ilon AS INT) AS ilon, round(mass, 6) AS mass, n_parcels FROM z JOIN cnt ON cnt.wave = z.wave AND cnt.tlat = z.tlat AND cnt.tlon = z.tlon WHERE abs(ilat - z.tlat) <= 6 AND abs(ilon - z.tlon) <= 6""")
def receptor_kernels(spark, sf_dir):
    """Kernels of every target cell for paths that arrive at their last point and at the one before it."""
    from pyspark.sql import Window

    points = paths(spark, sf_dir).select("user_id", "step", (F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0).alias("h"), (F.col("px") / 20).alias("y"), (F.col("py") / 10).alias("x"), (F.col("px") * 20).alias("alt"), (F.col("py") * 15).alias("depth"))
    wave = F.col("step") - F.max("step").over(Window.partitionBy("user_id"))
    arriving = points.withColumn("wave", wave).where("wave >= -1")
    members = receptors.nearest_target(arriving, "y", "x", 0.0, 0.0, 1.0, 31, 31, alt="alt", band=(100, float("inf")))
    out = receptors.receptor_kernels(points, members, ["user_id"], ["wave", "tlat", "tlon"], "step", "h", "y", "x", contact=phys.contact_weight(F.col("alt"), F.col("depth")), sigma=0.3 + 0.01 * F.col("back"), most_lag=48, lag_hours=24, window=6, target=("tlat", "tlon"))
    return out.select("wave", "tlat", "tlon", "lag", "ilat", "ilon", F.round("mass", 6).alias("mass"), "n_parcels")


STUMP_EDGES = [[float(e) for e in range(10, 100, 10)], [float(e) for e in range(1, 10)]]
CUTS = "SELECT UNNEST(range(10, 100, 10)) AS e, 0 AS f UNION ALL SELECT UNNEST(range(1, 10)), 1"


@query("ml_multi_stump", f"""WITH {ROWS}, s AS (SELECT event_id, predictor AS p, CAST(lat AS DOUBLE) AS l, target AS y, CAST(slot AS DOUBLE) AS z FROM rows WHERE predictor IS NOT NULL AND target IS NOT NULL),
t AS (SELECT count(*) AS n, sum(y) AS sy, sum(z) AS sz FROM s), c AS ({CUTS}),
g AS (SELECT f, e, count(*) AS ln, sum(y) AS ly, sum(z) AS lz FROM c JOIN s ON CASE WHEN f = 0 THEN p ELSE l END <= e GROUP BY f, e),
b AS (SELECT f, e, (ly * ly + lz * lz) / ln + ((sy - ly) * (sy - ly) + (sz - lz) * (sz - lz)) / (n - ln) AS gain, ly / ln AS ay, lz / ln AS az, (sy - ly) / (n - ln) AS by_, (sz - lz) / (n - ln) AS bz FROM g, t WHERE ln >= 5 AND n - ln >= 5 ORDER BY gain DESC LIMIT 1)
SELECT event_id, round(CASE WHEN CASE WHEN f = 0 THEN p ELSE l END <= e THEN ay ELSE by_ END, 6) AS y_hat, round(CASE WHEN CASE WHEN f = 0 THEN p ELSE l END <= e THEN az ELSE bz END, 6) AS z_hat FROM s, b""")
def multi_stump(spark, sf_dir):
    """A tree of one split with two targets: the split is the one that serves both best."""
    df = rows(spark, sf_dir).select("event_id", "predictor", F.col("lat").cast("double").alias("lat"), "target", F.col("slot").cast("double").alias("slot")).where("predictor IS NOT NULL AND target IS NOT NULL")
    model = forest.fit_forest(df, ["predictor", "lat"], ["target", "slot"], trees=1, depth=1, bootstrap=False, edges=STUMP_EDGES)
    return forest.predict_forest(df, model, keep=["event_id"]).select("event_id", F.round(F.col("predicted")[0], 6).alias("y_hat"), F.round(F.col("predicted")[1], 6).alias("z_hat"))


@query("ml_multi_forest")
def multi_forest(spark, sf_dir):
    """R² of held-out days for two targets of each cell and slot: one forest for both, one pooled, and one each."""
    from functools import reduce

    cell = cells(spark, sf_dir).select("day", "x", F.col("slot").cast("double").alias("slot"), F.col("lat").cast("double").alias("lat"), "y", F.col("n").cast("double").alias("n"))
    held = F.dayofmonth("day") % 4 == 0
    parts = [forest.experiment(cell, held, ["x", "slot", "lat"], ["y", "n"], mode, slot="place", trees=5, depth=4, seed=1).withColumn("mode", F.lit(mode)) for mode in ("wide", "pooled", "separate")]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("r2", F.round("r2", 6))
