"""Queries: projections, features, guards, the base table end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import also, query
from ..operators import features, inference, ml, screens, skill, thresholds, trajectory, windows
from ..sources.scratch import written
from .frames import CELLS, DAILY, ROWS, cells, daily, load, rows
from .q_inference import KERNEL, kernel
from .q_skill import FLAGGED, flagged, gini_sql


@query("prj_derived_columns", f"""WITH {ROWS} SELECT event_id, round(predictor * slot / 81, 6) AS grid_mean, predictor - control AS difference, lon < 6 AS is_west, slot >= 3 AS is_late, CASE WHEN month(day) IN (12, 1, 2) THEN 'DJF' WHEN month(day) IN (3, 4, 5) THEN 'MAM' WHEN month(day) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season FROM rows""")
def derived(spark, sf_dir):
    return rows(spark, sf_dir).select("event_id", F.round(features.grid_mean(F.col("predictor"), F.col("slot")), 6).alias("grid_mean"), (F.col("predictor") - F.col("control")).alias("difference"), (F.col("lon") < 6).alias("is_west"), (F.col("slot") >= 3).alias("is_late"), features.season(F.month("day")).alias("season"))


@query("prj_category_shares", f"""WITH {ROWS}, s AS (SELECT lat, lon, sum(control) - coalesce(sum(control) FILTER (WHERE event_type IN ('error', 'signup')), 0) AS classified, coalesce(sum(control) FILTER (WHERE event_type = 'view'), 0) AS v, coalesce(sum(control) FILTER (WHERE event_type = 'click'), 0) AS c FROM rows GROUP BY lat, lon)
SELECT lat, lon, classified, round(CASE WHEN classified > 0 THEN v / classified END, 6) AS frac_view, round(CASE WHEN classified > 0 THEN c / classified END, 6) AS frac_click, round(CASE WHEN v + c > 0 THEN v / (v + c) END, 6) AS share_view, round(CASE WHEN v + c > 0 THEN c / (v + c) END, 6) AS share_click FROM s""")
def category_shares(spark, sf_dir):
    out = features.category_shares(rows(spark, sf_dir), ["lat", "lon"], "event_type", "control", ["view", "click"], ["error", "signup"])
    return out.withColumns({c: F.round(c, 6) for c in ("frac_view", "frac_click", "share_view", "share_click")})


@query("prj_first_true", f"WITH {ROWS} SELECT event_id, CASE WHEN predictor > 150 THEN 'cold' WHEN control > 80 THEN 'warm' WHEN slot = 0 THEN 'night' ELSE 'none' END AS class FROM rows")
def first_true(spark, sf_dir):
    return rows(spark, sf_dir).select("event_id", features.first_true({"cold": F.col("predictor") > 150, "warm": F.col("control") > 80, "night": F.col("slot") == 0}).alias("class"))


@query("flt_complete_samples", "SELECT o_orderkey, n FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS p, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice) WHERE p IS NOT NULL AND n IS NOT NULL")
def complete_samples(spark, sf_dir):
    n = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    df = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("p")).join(n, "o_orderkey", "left").fillna(0, ["n"])
    return features.complete_samples(df, ["p", "n"]).select("o_orderkey", "n")


LEVEL_MIXING = """WITH e AS (SELECT vec_id, i, CASE WHEN i % 7 <> 0 THEN CAST(embedding[i] AS DOUBLE) END AS v FROM embeddings, (SELECT UNNEST(range(1, 65)) AS i)), w AS (SELECT a.vec_id, a.i, sum(CASE WHEN b.i = a.i THEN 2.0 ELSE 1.0 END * b.v) / sum(CASE WHEN b.v IS NOT NULL THEN CASE WHEN b.i = a.i THEN 2.0 ELSE 1.0 END END) AS m FROM e a JOIN e b ON a.vec_id = b.vec_id AND abs(a.i - b.i) <= 1 GROUP BY ALL)
SELECT vec_id, i - 1 AS level, round(m, 6) AS mixed FROM w"""


@query("grd_level_mixing", LEVEL_MIXING)
def level_mixing(spark, sf_dir):
    """All 64 levels of each profile."""
    levels = 64
    weights = [[(j, 2.0 if j == i else 1.0) for j in range(max(0, i - 1), min(levels, i + 2))] for i in range(levels)]
    df = load(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding"), lambda v, i: F.when((i + 1) % 7 != 0, v.cast("double"))).alias("p"))
    mixed = features.mix_levels(df, "p", weights, "m").select("vec_id", F.posexplode("m").alias("level", "mixed"))
    return mixed.select("vec_id", F.col("level").cast("long").alias("level"), F.round("mixed", 6).alias("mixed"))


also("grd_level_mixing", "grd_level_mixing_whole")


@query("trj_influence", f"""WITH {ROWS}, f AS (SELECT lat, lon, lag, sum(predictor) AS mass, max(control * 20) AS depth, count(*) AS n FROM (SELECT *, slot AS lag FROM rows) GROUP BY ALL), p AS (SELECT lat, lon, sum(mass * 3600) / max(n) AS phi, 1.1 * max(depth) AS m_star FROM f GROUP BY lat, lon)
SELECT lat, lon, round(phi, 4) AS phi, round(m_star, 6) AS m_star, round(phi / m_star, 6) AS omega FROM p""")
def influence(spark, sf_dir):
    f = rows(spark, sf_dir).groupBy("lat", "lon", "slot").agg(F.sum("predictor").alias("mass"), F.max(F.col("control") * 20).alias("depth"), F.count(F.lit(1)).alias("n"))
    return features.influence(f, ["lat", "lon"], "mass", F.col("n"), "depth").select("lat", "lon", F.round("phi", 4).alias("phi"), F.round("m_star", 6).alias("m_star"), F.round("omega", 6).alias("omega"))


@query("trj_feature_table", f"""WITH {KERNEL}, s AS (SELECT lat, lon, sum(raw) AS total, sum(raw * lag) / sum(raw) AS mean_lag FROM k GROUP BY lat, lon), v AS (SELECT lat, lon, avg(control) AS surface FROM rows WHERE slot = 0 GROUP BY lat, lon)
SELECT lat, lon, round(total, 5) AS total, round(mean_lag, 6) AS mean_lag, round(surface, 6) AS surface FROM s LEFT JOIN v USING (lat, lon)""")
def feature_table(spark, sf_dir):
    shape = trajectory.kernel_shape(kernel(spark, sf_dir), ["lat", "lon"], "raw", "dlat", "dlon", "lag").select("lat", "lon", "total", "mean_lag")
    surface = rows(spark, sf_dir).where("slot = 0").groupBy("lat", "lon").agg(F.avg("control").alias("surface"))
    return shape.join(surface, ["lat", "lon"], "left").select("lat", "lon", F.round("total", 5).alias("total"), F.round("mean_lag", 6).alias("mean_lag"), F.round("surface", 6).alias("surface"))


@query("trj_mass_region", f"""WITH {KERNEL}, d AS (SELECT lat, lon, lag, dlat, dlon, CAST(round(raw * 100) AS BIGINT) AS w, abs(dlat) * 10 + abs(dlon) AS dist FROM k), b AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY lat, lon ORDER BY dist RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (PARTITION BY lat, lon) AS t FROM d)
SELECT lat, lon, lag, dlat, dlon FROM b WHERE before < 0.5 * t""")
def mass_region(spark, sf_dir):
    k = kernel(spark, sf_dir).select("lat", "lon", "lag", "dlat", "dlon", F.round(F.col("raw") * 100).cast("double").alias("w"), (F.abs("dlat") * 10 + F.abs("dlon")).cast("double").alias("dist"))
    return trajectory.mass_region(k, ["lat", "lon"], "w", "dist", 0.5).select("lat", "lon", "lag", "dlat", "dlon")


@query("trj_gap_features", f"""WITH {DAILY}, c AS (SELECT lat, lon, avg(v) AS m FROM daily GROUP BY lat, lon) SELECT day, lat, lon, round(120 - v, 6) AS gap, round(v - m, 8) AS depth_anomaly FROM daily JOIN c USING (lat, lon)""")
def gap_features(spark, sf_dir):
    d = daily(spark, sf_dir)
    m = d.groupBy("lat", "lon").agg(F.avg("v").alias("m"))
    return d.join(m, ["lat", "lon"]).select("day", "lat", "lon", F.round(120 - F.col("v"), 6).alias("gap"), F.round(F.col("v") - F.col("m"), 8).alias("depth_anomaly"))


@query("jn_nearest_cell_mask", f"WITH {ROWS}, m AS (SELECT DISTINCT CAST(round_even(predictor / 30, 0) AS INT) AS ilat, CAST(round_even(control / 30, 0) AS INT) AS ilon FROM rows WHERE event_type = 'error') SELECT event_id, m.ilat IS NOT NULL AS on_land FROM rows LEFT JOIN m ON m.ilat = CAST(round_even(predictor / 30, 0) AS INT) AND m.ilon = CAST(round_even(control / 30, 0) AS INT)")
def nearest_cell(spark, sf_dir):
    df = features.nearest_cell(rows(spark, sf_dir), "predictor", "control", 30)
    mask = df.where("event_type = 'error'").select("ilat", "ilon").distinct().withColumn("_m", F.lit(True))
    return df.join(mask, ["ilat", "ilon"], "left").select("event_id", F.col("_m").isNotNull().alias("on_land"))


@query("src_calendar_skeleton", f"WITH {DAILY}, d AS (SELECT DISTINCT day FROM daily), c AS (SELECT DISTINCT lat, lon FROM daily) SELECT d.day, c.lat, c.lon, n FROM d CROSS JOIN c LEFT JOIN daily USING (day, lat, lon)")
def skeleton(spark, sf_dir):
    d = daily(spark, sf_dir)
    return features.on_skeleton(d.select("day", "lat", "lon", "n"), [d.select("lat", "lon").distinct(), d.select("day").distinct()], ["day", "lat", "lon"]).select("day", "lat", "lon", "n")


@query("grd_hull", f"""WITH {DAILY}, p AS (SELECT day, lat, lon FROM daily WHERE v > 120), x AS (SELECT day, min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM p GROUP BY day),
e AS (SELECT a.day, a.lat AS ai, a.lon AS aj, b.lat AS bi, b.lon AS bj FROM p a JOIN p b ON a.day = b.day AND (a.lat <> b.lat OR a.lon <> b.lon) JOIN p c ON c.day = a.day GROUP BY ALL HAVING min((b.lat - a.lat) * (c.lon - a.lon) - (b.lon - a.lon) * (c.lat - a.lat)) >= 0),
i AS (SELECT day, o0, o1, UNNEST(range(a0, a1 + 1)) AS lat FROM x), c AS (SELECT day, lat, UNNEST(range(o0, o1 + 1)) AS lon FROM i)
SELECT day, CAST(lat AS INT) AS lat, CAST(lon AS INT) AS lon FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.day = c.day AND (bi - ai) * (c.lon - aj) - (bj - aj) * (c.lat - ai) < 0)""")
def hull(spark, sf_dir):
    return features.hull_cells(daily(spark, sf_dir).where("v > 120"), ["day"], "day date")


@query("ver_pooled_legs", f"""WITH {ROWS}, l AS (SELECT event_type || '_fold' || slot AS name, slot % 2 AS km, avg(predictor) AS csi, CASE WHEN event_type = 'view' THEN 'd' || slot ELSE 'd' END AS digest FROM rows GROUP BY ALL), p AS (SELECT regexp_replace(name, '_fold[0-9]+$', '') AS leg, km, count(*) AS n, avg(csi) AS csi, count(DISTINCT digest) <= 1 AS same_sample FROM (SELECT l.* FROM l) GROUP BY 1, 2)
SELECT leg, km, n, CASE WHEN same_sample THEN round(csi, 6) END AS csi, same_sample FROM p""".replace("|| slot AS name, slot % 2 AS km, avg(predictor) AS csi, CASE WHEN event_type = 'view' THEN 'd' || slot ELSE 'd' END AS digest FROM rows GROUP BY ALL", "|| slot AS name, slot % 2 AS km, avg(predictor) AS csi, CASE WHEN event_type = 'view' THEN 'd' || slot ELSE 'd' END AS digest FROM rows GROUP BY event_type, slot"))
def pooled_legs(spark, sf_dir):
    legs = rows(spark, sf_dir).groupBy("event_type", "slot").agg(F.avg("predictor").alias("csi"))
    legs = legs.select(F.concat("event_type", F.lit("_fold"), F.col("slot").cast("string")).alias("name"), (F.col("slot") % 2).alias("km"), "csi", F.when(F.col("event_type") == "view", F.concat(F.lit("d"), F.col("slot").cast("string"))).otherwise("d").alias("digest"))
    return features.pooled_legs(legs, "name", "_fold[0-9]+$", ["km"], "csi", "digest").withColumn("csi", F.round("csi", 6))


@query("top_seeded_folds", f"WITH {ROWS} SELECT event_id, CAST(CAST('0x' || substr(md5('5:' || day), 1, 8) AS BIGINT) % 4 AS INT) AS fold FROM rows")
def seeded_folds(spark, sf_dir):
    return features.seeded_folds(rows(spark, sf_dir), "day", 4, 5).select("event_id", "fold")


@query("skill_by_period", f"WITH {FLAGGED.replace('predictor AS value', 'predictor AS value, CAST(day(day) // 8 AS INT) AS period')}, {gini_sql('period', 'flagged')} SELECT * FROM gini")
def by_period(spark, sf_dir):
    df = flagged(spark, sf_dir).withColumn("period", F.expr("CAST(dayofmonth(day) div 8 AS INT)"))
    return skill.gini(df, "predictor", "flag", ["period"]).withColumn("gini", F.round("gini", 6))


@query("agg_admissible_periods", f"WITH {ROWS} SELECT month(day) AS period, bool_or(CASE WHEN predictor > 480 THEN predictor END IS NOT NULL) AS admissible, count(DISTINCT day) AS n_days FROM rows GROUP BY 1")
def admissible(spark, sf_dir):
    return rows(spark, sf_dir).groupBy(F.month("day").cast("long").alias("period")).agg(F.bool_or(F.when(F.col("predictor") > 480, F.col("predictor")).isNotNull()).alias("admissible"), F.countDistinct("day").alias("n_days"))


@query("clm_base_table", f"""WITH {CELLS}, t AS (SELECT quantile_cont(y, 0.9) AS q FROM cells WHERE lat >= 2), p AS (SELECT a.*, b.x AS ante FROM cells a LEFT JOIN (SELECT day, lat, lon, avg(x) AS x FROM cells WHERE slot < 3 GROUP BY ALL) b ON b.lat = a.lat AND b.lon = a.lon AND b.day = a.day - 1)
SELECT day, slot, lat, lon, round(x, 6) AS x, round(ante, 6) AS ante, y > q AS flag FROM p, t WHERE lat >= 2 AND x < 150""")
def base_table(spark, sf_dir):
    """Thresholds come from the unscreened rows of the domain, flags go to the screened ones; antecedent values are joined by calendar day."""
    df = cells(spark, sf_dir)
    (q,) = thresholds.percentile_thresholds(df.where("lat >= 2"), "y", [90])
    pre = df.where("slot < 3").groupBy("day", "lat", "lon").agg(F.avg("x").alias("ante")).withColumn("day", F.date_add("day", 1))
    joined = df.join(pre, ["day", "lat", "lon"], "left")
    out = screens.apply_screens(joined, {"land": F.col("lat") >= 2, "low": F.col("x") < 150})
    return out.select("day", "slot", "lat", "lon", F.round("x", 6).alias("x"), F.round("ante", 6).alias("ante"), thresholds.exceeds("y", q).alias("flag"))


@query("inf_hourly_significance")
def hourly_significance(spark, sf_dir):
    """Gini per slot and the difference that two slots need to differ (resampled to the size of one slot)."""
    out = inference.stratum_significance(flagged(spark, sf_dir), "predictor", "flag", "slot", "day", "event_id", 6)
    return out.withColumn("gini", F.round("gini", 6))


@query("ml_hour_matched")
def hour_matched(spark, sf_dir):
    """One forest per slot, each scored on its own held-out rows."""
    df = rows(spark, sf_dir).select("event_id", "slot", "predictor", "control", "target")
    df = written(df, "slots")
    out = None
    for s in range(6):
        own = df.where(F.col("slot") == s)
        model = ml.forest_fit(own.where("event_id % 4 <> 0"), ["predictor", "control"], "target", 8, 5)
        r = skill.r_squared(model.transform(ml.assemble(own.where("event_id % 4 = 0"), ["predictor", "control"])), "target", "predicted", ["slot"])
        out = r if out is None else out.unionByName(r)
    return out.withColumn("r2", F.round("r2", 3))


@query("win_smoothed_path", f"""WITH {CELLS}, s AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM cells WINDOW w AS (PARTITION BY day, lat, lon ORDER BY slot)) SELECT day, slot, lat, lon, round(CASE WHEN a IS NULL OR b IS NULL THEN x ELSE 0.25 * a + 0.5 * x + 0.25 * b END, 6) AS smooth FROM s""")
def smoothed(spark, sf_dir):
    return windows.smooth3(cells(spark, sf_dir), ["day", "lat", "lon"], "slot", "x", "smooth").select("day", "slot", "lat", "lon", F.round("smooth", 6).alias("smooth"))
