"""Queries: grouped statistics, set operations, ranking and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import also, query
from ..operators import aggregates as agg
from ..operators import rank, windows
from .frames import CELLS, DAILY, ROWS, cells, daily, load, rows

CELL_DAY = ["day", "lat", "lon"]


@query("agg_count_events", f"WITH {ROWS} SELECT lat, lon, count(*) AS n_hours, count(DISTINCT day) AS n_days, max(target) AS largest FROM rows WHERE target >= 2000 GROUP BY lat, lon")
def count_events(spark, sf_dir):
    return agg.count_events(rows(spark, sf_dir), ["lat", "lon"], "target", 2000)


@query("agg_stats_by_group", f"""WITH {ROWS}, g AS (SELECT variable, grp AS "group", value FROM rows, LATERAL (VALUES ('predictor', predictor), ('control', control)) v(variable, value),
LATERAL (VALUES ('all', true), ('event_day', target > 1000), ('event_hour', target > 4000)) m(grp, inside) WHERE inside)
SELECT variable, "group", count(value) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS sd, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM g GROUP BY ALL""")
def stats_by_group(spark, sf_dir):
    out = agg.stats_by_group(rows(spark, sf_dir), ["predictor", "control"], {"all": F.lit(True), "event_day": F.col("target") > 1000, "event_hour": F.col("target") > 4000}, [0.25, 0.75])
    return out.select("variable", "group", "n", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), F.round(F.col("q")[0], 6).alias("q25"), F.round(F.col("q")[1], 6).alias("q75"))


@query("agg_additive_climatology", f"WITH {ROWS} SELECT slot, lat, lon, count(predictor) AS n_obs, count(DISTINCT day) AS n_times, round(avg(predictor), 6) AS mean, round(stddev_samp(predictor), 4) AS sd FROM rows GROUP BY slot, lat, lon")
def climatology(spark, sf_dir):
    """Two disjoint halves are aggregated apart and merged, as yearly partials are."""
    df, keys = rows(spark, sf_dir), ["slot", "lat", "lon"]
    halves = [agg.additive_climatology(df.where(c), keys, "predictor", "day") for c in ("day < date'2024-01-16'", "day >= date'2024-01-16'")]
    out = agg.climatology_moments(agg.merge_climatologies(halves, keys))
    return out.select(*keys, "n_obs", "n_times", F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"))


@query("agg_coarsen_3h", f"WITH {ROWS} SELECT day, hour(ts) // 3 AS step, lat // 4 AS ilat, lon // 4 AS ilon, round(avg(predictor), 6) AS v, count(predictor) AS n FROM rows GROUP BY ALL HAVING count(predictor) >= 2")
def coarsen(spark, sf_dir):
    out = rows(spark, sf_dir).groupBy("day", F.expr("CAST(hour(ts) div 3 AS BIGINT)").alias("step"), F.expr("CAST(lat div 4 AS INT)").alias("ilat"), F.expr("CAST(lon div 4 AS INT)").alias("ilon"))
    return out.agg(F.round(F.avg("predictor"), 6).alias("v"), F.count("predictor").alias("n")).where("n >= 2")


@query("agg_baseline_anomaly", f"""WITH {CELLS}, b AS (SELECT slot, lat, lon, avg(x) AS m, stddev_samp(x) AS s, count(x) AS n FROM cells GROUP BY ALL HAVING count(x) >= 5)
SELECT day, slot, lat, lon, round((x - m) / nullif(s, 0), 5) AS anomaly FROM cells LEFT JOIN b USING (slot, lat, lon)""")
def baseline_anomaly(spark, sf_dir):
    df, keys = cells(spark, sf_dir), ["slot", "lat", "lon"]
    base = df.groupBy(*keys).agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.count("x").alias("c")).where("c >= 5")
    return df.join(base, keys, "left").select("day", "slot", "lat", "lon", F.round((F.col("x") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)), 5).alias("anomaly"))


WIDE = CELLS + ", wide AS (SELECT day, lat, lon, " + ", ".join(f"max(x) FILTER (WHERE slot = {s}) AS x_h{s}" for s in range(6)) + " FROM cells GROUP BY ALL)"


@query("agg_slots_wide", f"WITH {WIDE} SELECT day, lat, lon, {', '.join(f'round(x_h{s}, 6) AS x_h{s}' for s in range(6))} FROM wide")
def slots_wide(spark, sf_dir):
    return agg.slots_wide(cells(spark, sf_dir), CELL_DAY, ["x"], range(6)).select(*CELL_DAY, *[F.round(f"x_h{s}", 6).alias(f"x_h{s}") for s in range(6)])


@query("agg_slots_long", f"WITH {CELLS}, s AS (SELECT UNNEST([0, 1, 2, 3, 4, 5]) AS slot), k AS (SELECT DISTINCT day, lat, lon FROM cells) SELECT k.day, k.lat, k.lon, s.slot, round(x, 6) AS x FROM k CROSS JOIN s LEFT JOIN cells c ON c.day = k.day AND c.lat = k.lat AND c.lon = k.lon AND c.slot = s.slot")
def slots_long(spark, sf_dir):
    out = agg.slots_long(agg.slots_wide(cells(spark, sf_dir), CELL_DAY, ["x"], range(6)), CELL_DAY, ["x"], range(6))
    return out.select(*CELL_DAY, "slot", F.round("x", 6).alias("x"))


@query("agg_norm_stats", f"WITH {ROWS} SELECT 'predictor' AS variable, min(predictor) AS low, max(predictor) AS high, round(avg(predictor), 6) AS mean, round(stddev_pop(predictor), 5) AS sd FROM rows UNION ALL SELECT 'control', min(control), max(control), round(avg(control), 6), round(stddev_pop(control), 5) FROM rows")
def norm_stats(spark, sf_dir):
    return agg.norm_stats(rows(spark, sf_dir), ["predictor", "control"]).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 5)})


@query("prj_standardised", f"WITH {ROWS}, s AS (SELECT avg(predictor) AS m, stddev_pop(predictor) AS d, min(control) AS a, max(control) AS b FROM rows) SELECT event_id, round((predictor - m) / d, 5) AS z, round((control - a) / (b - a), 6) AS u FROM rows, s")
def standardised(spark, sf_dir):
    """Frozen statistics, a few numbers, applied as a one-row broadcast."""
    df = rows(spark, sf_dir)
    s = df.agg(F.avg("predictor").alias("m"), F.stddev_pop("predictor").alias("d"), F.min("control").alias("a"), F.max("control").alias("b"))
    return df.crossJoin(F.broadcast(s)).select("event_id", F.round((F.col("predictor") - F.col("m")) / F.col("d"), 5).alias("z"), F.round((F.col("control") - F.col("a")) / (F.col("b") - F.col("a")), 6).alias("u"))


@query("agg_class_weights", f"WITH {ROWS}, c AS (SELECT event_type, count(*) AS n FROM rows GROUP BY 1) SELECT event_type, n, round((1 / sqrt(n)) / (SELECT avg(1 / sqrt(n)) FROM c), 6) AS weight FROM c")
def class_weights(spark, sf_dir):
    return agg.class_weights(rows(spark, sf_dir), "event_type").withColumn("weight", F.round("weight", 6))


@query("agg_confusion", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def confusion(spark, sf_dir):
    return agg.confusion(load(spark, sf_dir, "labels"), "quality", "toxic")


@query("agg_digest", "SELECT sha1(string_agg(k, '|' ORDER BY k)) AS digest FROM (SELECT l_returnflag || ':' || l_linestatus || ':' || count(*) AS k FROM lineitem GROUP BY l_returnflag, l_linestatus)")
def digest(spark, sf_dir):
    return agg.digest(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("agg_source_overlap", """SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS "both", count(*) FILTER (WHERE quality = 1 OR toxic = 1) AS either, round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / nullif(count(*) FILTER (WHERE quality = 1 OR toxic = 1), 0), 6) AS iou FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def source_overlap(spark, sf_dir):
    both = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return agg.overlap(both, F.col("quality") == 1, F.col("toxic") == 1, ["lang"]).withColumn("iou", F.round("iou", 6))


OVERLAPS = {"high": "predictor > 60", "wet": "target > 2500", "late": "slot >= 3"}


@query("set_all_overlaps", f"WITH {ROWS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(count(*) FILTER (WHERE {OVERLAPS[a]} AND {OVERLAPS[b]}) / count(*) FILTER (WHERE {OVERLAPS[a]} OR {OVERLAPS[b]}), 6) AS iou FROM rows" for a, b in (("high", "wet"), ("high", "late"), ("wet", "late"))))
def all_overlaps(spark, sf_dir):
    return agg.overlaps(rows(spark, sf_dir), {n: F.expr(e) for n, e in OVERLAPS.items()}).withColumn("iou", F.round("iou", 6))


@query("agg_known_fractions", f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT 'x_h{s}' AS variable, round(count(x_h{s}) / count(*), 6) AS fraction FROM wide" for s in range(6)))
def known_fractions(spark, sf_dir):
    wide = agg.slots_wide(cells(spark, sf_dir), CELL_DAY, ["x"], range(6))
    return agg.known_fractions(wide, [f"x_h{s}" for s in range(6)]).withColumn("fraction", F.round("fraction", 6))


@query("agg_binned_median", f"WITH {ROWS} SELECT CAST(floor(control / 10) AS BIGINT) AS bin, round(quantile_cont(predictor, 0.5), 6) AS median, count(predictor) AS n FROM rows GROUP BY 1")
def binned_median(spark, sf_dir):
    return agg.binned_median(rows(spark, sf_dir), "predictor", "control", 10).withColumn("median", F.round("median", 6))


@query("agg_histogram2d", f"WITH {ROWS} SELECT CAST(floor(predictor / 20) AS BIGINT) AS ix, CAST(floor(control / 20) AS BIGINT) AS iy, count(*) AS n, round(100 * avg(CAST(target > 2000 AS INT)), 6) AS pct_over FROM rows GROUP BY ALL HAVING count(*) >= 10")
def histogram2d(spark, sf_dir):
    return agg.histogram2d(rows(spark, sf_dir), "predictor", "control", 20, 20, F.col("target") > 2000, 10).withColumn("pct_over", F.round("pct_over", 6))


@query("agg_column_slope", f"WITH {ROWS} SELECT user_id, round(CASE WHEN count(*) >= 3 AND max(control) - min(control) > 5 AND regr_slope(predictor, control) IS NOT NULL THEN greatest(-1, least(1, regr_slope(predictor, control))) ELSE 0.0 END, 5) AS slope FROM rows GROUP BY user_id")
def column_slope(spark, sf_dir):
    return agg.column_slope(rows(spark, sf_dir), ["user_id"], "control", "predictor", -1.0, 1.0, 0.0, 3, 5).withColumn("slope", F.round("slope", 5) + F.lit(0.0))


@query("agg_hypsometric", f"WITH {ROWS} SELECT lat, lon, round(greatest(0, 287.05 * avg(250 + control / 3) / 9.80665 * ln(avg(1013 + slot) / avg(900 + predictor))), 4) AS height FROM rows GROUP BY lat, lon")
def hypsometric(spark, sf_dir):
    df = rows(spark, sf_dir).select("lat", "lon", (250 + F.col("control") / 3).alias("t"), (1013 + F.col("slot")).alias("slp"), (900 + F.col("predictor")).alias("ps"))
    return agg.hypsometric_height(df, ["lat", "lon"], "t", "slp", "ps").withColumn("height", F.round("height", 4))


@query("agg_pooled_rmse", f"""WITH {ROWS}, e AS (SELECT event_type, slot, count(*) AS n, sqrt(avg(pow(predictor - control, 2))) AS rmse, avg(predictor - control) AS bias FROM rows GROUP BY ALL)
SELECT event_type, CAST(sum(n) AS BIGINT) AS n, round(sqrt(sum(n * rmse * rmse) / sum(n)), 5) AS rmse, round(sum(n * bias) / sum(n), 5) AS bias FROM e GROUP BY event_type""")
def pooled_rmse(spark, sf_dir):
    d = F.col("predictor") - F.col("control")
    parts = rows(spark, sf_dir).groupBy("event_type", "slot").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"))
    return agg.pooled_rmse(parts, ["event_type"], "n", "rmse", "bias").withColumns({"rmse": F.round("rmse", 5), "bias": F.round("bias", 5)})


@query("agg_coverage_bank", f"""WITH {ROWS} SELECT CAST((day - DATE '2000-01-01') % 16 AS INT) AS cycle_day, slot, count(*) FILTER (WHERE predictor > 20) AS n_seen, count(DISTINCT day) AS n_days, round(avg(CAST(predictor > 20 AS INT)), 6) AS frequency, count(DISTINCT day) >= 2 AS enough FROM rows GROUP BY ALL""")
def coverage_bank(spark, sf_dir):
    from ..functions.physics import cycle_day

    return agg.coverage_bank(rows(spark, sf_dir), cycle_day(F.col("day")), ["slot"], F.col("predictor") > 20, "day", 2).withColumn("frequency", F.round("frequency", 6))


@query("agg_zero_fraction", f"WITH {ROWS} SELECT slot AS bin, round(avg(CAST(floor(predictor) % 5 = 0 AS INT)), 6) AS zero_fraction, count(*) AS n FROM rows GROUP BY slot")
def zero_fraction(spark, sf_dir):
    return agg.zero_fraction(rows(spark, sf_dir), F.floor("predictor") % 5, F.col("slot")).withColumn("zero_fraction", F.round("zero_fraction", 6))


@query("agg_data_audit", f"WITH {ROWS} SELECT slot, count(*) AS n, count(DISTINCT day) AS n_days, list_sort(list(DISTINCT CAST(hour(ts) AS INT))) AS hours, round(avg(predictor) FILTER (WHERE target IS NOT NULL), 6) AS mean FROM rows GROUP BY slot".replace("list_sort(list(DISTINCT CAST(hour(ts) AS INT)))", "array_to_string(list_sort(list(DISTINCT hour(ts))), ',')"))
def data_audit(spark, sf_dir):
    hours = F.array_join(F.sort_array(F.collect_set(F.hour("ts"))), ",")
    return rows(spark, sf_dir).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("n_days"), hours.alias("hours"), F.round(F.avg(F.when(F.col("target").isNotNull(), F.col("predictor"))), 6).alias("mean"))


@query("agg_matrix", f"WITH {DAILY} SELECT day, lat, {', '.join(f'round(max(v) FILTER (WHERE lon = {k}), 6) AS c{k}' for k in range(12))} FROM daily GROUP BY day, lat")
def matrix(spark, sf_dir):
    """The matrix of every day over all columns."""
    out = agg.matrix(daily(spark, sf_dir), ["day", "lat"], "lon", range(12), "v")
    return out.select("day", "lat", *[F.round(f"c{k}", 6).alias(f"c{k}") for k in range(12)])


also("agg_matrix", "agg_matrix_whole")


@query("set_union_by_name", "SELECT doc_id AS id, 'labels' AS part, quality, NULL AS lang FROM labels UNION ALL SELECT doc_id, 'documents', NULL, lang FROM documents")
def union_by_name(spark, sf_dir):
    a = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("labels").alias("part"), "quality")
    b = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("part"), "lang")
    return a.unionByName(b, allowMissingColumns=True)


@query("set_difference", f"WITH {ROWS} SELECT DISTINCT day, slot FROM rows EXCEPT SELECT day, slot FROM rows WHERE target > 10000")
def difference(spark, sf_dir):
    df = rows(spark, sf_dir)
    return df.select("day", "slot").subtract(df.where("target > 10000").select("day", "slot"))


@query("set_intersection", f"WITH {ROWS} SELECT lat, lon FROM rows WHERE event_type = 'view' INTERSECT SELECT lat, lon FROM rows WHERE event_type = 'error' INTERSECT SELECT lat, lon FROM rows WHERE event_type = 'purchase'")
def intersection(spark, sf_dir):
    df = rows(spark, sf_dir)
    a, b, c = (df.where(F.col("event_type") == t).select("lat", "lon") for t in ("view", "error", "purchase"))
    return a.intersect(b).intersect(c)


@query("top_best_row", f"WITH {CELLS} SELECT lat, lon, max(y) AS y, arg_max(day, (y, day, slot)) AS day, arg_max(slot, (y, day, slot)) AS slot FROM cells GROUP BY lat, lon")
def best_row(spark, sf_dir):
    out = cells(spark, sf_dir).groupBy("lat", "lon").agg(F.max(F.struct("y", "day", "slot")).alias("m"))
    return out.select("lat", "lon", "m.y", "m.day", "m.slot")


@query("top_days_per_type", f"WITH {ROWS}, d AS (SELECT event_type, day, sum(CAST(round(target * 100) AS BIGINT)) AS cents FROM rows GROUP BY ALL) SELECT event_type, day, CAST(cents AS BIGINT) AS cents FROM d QUALIFY rank() OVER (PARTITION BY event_type ORDER BY cents DESC) <= 3")
def top_days(spark, sf_dir):
    d = rows(spark, sf_dir).groupBy("event_type", "day").agg(F.sum(F.round(F.col("target") * 100).cast("long")).alias("cents"))
    return d.withColumn("r", F.rank().over(Window.partitionBy("event_type").orderBy(F.desc("cents")))).where("r <= 3").drop("r")


@query("top_most_complete", "SELECT o_custkey, arg_max(o_orderkey, (n, -o_orderkey)) AS o_orderkey, max(n) AS n FROM (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY o_custkey")
def most_complete(spark, sf_dir):
    n = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("o_custkey").agg(F.max(F.struct("n", (-F.col("o_orderkey")).alias("m"))).alias("b"))
    return best.select("o_custkey", (-F.col("b.m")).alias("o_orderkey"), "b.n")


@query("top_first_per_group", f"WITH {ROWS} SELECT user_id, min(event_id) AS event_id FROM rows GROUP BY user_id")
def first_per_group(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_id", "event_id").alias("event_id"))


COVERING_HEAD = f"""WITH {ROWS}, s AS (SELECT user_id, sum(CAST(round(target * 100) AS BIGINT)) AS c FROM rows GROUP BY 1), r AS (SELECT *, sum(c) OVER (ORDER BY c DESC, user_id) - c AS before, sum(c) OVER () AS total FROM s)
SELECT user_id, CAST(c AS BIGINT) AS c FROM r WHERE before < 0.3 * total"""


@query("top_covering_head", COVERING_HEAD)
def covering_head(spark, sf_dir):
    """The smallest head that covers the share, however long: running sums over ranges of totals, then among users of equal totals."""
    s = rows(spark, sf_dir).groupBy("user_id").agg(F.sum(F.round(F.col("target") * 100).cast("long")).alias("c")).withColumn("down", -F.col("c"))
    sums = rank.running_totals(rank.value_groups(s, [], "down", {"t": F.sum("c")}), [], "down", ["t"])
    w = Window.partitionBy("down").orderBy("user_id").rowsBetween(Window.unboundedPreceding, -1)
    head = s.join(sums.where(F.col("before_t") < 0.3 * F.col("all_t")).select("down", "before_t", "all_t"), "down")
    return head.withColumn("ties", F.coalesce(F.sum("c").over(w), F.lit(0))).where(F.col("before_t") + F.col("ties") < 0.3 * F.col("all_t")).select("user_id", "c")


also("top_covering_head", "top_covering_head_whole")


@query("top_evenly_spaced", f"WITH {ROWS}, d AS (SELECT DISTINCT day FROM rows), n AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d) SELECT day FROM n WHERE i % greatest(1, n // 10) = 0")
def evenly_spaced(spark, sf_dir):
    """About ten steps over the days, whose number does not grow with the rows."""
    days = rows(spark, sf_dir).select("day").distinct()
    w = Window.orderBy("day")
    return days.select("day", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n")).where("i % greatest(1, n div 10) = 0").select("day")


@query("top_day_folds", f"WITH {ROWS}, d AS (SELECT day, (row_number() OVER (ORDER BY day) - 1) * 5 // count(*) OVER () AS fold FROM (SELECT DISTINCT day FROM rows)) SELECT fold, count(*) AS n FROM rows JOIN d USING (day) GROUP BY fold")
def day_folds(spark, sf_dir):
    """Contiguous folds of days; the day table is small and broadcast."""
    df = rows(spark, sf_dir)
    days = df.select("day").distinct()
    folds = days.select("day", F.floor((F.row_number().over(Window.orderBy("day")) - 1) * 5 / F.count(F.lit(1)).over(Window.partitionBy())).alias("fold"))
    return df.join(F.broadcast(folds), "day").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("top_conditional_draw", f"""WITH {ROWS}, b AS (SELECT event_id, slot, CAST(month(day) AS INT) AS m, md5('3:' || event_id) AS h FROM rows WHERE predictor > 40), q AS (SELECT DISTINCT slot FROM rows)
SELECT q.slot, arg_min(b.event_id, b.h) AS event_id FROM q LEFT JOIN b ON b.slot = q.slot AND least(abs(b.m - 12), 12 - abs(b.m - 12)) <= 1 GROUP BY q.slot""")
def conditional_draw(spark, sf_dir):
    """One seeded draw per slot from a bank, among months at most one away on the circle."""
    df = rows(spark, sf_dir)
    away = F.abs(F.month("day") - 12)
    bank = df.where((F.col("predictor") > 40) & (F.least(away, 12 - away) <= 1))
    draw = bank.groupBy("slot").agg(F.min_by("event_id", F.md5(F.concat(F.lit("3:"), F.col("event_id").cast("string")))).alias("event_id"))
    return df.select("slot").distinct().join(draw, "slot", "left")
