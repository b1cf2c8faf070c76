"""Queries: thresholds, flags and skill."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import skill, thresholds
from .frames import ROWS, rows

PCTS = (80.0, 90.0, 95.0, 99.0)


def r6(*names):
    return {n: F.round(n, 6) for n in names}


@query("thr_event_thresholds", f"""WITH {ROWS}
SELECT p.pct AS pct, round(quantile_cont(target, p.pct / 100), 6) AS threshold FROM rows, (VALUES (80.0), (90.0), (95.0), (99.0)) p(pct) GROUP BY p.pct""".replace("quantile_cont(target, p.pct / 100)", "CASE p.pct WHEN 80 THEN quantile_cont(target, 0.8) WHEN 90 THEN quantile_cont(target, 0.9) WHEN 95 THEN quantile_cont(target, 0.95) ELSE quantile_cont(target, 0.99) END").replace("p.pct AS pct", "CAST(p.pct AS DOUBLE) AS pct"))
def event_thresholds(spark, sf_dir):
    return thresholds.threshold_table(rows(spark, sf_dir), "target", PCTS).withColumns(r6("threshold"))


@query("thr_conditional_percentile", f"WITH {ROWS} SELECT round(quantile_cont(predictor, 0.9) FILTER (WHERE control > 50), 6) AS threshold FROM rows")
def conditional_percentile(spark, sf_dir):
    return thresholds.conditional_percentile(rows(spark, sf_dir), "predictor", F.col("control") > 50, 90).withColumns(r6("threshold"))


@query("flt_event_flags", f"""WITH {ROWS}, t AS (SELECT quantile_cont(target, 0.9) AS hi, quantile_cont(predictor, 0.95) AS px FROM rows)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE target > hi) AS heavy, count(*) FILTER (WHERE target > 0) AS "any", count(*) FILTER (WHERE predictor > px AND control >= 20) AS strong
FROM rows, t GROUP BY event_type""")
def flags(spark, sf_dir):
    df = rows(spark, sf_dir)
    (hi,), (px,) = thresholds.percentile_thresholds(df, "target", [90]), thresholds.percentile_thresholds(df, "predictor", [95])
    flagged = thresholds.event_flags(df, {"heavy": F.col("target") > hi, "any": F.col("target") > 0, "strong": (F.col("predictor") > px) & (F.col("control") >= 20)})
    return flagged.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"flag_{f}").alias(f) for f in ("heavy", "any", "strong")])


def gini_sql(keys: str, source: str) -> str:
    """Gini per key from a CTE ``source`` (keys, value, flag)."""
    on = keys + ", " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""g AS (SELECT {on}value, count(*) AS n, sum(flag) AS e FROM {source} WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(e) OVER ({part} ORDER BY value) - e AS before FROM g),
gini AS (SELECT {on}CAST(sum(n) AS BIGINT) AS n, CAST(sum(e) AS BIGINT) AS n_events,
  round(CASE WHEN sum(e) > 0 THEN 1 - 2 * CAST(sum(n * (before + CAST(e AS DOUBLE) / 2)) AS DOUBLE) / (CAST(sum(n) AS DOUBLE) * sum(e)) END, 6) AS gini FROM r {"GROUP BY " + keys if keys else ""})"""


@query("skill_gini_by_percentile", f"""WITH {ROWS}, t AS (SELECT quantile_cont(target, [0.8, 0.9, 0.95, 0.99]) AS q FROM rows),
s AS (SELECT u.predictor, l.pct, u.value, CAST(target > q[l.i] AS INT) AS flag
  FROM t, rows, LATERAL (VALUES ('predictor', predictor), ('control', control)) u(predictor, value), (VALUES (CAST(80 AS DOUBLE), 1), (90, 2), (95, 3), (99, 4)) l(pct, i)),
{gini_sql("predictor, pct", "s")} SELECT * FROM gini""")
def gini_by_percentile(spark, sf_dir):
    df = rows(spark, sf_dir)
    cuts = dict(zip(PCTS, thresholds.percentile_thresholds(df, "target", PCTS), strict=True))
    return skill.gini_by_threshold(df, ["predictor", "control"], "target", cuts).withColumns(r6("gini"))


def flagged(spark, sf_dir, pct=90):
    df = rows(spark, sf_dir)
    (t,) = thresholds.percentile_thresholds(df, "target", [pct])
    return df.withColumn("flag", thresholds.exceeds("target", t))


FLAGGED = ROWS + ", t AS (SELECT quantile_cont(target, 0.9) AS q FROM rows), flagged AS (SELECT rows.*, predictor AS value, CAST(target > q AS INT) AS flag FROM rows, t)"


@query("skill_hourly_gini", f"WITH {FLAGGED}, {gini_sql('slot', 'flagged')} SELECT * FROM gini")
def hourly_gini(spark, sf_dir):
    return skill.gini(flagged(spark, sf_dir), "predictor", "flag", ["slot"]).withColumns(r6("gini"))


@query("skill_stratified_gini", f"WITH {FLAGGED}, {gini_sql('event_type', 'flagged')} SELECT * FROM gini")
def stratified_gini(spark, sf_dir):
    return skill.gini(flagged(spark, sf_dir), "predictor", "flag", ["event_type"]).withColumns(r6("gini"))


@query("skill_grouping_sets", f"""WITH {FLAGGED}, s AS (SELECT 'all' AS scope, 'all' AS stratum, value, flag FROM flagged UNION ALL SELECT 'event_type', event_type, value, flag FROM flagged UNION ALL SELECT 'slot', CAST(slot AS VARCHAR), value, flag FROM flagged),
{gini_sql('scope, stratum', 's')} SELECT * FROM gini""")
def grouping_sets(spark, sf_dir):
    """Overall and per stratum in one job: strata are stacked per row, then grouped by value before anything is ranked."""
    strata = F.array(*[F.struct(F.lit(n).alias("scope"), v.alias("stratum")) for n, v in (("all", F.lit("all")), ("event_type", F.col("event_type")), ("slot", F.col("slot").cast("string")))])
    df = flagged(spark, sf_dir).select(F.explode(strata).alias("s"), "predictor", "flag").select("s.*", "predictor", "flag")
    return skill.gini(df, "predictor", "flag", ["scope", "stratum"]).withColumns(r6("gini"))


CURVE = FLAGGED + """, b AS (SELECT flag, (row_number() OVER (ORDER BY value, event_id) - 1) * 100 // count(*) OVER () AS bin FROM flagged),
p AS (SELECT bin, sum(flag) AS e FROM b GROUP BY bin),
curve AS (SELECT CAST(bin AS INT) AS bin, (bin + 1) / 100 AS sample_fraction, CAST(sum(e) OVER (ORDER BY bin) AS DOUBLE) / sum(e) OVER () AS event_fraction FROM p)"""


@query("skill_capture_curve", f"WITH {CURVE} SELECT bin, round(sample_fraction, 6) AS sample_fraction, round(event_fraction, 6) AS event_fraction FROM curve")
def capture_curve(spark, sf_dir):
    return skill.capture_curve(flagged(spark, sf_dir), "predictor", "flag", "event_id").withColumns(r6("sample_fraction", "event_fraction"))


@query("skill_gini_from_curve", f"""WITH {CURVE}, s AS (SELECT *, lag(sample_fraction, 1, 0) OVER (ORDER BY bin) AS x0, lag(event_fraction, 1, 0) OVER (ORDER BY bin) AS y0 FROM curve)
SELECT round(sum((sample_fraction - x0) * ((sample_fraction - event_fraction) + (x0 - y0))), 6) AS gini FROM s""")
def gini_from_curve(spark, sf_dir):
    return skill.gini_from_curve(skill.capture_curve(flagged(spark, sf_dir), "predictor", "flag", "event_id")).withColumns(r6("gini"))


@query("skill_detection_at_90", f"WITH {CURVE} SELECT round(1 - event_fraction, 6) AS pod FROM curve WHERE bin = 89")
def detection_at(spark, sf_dir):
    return skill.detection_at(skill.capture_curve(flagged(spark, sf_dir), "predictor", "flag", "event_id"), 0.9).withColumns(r6("pod"))


CONDITIONAL = FLAGGED.replace("predictor AS value", "predictor AS value, CAST((row_number() OVER (ORDER BY control, event_id) - 1) * 5 // count(*) OVER () AS INT) AS control_bin")


@query("skill_conditional_gini", f"WITH {CONDITIONAL}, {gini_sql('control_bin', 'flagged')} SELECT * FROM gini WHERE n_events >= 20")
def conditional_gini(spark, sf_dir):
    return skill.conditional_gini(flagged(spark, sf_dir), "predictor", "flag", "control", "event_id").withColumns(r6("gini"))


@query("skill_pooled_gini", f"WITH {CONDITIONAL}, {gini_sql('control_bin', 'flagged').replace('round(CASE', '(CASE').replace('END, 6)', 'END)')} SELECT count(*) AS n_bins, CAST(sum(n_events) AS BIGINT) AS n_events, round(sum(gini * n_events) / sum(n_events), 6) AS gini FROM gini WHERE n_events >= 20")
def pooled_gini(spark, sf_dir):
    return skill.pooled_gini(skill.conditional_gini(flagged(spark, sf_dir), "predictor", "flag", "control", "event_id")).withColumns(r6("gini"))


@query("skill_event_rate_curve", f"""WITH {FLAGGED}, b AS (SELECT value, flag, (row_number() OVER (ORDER BY value, event_id) - 1) * 20 // count(*) OVER () AS bin FROM flagged),
a AS (SELECT CAST(bin AS INT) AS bin, count(*) AS n, quantile_cont(value, 0.5) AS median, avg(flag) AS rate FROM b GROUP BY bin)
SELECT bin, n, round(median, 6) AS median, round(rate, 6) AS rate, round(sqrt(rate * (1 - rate) / n), 6) AS se FROM a""")
def event_rate_curve(spark, sf_dir):
    return skill.event_rate_curve(flagged(spark, sf_dir), "predictor", "flag", "event_id").withColumns(r6("median", "rate", "se"))


@query("skill_auc", f"""WITH {FLAGGED}, g AS (SELECT event_type, value, count(*) AS n, sum(flag) AS e FROM flagged GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY value) - n AS b FROM g)
SELECT event_type, CAST(sum(e) AS BIGINT) AS n_pos, CAST(sum(n) - sum(e) AS BIGINT) AS n_neg, round((CAST(sum(e * (b + (n + 1) / 2)) AS DOUBLE) - sum(e) * (sum(e) + 1) / 2) / (CAST(sum(e) AS DOUBLE) * (sum(n) - sum(e))), 6) AS auc FROM r GROUP BY event_type""")
def auc(spark, sf_dir):
    return skill.auc(flagged(spark, sf_dir), "predictor", "flag", ["event_type"]).withColumns(r6("auc"))


@query("skill_tail_capture", f"""WITH {FLAGGED}, c AS (SELECT quantile_cont(value, 0.9) AS threshold FROM flagged)
SELECT round(threshold, 6) AS threshold, CAST(sum(flag) AS BIGINT) AS n_events, round(CAST(sum(flag) FILTER (WHERE value >= threshold) AS DOUBLE) / sum(flag), 6) AS captured FROM flagged, c GROUP BY threshold""")
def tail_capture(spark, sf_dir):
    return skill.tail_capture(flagged(spark, sf_dir), "predictor", "flag").withColumns(r6("threshold", "captured"))


@query("skill_r_squared", f"WITH {ROWS} SELECT slot, count(*) AS n, round(1 - sum((target - predictor * 50) * (target - predictor * 50)) / (var_pop(target) * count(*)), 6) AS r2 FROM rows GROUP BY slot")
def r_squared(spark, sf_dir):
    return skill.r_squared(rows(spark, sf_dir).withColumn("guess", F.col("predictor") * 50), "target", "guess", ["slot"]).withColumns(r6("r2"))


@query("skill_weighted_gini", f"""WITH {FLAGGED}, g AS (SELECT value, sum(control) AS n, sum(flag * control) AS e FROM flagged GROUP BY value),
r AS (SELECT *, sum(e) OVER (ORDER BY value) - e AS before FROM g)
SELECT round(sum(n), 4) AS n, round(sum(e), 4) AS n_events, round(1 - 2 * sum(n * (before + e / 2)) / (sum(n) * sum(e)), 6) AS gini FROM r""")
def weighted_gini(spark, sf_dir):
    return skill.gini(flagged(spark, sf_dir), "predictor", "flag", weight="control").select(F.round("n", 4).alias("n"), F.round("n_events", 4).alias("n_events"), F.round("gini", 6).alias("gini"))
