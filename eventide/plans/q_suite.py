"""Queries: the battery, inversions, learning, quality checks, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import also, query
from ..operators import inversion, ml, qa, skill
from ..sources import bulletins, tables
from . import suite
from .config import Hypothesis, RunConfig
from .frames import CELLS, DAILY, ROWS, cells, daily, load, rows
from .q_skill import FLAGGED, flagged, gini_sql

REGISTRY = (
    Hypothesis("value", "predictor", "flag", "+", controls=("control",), strata=("slot_phase", "event_type"), topline=True, title="The value ranks large targets"),
    Hypothesis("factor", "control", "flag", "+", controls=("predictor",), strata=("slot_phase",), topline=True, title="So does the factor"),
    Hypothesis("slot", "slot", "flag", "n/a", strata=("event_type",), title="The slot does not"),
    Hypothesis("distance", "distance", "flag", "shape", controls=("control",), title="Distance from the middle value, a shape"),
    Hypothesis("distance_rates", "distance", "flag", "+", invert="binned", title="The same, ordered by event rate"),
)


def sample(spark, sf_dir):
    return flagged(spark, sf_dir).withColumn("distance", F.abs(F.col("predictor") - 60))


@query("bat_suite")
def run_suite(spark, sf_dir):
    """All hypotheses, controls and strata in one stacked job."""
    strata = {n: f() for n, f in suite.STRATIFIERS.items()}
    return suite.verdict(suite.run(sample(spark, sf_dir), REGISTRY, strata, RunConfig(reps=200, rank_bins=64), "event_id"))


@query("bat_report")
def report(spark, sf_dir):
    strata = {n: f() for n, f in suite.STRATIFIERS.items()}
    cfg = RunConfig(reps=100, rank_bins=32, hypotheses="topline", run_controls=False)
    return suite.report_lines(suite.run(sample(spark, sf_dir), REGISTRY, strata, cfg, "event_id"))


@query("bat_factor_deltas", f"""WITH {ROWS}, r AS (SELECT event_type, slot, avg(target) AS v FROM rows GROUP BY ALL) SELECT count(*) AS n, round(avg(b.v - a.v), 5) AS mean_delta FROM r a JOIN r b ON a.event_type = b.event_type AND a.slot = 0 AND b.slot = 5""")
def factor_deltas(spark, sf_dir):
    r = rows(spark, sf_dir).groupBy("event_type", "slot").agg(F.avg("target").alias("v"))
    return suite.factor_deltas(r, ["event_type", "slot"], "slot", 0, 5, "v").withColumn("mean_delta", F.round("mean_delta", 5))


@query("bat_stacked_counts", f"""WITH {ROWS}, t AS (SELECT quantile_cont(target, 0.9) AS q FROM rows), f AS (SELECT rows.*, target > q AS flag FROM rows, t)
SELECT id, scope, count(*) AS n, count(*) FILTER (WHERE flag) AS n_events FROM f, LATERAL (VALUES ('value', 'overall'), ('value', 'ctrl:control'), ('value', 'slot_phase=' || CASE WHEN slot >= 3 THEN 'late' ELSE 'early' END), ('value', 'event_type=' || event_type), ('factor', 'overall'), ('factor', 'ctrl:predictor'), ('factor', 'slot_phase=' || CASE WHEN slot >= 3 THEN 'late' ELSE 'early' END)) s(id, scope) GROUP BY ALL""")
def stacked_counts(spark, sf_dir):
    strata = {n: f() for n, f in suite.STRATIFIERS.items()}
    long = suite.stacked(flagged(spark, sf_dir), [h for h in REGISTRY if h.topline], strata, RunConfig(), "event_id", "day")
    return long.groupBy("id", "scope").agg(F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("n_events"))


@query("skill_crossfit_quadratic")
def crossfit_quadratic(spark, sf_dir):
    df = inversion.crossfit(sample(spark, sf_dir).select("event_id", "day", "distance", "flag"), "distance", "flag", "day", "quadratic", 3)
    return df.select("event_id", "fold", F.round("index", 4).alias("index"))


#: Distance from 60 scored on each of three folds of days by event rates that the other two give to its twentieths.
CROSSFIT = FLAGGED + f""", f AS (SELECT day, CAST((row_number() OVER (ORDER BY day) - 1) * 3 // count(*) OVER () AS INT) AS fold FROM (SELECT DISTINCT day FROM rows)), s AS (SELECT event_id, fold, abs(value - 60) AS x, flag FROM flagged JOIN f USING (day)),
a AS (SELECT k, x, flag FROM s JOIN (VALUES (0), (1), (2)) t(k) ON fold <> k), q AS (SELECT k, list_sort(list_distinct(quantile_cont(x, {[i / 20 for i in range(21)]}))) AS e FROM a GROUP BY k),
b AS (SELECT k, len([z FOR z IN e[2:len(e) - 1] IF z <= x]) AS b, x, flag FROM a JOIN q USING (k)), m AS (SELECT k, b, quantile_cont(x, 0.5) AS c, avg(flag) AS r FROM b GROUP BY ALL),
segments AS (SELECT k, c, r, lead(c) OVER w AS c1, lead(r) OVER w AS r1, row_number() OVER w AS i FROM m WINDOW w AS (PARTITION BY k ORDER BY c)),
x AS (SELECT fold, event_id, flag, CASE WHEN i = 1 AND x <= c THEN r WHEN c1 IS NULL THEN r ELSE r + (r1 - r) * (x - c) / (c1 - c) END AS value FROM s JOIN segments ON k = fold AND (x > c OR i = 1) AND (x <= c1 OR c1 IS NULL))"""


@query("skill_crossfit_binned_gini", f"WITH {CROSSFIT}, {gini_sql('fold', 'x').replace('END, 6)', 'END, 5)')} SELECT * FROM gini")
def crossfit_binned(spark, sf_dir):
    df = inversion.crossfit(sample(spark, sf_dir).select("event_id", "day", "distance", "flag"), "distance", "flag", "day", "binned", 3)
    return skill.gini(df, "index", "flag", ["fold"]).withColumn("gini", F.round("gini", 5))


@query("ml_block_comparison")
def block_comparison(spark, sf_dir):
    df = rows(spark, sf_dir).select("event_id", "predictor", "control", F.col("slot").cast("double").alias("slot"), "target")
    return ml.block_comparison(df, ["predictor", "slot"], ["control"], "target", F.col("event_id") % 4 == 0, 10).withColumn("r2", F.round("r2", 4))


@query("ml_threshold_classify", f"WITH {CELLS} SELECT day, slot, lat, lon, x > 60 AND y > 3000 AND n >= 1 AS convective FROM cells")
def threshold_classify(spark, sf_dir):
    return ml.threshold_classify(cells(spark, sf_dir), F.expr("x > 60 AND y > 3000 AND n >= 1")).select("day", "slot", "lat", "lon", "convective")


@query("ml_mixture_classify")
def mixture_classify(spark, sf_dir):
    df = cells(spark, sf_dir).select("day", "slot", "lat", "lon", F.log1p("x").alias("lx"), F.log1p("y").alias("ly"))
    return ml.mixture_classify(df, ["lx", "ly"], "ly", 3).groupBy("convective").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ly"), 4).alias("mean"))


@query("ml_forest_classify")
def forest_classify(spark, sf_dir):
    df = cells(spark, sf_dir).select("day", "slot", "lat", "lon", "x", "y", F.col("n").cast("double").alias("c"))
    weak = F.when(F.col("y") > 5000, True).when(F.col("y") < 500, False)
    return ml.forest_classify(df, ["x", "c"], weak, 10).select("day", "slot", "lat", "lon", F.round("probability", 4).alias("probability"), "convective")


#: Monotone fit as the largest over starts of the least over ends of the mean rate between them; linear between fitted places.
ISOTONIC = ROWS + """, r AS (SELECT event_id, control / 100 AS p, CAST(target > 2500 AS INT) AS flag FROM rows), g AS (SELECT p, sum(flag) AS s, count(*) AS n FROM r WHERE event_id % 2 = 0 AND p IS NOT NULL AND flag IS NOT NULL GROUP BY p),
c AS (SELECT p, row_number() OVER w AS i, sum(s) OVER w AS s1, sum(n) OVER w AS n1, sum(s) OVER w - s AS s0, sum(n) OVER w - n AS n0 FROM g WINDOW w AS (ORDER BY p)),
m AS (SELECT i.i, a.i AS a, min((b.s1 - a.s0) / (b.n1 - a.n0)) AS m FROM c i JOIN c a ON a.i <= i.i JOIN c b ON b.i >= i.i GROUP BY i.i, a.i), v AS (SELECT c.p, max(m) AS v FROM m JOIN c USING (i) GROUP BY c.p),
q AS (SELECT DISTINCT p FROM r WHERE event_id % 2 = 1), e AS (SELECT q.p, max(v.p) FILTER (WHERE v.p <= q.p) AS lo, min(v.p) FILTER (WHERE v.p >= q.p) AS hi FROM q, v GROUP BY q.p),
f AS (SELECT e.p, CASE WHEN lo IS NULL THEN h.v WHEN hi IS NULL OR hi = lo THEN l.v ELSE l.v + (h.v - l.v) * (e.p - lo) / (hi - lo) END AS calibrated FROM e LEFT JOIN v l ON l.p = lo LEFT JOIN v h ON h.p = hi)"""


@query("ver_isotonic", f"WITH {ISOTONIC} SELECT event_id, round(calibrated, 6) AS calibrated FROM r JOIN f USING (p) WHERE event_id % 2 = 1")
def isotonic(spark, sf_dir):
    df = rows(spark, sf_dir).select("event_id", (F.col("control") / 100).alias("p"), (F.col("target") > 2500).alias("flag"))
    return ml.isotonic(df.where("event_id % 2 = 0"), df.where("event_id % 2 = 1"), "p", "flag").select("event_id", F.round("calibrated", 6).alias("calibrated"))


SURFACE = DAILY + ", s AS (SELECT lat, lon, CASE WHEN lat <> 3 OR lon <> 4 THEN least(1.0, avg(v) / 40) END AS v FROM daily GROUP BY lat, lon)"


def surface(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("lat", "lon").agg(F.least(F.lit(1.0), F.avg("v") / 40).alias("v")).withColumn("v", F.when((F.col("lat") != 3) | (F.col("lon") != 4), F.col("v")))


@query("qa_interior_closure", f"""WITH {SURFACE}, i AS (SELECT * FROM s WHERE v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s g WHERE g.v IS NULL AND abs(g.lat - s.lat) <= 2 AND abs(g.lon - s.lon) <= 2))
SELECT 'closure' AS "check", CASE WHEN quantile_cont(v, 0.5) >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS status, round(quantile_cont(v, 0.5), 6) AS value, count(*) AS n FROM i""")
def closure(spark, sf_dir):
    return qa.interior_closure(surface(spark, sf_dir), "v", 2, 0.9).withColumn("value", F.round("value", 6))


@query("qa_alignment", f"""WITH {ROWS}, c AS (SELECT -((predictor - 50) * (control - 50) + (slot - 2) * (lat - 5)) / nullif(sqrt(pow(predictor - 50, 2) + pow(slot - 2, 2)) * sqrt(pow(control - 50, 2) + pow(lat - 5, 2)), 0) AS c FROM rows)
SELECT 'alignment' AS "check", CASE WHEN quantile_cont(c, 0.5) >= 0.5 AND avg(CAST(c < 0 AS INT)) <= 0.2 THEN 'PASS' ELSE 'FAIL' END AS status, round(quantile_cont(c, 0.5), 6) AS value, count(*) AS n FROM c WHERE c IS NOT NULL""")
def alignment(spark, sf_dir):
    df = rows(spark, sf_dir).select((F.col("predictor") - 50).alias("dx"), (F.col("slot") - 2.0).alias("dy"), (F.col("control") - 50).alias("u"), (F.col("lat") - 5.0).alias("v"))
    return qa.upwind_alignment(df, "dx", "dy", "u", "v", 0.5, 0.2).withColumn("value", F.round("value", 6))


@query("qa_lag_profile", f"""WITH {ROWS}, g AS (SELECT slot, sum(lat * predictor) / sum(predictor) AS c, sum(predictor) FILTER (WHERE lat = 0) / sum(predictor) AS e FROM rows GROUP BY slot)
SELECT 'lag_profile' AS "check", CASE WHEN corr(slot, c) > 0 AND arg_max(e, slot) <= 0.5 THEN 'PASS' ELSE 'FAIL' END AS status, round(corr(slot, c), 5) AS value, count(*) AS n FROM g""")
def lag_profile(spark, sf_dir):
    return qa.lag_profile(rows(spark, sf_dir), "slot", "lat", "predictor", 0.5).withColumn("value", F.round("value", 5))


@query("qa_magnitude", f"""WITH {ROWS}, g AS (SELECT slot, quantile_cont(predictor, 0.5) AS m, quantile_cont(predictor, 0.99) AS p FROM rows GROUP BY slot)
SELECT 'magnitude' AS "check", CASE WHEN min(m) >= 10 AND max(m) <= 80 AND max(p) <= 400 THEN 'PASS' ELSE 'FAIL' END AS status, round(max(p), 6) AS value, count(*) AS n FROM g""")
def magnitude(spark, sf_dir):
    return qa.magnitude(rows(spark, sf_dir), "slot", "predictor", 10, 80, 400).withColumn("value", F.round("value", 6))


@query("qa_size_leakage", f"""WITH {ROWS}, c AS (SELECT corr(predictor, target) AS r, corr(predictor, control) AS a, corr(target, control) AS b FROM rows), d AS (SELECT abs(r - (r - a * b) / sqrt((1 - a * a) * (1 - b * b))) AS d FROM c)
SELECT 'size_leakage' AS "check", CASE WHEN d <= 0.3 THEN 'PASS' ELSE 'FAIL' END AS status, round(d, 6) AS value, CAST(1 AS BIGINT) AS n FROM d""")
def leakage(spark, sf_dir):
    return qa.size_leakage(rows(spark, sf_dir), "predictor", "target", "control", 0.3).withColumn("value", F.round("value", 6))


@query("qa_monotonicity", f"""WITH {FLAGGED}, g AS (SELECT -value AS v, count(*) AS n, sum(flag) AS e FROM flagged GROUP BY 1), r AS (SELECT *, (sum(n) OVER (ORDER BY v) - n + (n + 1) / 2) / sum(n) OVER () AS p FROM g),
d AS (SELECT least(9, floor(p * 10)) AS d, sum(e) / sum(n) AS rate FROM r GROUP BY 1), q AS (SELECT d, (rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2) AS q FROM d), s AS (SELECT corr(d, q) AS m, count(*) AS n FROM q),
k AS (SELECT slot, quantile_cont(predictor, 0.5) AS m, quantile_cont(predictor, 0.99) AS p FROM rows GROUP BY slot)
SELECT 'monotonicity' AS "check", CASE WHEN m < -0.5 THEN 'PASS' WHEN m < 0 THEN 'WARN' ELSE 'FAIL' END AS status, round(m, 5) AS value, n FROM s
UNION ALL SELECT 'magnitude', CASE WHEN min(m) >= 10 AND max(m) <= 80 AND max(p) <= 400 THEN 'PASS' ELSE 'FAIL' END, round(max(p), 5), count(*) FROM k""")
def monotonicity(spark, sf_dir):
    df = flagged(spark, sf_dir).withColumn("v", -F.col("predictor"))
    return qa.battery([qa.monotonicity(df, "v", "flag"), qa.magnitude(df, "slot", "predictor", 10, 80, 400)]).withColumn("value", F.round("value", 5))


@query("qa_coverage", f"WITH {ROWS} SELECT CASE WHEN lon < 6 THEN 'west' ELSE 'east' END AS region, count(*) AS n, round(avg(CAST(predictor > 10 AS INT)), 6) AS seen_fraction, count(DISTINCT day) FILTER (WHERE predictor > 10) AS n_days FROM rows GROUP BY 1")
def coverage(spark, sf_dir):
    out = qa.coverage(rows(spark, sf_dir), F.when(F.col("lon") < 6, "west").otherwise("east"), F.col("predictor") > 10, "day")
    return out.withColumn("seen_fraction", F.round("seen_fraction", 6))


@query("src_pruned_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' AND l_quantity > 25")
def pruned_scan(spark, sf_dir):
    where = "l_shipdate >= timestamp_ntz'1998-01-01' AND l_shipdate < timestamp_ntz'1999-01-01' AND l_quantity > 25"
    return tables.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], where)


@query("src_optional_absent", "SELECT doc_id, quality, CAST(NULL AS INT) AS extra FROM labels")
def optional_absent(spark, sf_dir):
    """An absent product gives the same columns, filled with missing values."""
    extra = tables.optional(spark, f"{sf_dir}/no_such_table.parquet", "doc_id long, extra int")
    return load(spark, sf_dir, "labels").select("doc_id", "quality").join(extra, "doc_id", "left")


@query("src_one_hot", f"WITH {ROWS} SELECT event_id, " + ", ".join(f"CASE WHEN slot > 0 THEN CAST(event_type = '{c}' AS INT) END AS is_{c}" for c in ("view", "click", "error")) + " FROM rows")
def one_hot(spark, sf_dir):
    return tables.one_hot(rows(spark, sf_dir), "event_type", ["view", "click", "error"], F.col("slot") > 0).select("event_id", "is_view", "is_click", "is_error")


@query("src_still_to_do", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def still_to_do(spark, sf_dir):
    return tables.still_to_do(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels"), ["doc_id"])


@query("src_upsert", "SELECT l.doc_id, coalesce(n.quality, l.quality) AS quality FROM labels l LEFT JOIN (SELECT doc_id, 9 AS quality FROM labels WHERE toxic = 1) n ON l.doc_id = n.doc_id")
def upsert(spark, sf_dir):
    old = load(spark, sf_dir, "labels")
    return tables.upsert(old.select("doc_id", "quality"), old.where("toxic = 1").select("doc_id", F.lit(9).alias("quality")), ["doc_id"])


@query("src_append_columns", f"WITH {ROWS} SELECT event_id, event_type, CASE WHEN slot = 1 THEN 5 END AS mark FROM rows")
def append_columns(spark, sf_dir):
    df = rows(spark, sf_dir)
    return tables.append_columns(df.select("event_id", "event_type"), df.where("slot = 1").select("event_id", F.lit(5).alias("mark")), ["event_id"])


@query("src_bulletin_points", """WITH b AS (SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN 'COLD WK ' ELSE 'WARM ' END || lpad(CAST(10 + (conv_id * 7 + turn * 3) % 70 AS VARCHAR), 2, '0') || lpad(CAST((conv_id * 13 + turn * 11) % 180 AS VARCHAR), 3, '0') || ' ' || lpad(CAST(10 + (conv_id * 5 + turn) % 70 AS VARCHAR), 2, '0') || lpad(CAST((conv_id * 17 + turn) % 180 AS VARCHAR), 3, '0'), ' ' ORDER BY turn) AS body, count(*) AS n FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id % 96 AS t, arg_max(conv_id, (n, conv_id)) AS conv_id FROM b GROUP BY 1)
SELECT CASE WHEN c.turn % 2 = 0 THEN 'cold' ELSE 'warm' END AS kind, count(*) * 2 AS n_points FROM k JOIN conversations c USING (conv_id) GROUP BY 1""")
def bulletin_points(spark, sf_dir):
    """Bulletins written from the conversations table, parsed back: the most complete one per valid time, of equally complete ones the last conversation."""
    c = load(spark, sf_dir, "conversations")

    def digits(e: str, n: int):
        return F.lpad(F.expr(e).cast("string"), n, "0")

    line = F.concat(F.when(F.col("turn") % 2 == 0, "COLD WK ").otherwise("WARM "), digits("10 + (conv_id * 7 + turn * 3) % 70", 2), digits("(conv_id * 13 + turn * 11) % 180", 3), F.lit(" "), digits("10 + (conv_id * 5 + turn) % 70", 2), digits("(conv_id * 17 + turn) % 180", 3))
    stamp = F.concat(F.lit("01"), F.lpad((F.expr("(conv_id % 96) div 8") + 1).cast("string"), 2, "0"), F.lpad((F.expr("conv_id % 8") * 3).cast("string"), 2, "0"))
    b = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"]), " ").alias("body"))
    text = b.select("conv_id", F.concat(F.lit("CODSUS\nVALID "), stamp, F.lit("Z "), F.col("body"), F.lit(" $")).alias("text"))
    points = bulletins.points_of(text, "text", F.lit(2016), "conv_id")
    return points.groupBy("kind").agg(F.count(F.lit(1)).alias("n_points"))


UNWRAPPED = f"""WITH {ROWS}, s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, predictor % 90 AS lat, (control * 37) % 361 - 180 AS lon FROM rows),
r AS (SELECT *, coalesce(((lon - lag(lon) OVER w + 180) % 360 + 360) % 360 - 180, 0) AS st FROM s WINDOW w AS (PARTITION BY user_id ORDER BY seq)), u AS (SELECT *, first_value(lon) OVER w + sum(st) OVER w AS u FROM r WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT user_id, seq, round(u - 360 * round_even((avg(u) OVER (PARTITION BY user_id) + 101) / 360, 0), 6) AS lon FROM u"""


@query("src_unwrapped_lines", UNWRAPPED)
def unwrapped(spark, sf_dir):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    p = rows(spark, sf_dir).select("user_id", seq.alias("seq"), (F.col("predictor") % 90).alias("lat"), ((F.col("control") * 37) % 361 - 180).alias("lon"))
    return bulletins.split_and_unwrap(p, ["user_id"], -101.0).select("user_id", "seq", F.round("lon", 6).alias("lon"))


also("src_unwrapped_lines", "src_unwrapped_lines_whole")
