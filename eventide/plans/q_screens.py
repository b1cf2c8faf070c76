"""Queries: screens and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import also, query
from ..functions import clean
from ..operators import rank, screens, windows
from .frames import CELLS, DAILY, ROWS, cells, daily, rows

CELL_DAY = ["day", "lat", "lon"]


@query("flt_box_and_months", f"WITH {ROWS} SELECT event_id, lat, lon, slot FROM rows WHERE lat BETWEEN 2 AND 7 AND lon BETWEEN 1 AND 9 AND slot IN (1, 2, 3) AND month(day) = 1")
def box(spark, sf_dir):
    return clean.in_box(rows(spark, sf_dir), lat=(2, 7), lon=(1, 9)).where(F.col("slot").isin(1, 2, 3) & (F.month("day") == 1)).select("event_id", "lat", "lon", "slot")


@query("flt_all_slots", f"WITH {CELLS} SELECT day, slot, lat, lon, round(x, 6) AS x FROM cells QUALIFY count(slot) OVER (PARTITION BY day, lat, lon) = 6")
def all_slots(spark, sf_dir):
    return screens.all_slots_present(cells(spark, sf_dir), CELL_DAY, 6).select("day", "slot", "lat", "lon", F.round("x", 6).alias("x"))


STEPS = {"land": "lat >= 2", "valid": "x IS NOT NULL AND y IS NOT NULL", "low": "x < 100", "event": "y > 500"}


def steps():
    return {n: F.expr(e) for n, e in STEPS.items()}


@query("flt_step_report", f"""WITH {CELLS} SELECT UNNEST([0, 1, 2, 3, 4]) AS step_no, UNNEST(['input', 'land', 'valid', 'low', 'event']) AS step,
UNNEST([count(*), count(*) FILTER (WHERE lat >= 2), count(*) FILTER (WHERE lat >= 2 AND x IS NOT NULL AND y IS NOT NULL), count(*) FILTER (WHERE lat >= 2 AND x < 100 AND y IS NOT NULL), count(*) FILTER (WHERE lat >= 2 AND x < 100 AND y > 500)]) AS n_rows FROM cells""")
def report(spark, sf_dir):
    return screens.step_report(cells(spark, sf_dir), steps())


@query("flt_apply_screens", f"WITH {CELLS} SELECT day, slot, lat, lon, n FROM cells WHERE lat >= 2 AND x < 100 AND y > 500")
def apply(spark, sf_dir):
    return screens.apply_screens(cells(spark, sf_dir), steps()).select("day", "slot", "lat", "lon", "n")


@query("flt_until_onset", f"""WITH {CELLS}, o AS (SELECT *, min(CASE WHEN y > 2000 THEN slot END) OVER (PARTITION BY day, lat, lon) AS f FROM cells)
SELECT day, slot, lat, lon, n FROM o WHERE coalesce(f, 99) > 0 AND slot <= coalesce(f, 99)""")
def until_onset(spark, sf_dir):
    return screens.until_onset(cells(spark, sf_dir), F.col("y") > 2000, CELL_DAY).select("day", "slot", "lat", "lon", "n")


@query("agg_onset_table", f"WITH {CELLS} SELECT day, lat, lon, min(slot) AS onset, round(arg_min(x, slot), 6) AS x FROM cells WHERE y > 2000 GROUP BY day, lat, lon")
def onset(spark, sf_dir):
    return screens.onset_table(cells(spark, sf_dir), F.col("y") > 2000, CELL_DAY, ["x"]).withColumn("x", F.round("x", 6))


MASTER = CELLS + ", m AS (SELECT day, lat, lon, CASE WHEN count(x) = count(*) THEN max(x) END AS height_max, max(y) FILTER (WHERE slot IN (0, 1)) AS dry_start, bool_and(x IS NOT NULL) AND bool_and(y IS NOT NULL) AS all_valid FROM cells GROUP BY ALL)"


@query("flt_master_components", f"WITH {MASTER} SELECT day, lat, lon, round(height_max, 6) AS height_max, round(dry_start, 6) AS dry_start, all_valid FROM m")
def master_components(spark, sf_dir):
    c = screens.master_components(cells(spark, sf_dir), CELL_DAY, "x", "y", ["x", "y"])
    return c.select(*CELL_DAY, F.round("height_max", 6).alias("height_max"), F.round("dry_start", 6).alias("dry_start"), "all_valid")


@query("flt_master_mask", f"WITH {MASTER}, k AS (SELECT day, lat, lon FROM m WHERE height_max < 120 AND dry_start <= 3000 AND all_valid) SELECT cells.day, slot, cells.lat, cells.lon, n FROM cells JOIN k USING (day, lat, lon) WHERE slot >= 1")
def master_mask(spark, sf_dir):
    """The kept groups select rows by a semi join; only slots from 1 on are samples."""
    df = cells(spark, sf_dir)
    kept = screens.master_mask(screens.master_components(df, CELL_DAY, "x", "y", ["x", "y"]), 120, 3000)
    return df.where("slot >= 1").join(kept.select(*CELL_DAY), CELL_DAY, "left_semi").select("day", "slot", "lat", "lon", "n")


@query("flt_steps_without_gaps", f"WITH {ROWS} SELECT event_id, day, slot FROM rows WHERE (day, slot) NOT IN (SELECT day, slot FROM rows WHERE predictor > 300)")
def steps_without_gaps(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("step", F.struct("day", "slot")).withColumn("v", F.when(F.col("predictor") <= 300, F.col("predictor")))
    return screens.steps_without_gaps(df, "step", "v").select("event_id", "day", "slot")


@query("flt_physical_report", f"""WITH {ROWS} SELECT 'predictor' AS variable, min(predictor) AS low, max(predictor) AS high, count(*) - count(predictor) AS n_missing, min(predictor) >= 0 AND max(predictor) <= 1000 AS ok FROM rows
UNION ALL SELECT 'control', min(control), max(control), count(*) - count(control), min(control) >= 10 AND max(control) <= 100 FROM rows""")
def physical(spark, sf_dir):
    return screens.physical_report(rows(spark, sf_dir), {"predictor": (0, 1000), "control": (10, 100)})


@query("flt_valid_products", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal IS NOT NULL AND o_totalprice IS NOT NULL AND c_acctbal >= 0")
def valid_products(spark, sf_dir):
    from .frames import load

    df = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return df.dropna(subset=["c_acctbal", "o_totalprice"]).where("c_acctbal >= 0").select("o_orderkey", "c_custkey")


LAGGED = DAILY + ", d AS (SELECT * FROM daily)"


@query("win_calendar_lags", f"""WITH {LAGGED} SELECT a.day, a.lat, a.lon, round(b.v, 6) AS v_lag1, round(c.v, 6) AS v_lag3, round(e.v, 6) AS v_lag7 FROM d a
LEFT JOIN d b ON a.lat = b.lat AND a.lon = b.lon AND b.day = a.day - 1 LEFT JOIN d c ON a.lat = c.lat AND a.lon = c.lon AND c.day = a.day - 3 LEFT JOIN d e ON a.lat = e.lat AND a.lon = e.lon AND e.day = a.day - 7""")
def calendar_lags(spark, sf_dir):
    out = windows.calendar_lags(daily(spark, sf_dir), ["lat", "lon"], "v", [1, 3, 7])
    return out.select("day", "lat", "lon", *[F.round(f"v_lag{k}", 6).alias(f"v_lag{k}") for k in (1, 3, 7)])


@query("win_antecedent_mean", f"""WITH {LAGGED} SELECT a.day, a.lat, a.lon, round(CASE WHEN count(b.v) = 3 THEN avg(b.v) END, 6) AS ante FROM d a
LEFT JOIN d b ON a.lat = b.lat AND a.lon = b.lon AND b.day BETWEEN a.day - 3 AND a.day - 1 GROUP BY a.day, a.lat, a.lon""")
def antecedent(spark, sf_dir):
    out = windows.antecedent_mean(daily(spark, sf_dir), ["lat", "lon"], "v", 1, 3, "ante")
    return out.select("day", "lat", "lon", F.round("ante", 6).alias("ante"))


@query("win_step_difference", f"""WITH {CELLS}, s AS (SELECT *, coalesce(x, 0) - lag(coalesce(x, 0), 1, 0) OVER (PARTITION BY day, lat, lon ORDER BY slot) AS dx FROM cells)
SELECT day, slot, lat, lon, round(dx, 6) AS dx, round(max(dx) OVER (PARTITION BY day, lat, lon), 6) AS dx_max FROM s""")
def step_difference(spark, sf_dir):
    out = windows.step_difference(cells(spark, sf_dir), CELL_DAY, "x", "dx")
    return out.select("day", "slot", "lat", "lon", F.round("dx", 6).alias("dx"), F.round("dx_max", 6).alias("dx_max"))


@query("win_this_or_next", f"WITH {CELLS} SELECT day, slot, lat, lon, greatest(y, lead(y) OVER (PARTITION BY day, lat, lon ORDER BY slot)) > 3000 AS event FROM cells")
def this_or_next(spark, sf_dir):
    return windows.this_or_next(cells(spark, sf_dir), CELL_DAY, "y", 3000, "event").select("day", "slot", "lat", "lon", "event")


@query("win_box_smooth", f"WITH {DAILY}, s AS (SELECT *, avg(v) OVER (PARTITION BY day, lon ORDER BY lat RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a FROM daily) SELECT day, lat, lon, round(avg(a) OVER (PARTITION BY day, lat ORDER BY lon RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM s")
def box_smooth(spark, sf_dir):
    one = windows.box_smooth(daily(spark, sf_dir), ["day", "lon"], "lat", "v", 1, "a")
    return windows.box_smooth(one, ["day", "lat"], "lon", "a", 1, "smooth").select("day", "lat", "lon", F.round("smooth", 6).alias("smooth"))


@query("win_smooth3", f"""WITH {DAILY}, s AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM daily WINDOW w AS (PARTITION BY lat, lon ORDER BY day))
SELECT day, lat, lon, round(CASE WHEN a IS NULL OR b IS NULL THEN v ELSE 0.25 * a + 0.5 * v + 0.25 * b END, 6) AS smooth FROM s""")
def smooth3(spark, sf_dir):
    return windows.smooth3(daily(spark, sf_dir), ["lat", "lon"], "day", "v", "smooth").select("day", "lat", "lon", F.round("smooth", 6).alias("smooth"))


PATH = ROWS + ", p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_id, ts, predictor AS px, control AS py FROM rows)"


def paths(spark, sf_dir):
    """The events of each user as a trajectory."""
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows(spark, sf_dir).select("user_id", step.alias("step"), "event_id", "ts", F.col("predictor").alias("px"), F.col("control").alias("py"))


PATH_LENGTH = f"""WITH {PATH}, q AS (SELECT *, coalesce(sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2)), 0) AS piece FROM p WINDOW w AS (PARTITION BY user_id ORDER BY step))
SELECT user_id, step, round(sum(piece) OVER (PARTITION BY user_id ORDER BY step), 5) AS travelled, round(sum(piece) OVER (PARTITION BY user_id) - sum(piece) OVER (PARTITION BY user_id ORDER BY step), 5) AS remaining FROM q"""


@query("win_path_length", f"SELECT user_id, step, travelled, remaining + 0.0 AS remaining FROM ({PATH_LENGTH})")
def path_length(spark, sf_dir):
    out = windows.path_length(paths(spark, sf_dir), ["user_id"], "step", "px", "py")
    return out.select("user_id", "step", F.round("travelled", 5).alias("travelled"), (F.round("remaining", 5) + 0.0).alias("remaining"))


also("win_path_length", "win_path_length_whole")


RESIDENCE = f"""WITH {PATH}, h AS (SELECT *, epoch_us(ts) / 3600000000 AS h FROM p)
SELECT user_id, step, round((coalesce(h - lag(h) OVER w, 0) + coalesce(lead(h) OVER w - h, 0)) / 2, 5) AS hours FROM h WINDOW w AS (PARTITION BY user_id ORDER BY step)"""


@query("win_residence", RESIDENCE)
def residence(spark, sf_dir):
    df = paths(spark, sf_dir).withColumn("h", F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0)
    return windows.residence_hours(df, ["user_id"], "step", "h", "hours").select("user_id", "step", F.round("hours", 5).alias("hours"))


also("win_residence", "win_residence_whole")


@query("win_percentage_rank", f"""WITH {ROWS}, g AS (SELECT predictor, count(*) AS n FROM rows GROUP BY 1), r AS (SELECT predictor, (sum(n) OVER (ORDER BY predictor) - n + (n + 1) / 2) / sum(n) OVER () AS p FROM g)
SELECT event_id, round(p, 6) AS pct_rank, CASE WHEN p <= 1/3 THEN 'low' WHEN p <= 2/3 THEN 'mid' ELSE 'high' END AS tercile FROM rows JOIN r USING (predictor)""")
def percentage_rank(spark, sf_dir):
    out = rank.average_rank(rows(spark, sf_dir).select("event_id", "predictor"), "predictor")
    return out.select("event_id", F.round("pct_rank", 6).alias("pct_rank"), windows.terciles(F.col("pct_rank")).alias("tercile"))


@query("win_equal_count_bins", f"WITH {ROWS} SELECT event_id, CAST((row_number() OVER (PARTITION BY slot ORDER BY predictor, event_id) - 1) * 7 // count(*) OVER (PARTITION BY slot) AS INT) AS bin FROM rows")
def equal_count(spark, sf_dir):
    return rank.equal_count_bins(rows(spark, sf_dir), ["slot"], "predictor", "event_id", 7).select("event_id", "bin")


@query("win_quantile_bins", f"WITH {ROWS}, e AS (SELECT quantile_cont(predictor, [0.3333, 0.6667]) AS q FROM rows) SELECT event_id, CAST(predictor > q[1] AS INT) + CAST(predictor > q[2] AS INT) AS bin FROM rows, e")
def quantile_bins(spark, sf_dir):
    return windows.quantile_bins(rows(spark, sf_dir), "predictor", [0.3333, 0.6667], "bin").select("event_id", "bin")


@query("win_zscore", f"WITH {DAILY} SELECT day, lat, lon, round((v - avg(v) OVER (PARTITION BY lat, lon)) / nullif(stddev_pop(v) OVER (PARTITION BY lat, lon), 0), 5) AS z FROM daily")
def zscore(spark, sf_dir):
    return windows.zscore(daily(spark, sf_dir), ["lat", "lon"], "v", "z").select("day", "lat", "lon", F.round("z", 5).alias("z"))


@query("win_draw_per_group", f"WITH {ROWS} SELECT event_id, event_type FROM rows QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || event_id), event_id) <= 25")
def draw(spark, sf_dir):
    return windows.draw_per_group(rows(spark, sf_dir), ["event_type"], "event_id", 25, 7).select("event_id", "event_type")
