"""Queries: layer depth, spread, swaths, regridding, footprints, stored curves, configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import physics as phys
from ..operators import aggregates, climatology, grid, inversion, trajectory
from ..sources import tables
from ..sources.scratch import fresh_path, written
from . import suite
from .config import RunConfig
from .frames import CELLS, DAILY, ROWS, cells, daily, rows
from .q_screens import PATH, paths
from .q_suite import REGISTRY, sample


@query("fn_layer_depth", f"""WITH {ROWS}, h AS (SELECT event_id, -120 + lon * 5.0 AS x, (hour(ts) + (-120 + lon * 5.0) / 15 + 24) % 24 AS h FROM rows),
s AS (SELECT *, CASE WHEN h > 7 AND h <= 15 THEN 0.5 * (1 - cos(pi() * (h - 7) / 8)) WHEN h > 15 AND h < 19 THEN 0.5 * (1 + cos(pi() * (h - 15) / 4)) ELSE 0 END AS s FROM h)
SELECT event_id, round(s, 6) AS shape, round(200 + (greatest(1800 + 50 * (-65 - x), 200) - 200) * s, 5) AS depth FROM s""")
def layer_depth(spark, sf_dir):
    lon, hour = -120 + F.col("lon") * 5.0, F.hour("ts")
    return rows(spark, sf_dir).select("event_id", F.round(phys.diurnal_shape(phys.local_solar_hour(lon, hour)), 6).alias("shape"), F.round(phys.layer_depth(lon, hour), 5).alias("depth"))


@query("prj_specific_humidity", f"WITH {ROWS}, r AS (SELECT event_id, CASE WHEN slot = 3 THEN 0.0 ELSE predictor / 10 END AS r FROM rows) SELECT event_id, round(nullif(r, 0) / 1000 / (1 + nullif(r, 0) / 1000), 9) AS q FROM r")
def humidity(spark, sf_dir):
    r = F.when(F.col("slot") == 3, 0.0).otherwise(F.col("predictor") / 10)
    return rows(spark, sf_dir).select("event_id", F.round(phys.specific_humidity(r), 9).alias("q"))


@query("agg_spread_factor", f"""WITH {ROWS}, b AS (SELECT predictor - 60 AS u, control - 50 AS v, predictor / 5 AS su, CASE WHEN slot <> 2 THEN control / 7 END AS sv, lat AS n, 700 + control * 3 AS p FROM rows)
SELECT count(*) AS n, round(avg(sqrt(su * su + sv * sv)) / avg(sqrt(u * u + v * v)), 6) AS factor FROM b WHERE p >= 850 AND n >= 5 AND u IS NOT NULL AND v IS NOT NULL AND su IS NOT NULL AND sv IS NOT NULL""")
def spread_factor(spark, sf_dir):
    b = rows(spark, sf_dir).select((F.col("predictor") - 60).alias("u"), (F.col("control") - 50).alias("v"), (F.col("predictor") / 5).alias("su"), F.when(F.col("slot") != 2, F.col("control") / 7).alias("sv"), F.col("lat").alias("n"), (700 + F.col("control") * 3).alias("p"))
    return aggregates.spread_factor(b, "u", "v", "su", "sv", "n", "p").withColumn("factor", F.round("factor", 6))


def swath(spark, sf_dir):
    """Every cell of the 12 x 12 grid of every day, observed or not."""
    d = daily(spark, sf_dir)
    full = d.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("lat")).select("day", "lat", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("lon"))
    seen = d.select("day", "lat", "lon", (F.col("v") > 20).alias("seen"))
    return full.join(seen, ["day", "lat", "lon"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


@query("grd_gap_classes", f"""WITH RECURSIVE {DAILY}, g AS (SELECT d.day, i.i AS lat, j.j AS lon, coalesce(s.v > 20, FALSE) AS seen FROM (SELECT DISTINCT day FROM daily) d, (SELECT UNNEST(range(0, 12)) AS i) i, (SELECT UNNEST(range(0, 12)) AS j) j LEFT JOIN daily s ON s.day = d.day AND s.lat = i.i AND s.lon = j.j),
grown AS (SELECT a.day, a.lat, a.lon FROM g a JOIN g b ON a.day = b.day AND abs(a.lat - b.lat) <= 1 AND abs(a.lon - b.lon) <= 1 AND b.seen GROUP BY ALL),
closed AS (SELECT a.day, a.lat, a.lon FROM g a JOIN grown b ON a.day = b.day AND abs(a.lat - b.lat) <= 1 AND abs(a.lon - b.lon) <= 1 GROUP BY ALL HAVING count(*) = 9),
free AS (SELECT g.day, g.lat, g.lon FROM g ANTI JOIN closed USING (day, lat, lon)),
reach AS (SELECT day, lat, lon FROM free WHERE lat IN (0, 11) OR lon IN (0, 11) UNION SELECT f.day, f.lat, f.lon FROM reach r JOIN free f ON f.day = r.day AND abs(f.lat - r.lat) + abs(f.lon - r.lon) = 1)
SELECT g.day, CAST(g.lat AS INT) AS lat, CAST(g.lon AS INT) AS lon, CASE WHEN g.lat > 10 THEN 'out_of_domain' WHEN g.seen THEN 'observed' WHEN r.day IS NULL THEN 'cloud' ELSE 'out_of_swath' END AS gap FROM g LEFT JOIN reach r ON r.day = g.day AND r.lat = g.lat AND r.lon = g.lon""")
def gap_classes(spark, sf_dir):
    s = swath(spark, sf_dir)
    inside = grid.envelope(s, ["day"], "day date", "seen", 1)
    return s.join(inside, ["day", "lat", "lon"]).select("day", "lat", "lon", grid.gap_class(F.col("seen"), F.col("inside"), F.col("lat") <= 10).alias("gap"))


@query("grd_bicubic", f"""WITH {DAILY}, i AS (SELECT *, UNNEST(range(CAST(floor((lat - 2) / 1.4e0) AS BIGINT) + 1, CAST(ceil((lat + 2) / 1.4e0) AS BIGINT))) AS ilat FROM daily), j AS (SELECT *, UNNEST(range(CAST(floor((lon - 2) / 1.4e0) AS BIGINT) + 1, CAST(ceil((lon + 2) / 1.4e0) AS BIGINT))) AS ilon FROM i),
d AS (SELECT *, abs(lat - ilat * 1.4e0) AS a, abs(lon - ilon * 1.4e0) AS b FROM j), w AS (SELECT *, CASE WHEN a < 1 THEN 1.5 * a * a * a - 2.5 * a * a + 1 WHEN a < 2 THEN -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2 ELSE 0 END * CASE WHEN b < 1 THEN 1.5 * b * b * b - 2.5 * b * b + 1 WHEN b < 2 THEN -0.5 * b * b * b + 2.5 * b * b - 4 * b + 2 ELSE 0 END AS w FROM d)
SELECT day, ilat, ilon, round(CASE WHEN sum(w) > 0.5 THEN sum(v * w) / sum(w) END, 6) AS v FROM w GROUP BY ALL""")
def bicubic(spark, sf_dir):
    return grid.bicubic(daily(spark, sf_dir), ["day"], "v", 1.4).withColumn("v", F.round("v", 6))


@query("grd_lowest_level", f"""WITH {ROWS}, l AS (SELECT day, lat, lon, event_id, CASE WHEN predictor > 15 THEN 270 + predictor / 10 END AS t, control * 30 AS alt, lat * 100.0 AS ground, slot AS u FROM rows),
b AS (SELECT day, lat, lon, arg_max({{'t': t, 'alt': alt, 'ground': ground, 'u': u}}, event_id) AS b FROM l WHERE t IS NOT NULL AND alt IS NOT NULL GROUP BY ALL)
SELECT day, lat, lon, round(b.t + 0.0065 * greatest(b.alt - b.ground, 0), 6) AS t, b.u AS u, round(b.alt - b.ground, 6) AS above FROM b WHERE b.alt - b.ground <= 1500""")
def lowest_level(spark, sf_dir):
    """The latest event of a cell and day stands for the deepest level."""
    levels = rows(spark, sf_dir).select("day", "lat", "lon", "event_id", F.when(F.col("predictor") > 15, 270 + F.col("predictor") / 10).alias("t"), (F.col("control") * 30).alias("alt"), (F.col("lat") * 100.0).alias("ground"), F.col("slot").alias("u"))
    out = grid.lowest_level(levels, ["day", "lat", "lon"], "event_id", "t", "alt", "ground", ["u"])
    return out.withColumns({"t": F.round("t", 6), "above": F.round("above", 6)})


@query("trj_footprint", f"""WITH {PATH}, q AS (SELECT event_id, user_id, px / 20 AS y, py / 10 AS x, px * 20 AS alt, py * 15 AS depth, epoch_us(ts) / 3600000000 AS h FROM p),
r AS (SELECT *, (coalesce(h - lag(h) OVER w, 0) + coalesce(lead(h) OVER w - h, 0)) / 2 AS res, coalesce(sqrt(pow(y - lag(y) OVER w, 2) + pow(x - lag(x) OVER w, 2)), 0) AS piece, max(h) OVER (PARTITION BY user_id) - h AS lag_h FROM q WINDOW w AS (PARTITION BY user_id ORDER BY h)),
b AS (SELECT *, sum(piece) OVER (PARTITION BY user_id) - sum(piece) OVER (PARTITION BY user_id ORDER BY h) AS back FROM r),
m AS (SELECT *, 0.3 + 0.02 * back AS s, res * CASE WHEN depth <= 0 OR alt < 0 THEN 0 WHEN alt <= depth THEN 1.0 WHEN alt >= depth * 1.2 THEN 0.0 ELSE 1 - (alt - depth) / (depth * 0.2) END * CASE WHEN x > 3 THEN 1.0 ELSE 0.5 END AS mass FROM b WHERE lag_h <= 72),
k AS (SELECT *, CAST(CASE WHEN s < 0.5 THEN 0 ELSE ceil(s * 4) END AS BIGINT) AS r FROM m WHERE mass > 0), i AS (SELECT *, CAST(round_even(y, 0) AS BIGINT) + UNNEST(range(-r, r + 1)) AS ilat FROM k), c AS (SELECT *, CAST(round_even(x, 0) AS BIGINT) + UNNEST(range(-r, r + 1)) AS ilon FROM i),
w AS (SELECT *, CASE WHEN r = 0 THEN 1.0 WHEN pow(ilat - y, 2) + pow(ilon - x, 2) <= pow(s * 4, 2) THEN exp(-(pow(ilat - y, 2) + pow(ilon - x, 2)) / (2 * s * s)) ELSE 0.0 END AS w FROM c), t AS (SELECT *, sum(w) OVER (PARTITION BY event_id) AS t FROM w)
SELECT user_id, CAST(round_even(lag_h / 24, 0) AS INT) AS lag, CAST(ilat AS INT) AS ilat, CAST(ilon AS INT) AS ilon, round(sum(mass * w / t), 6) AS mass FROM t WHERE w > 0 GROUP BY ALL""")
def footprint(spark, sf_dir):
    """All points of the last three days of each path; the receptor is the user."""
    p = paths(spark, sf_dir).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0).alias("h"), (F.col("px") / 20).alias("y"), (F.col("py") / 10).alias("x"), (F.col("px") * 20).alias("alt"), (F.col("py") * 15).alias("depth"))
    out = trajectory.footprint(p, ["user_id"], ["user_id"], "h", "y", "x", contact=phys.contact_weight(F.col("alt"), F.col("depth")), sigma=0.3 + 0.02 * F.col("back"), land=F.when(F.col("x") > 3, 1.0).otherwise(0.5), most_lag=72, lag_hours=24)
    return out.withColumn("mass", F.round("mass", 6))


@query("clm_cell_report", f"""WITH {ROWS}, v AS (SELECT lat, lon, epoch_us(ts) // 1000000 AS s, max(predictor) AS p FROM rows WHERE event_type = 'view' GROUP BY ALL), q AS (SELECT DISTINCT day, lat, lon, slot, CAST(epoch(day) AS BIGINT) + slot * 14400 AS s FROM rows),
a AS (SELECT q.*, v.s AS s0, v.p AS v0 FROM q ASOF LEFT JOIN v ON q.lat = v.lat AND q.lon = v.lon AND q.s >= v.s), b AS (SELECT q.day, q.lat, q.lon, q.slot, v.s AS s1, v.p AS v1 FROM q ASOF LEFT JOIN v ON q.lat = v.lat AND q.lon = v.lon AND q.s <= v.s),
n AS (SELECT *, s0 IS NOT NULL AND (s1 IS NULL OR s - s0 <= s1 - s) AS early FROM a JOIN b USING (day, lat, lon, slot)),
x AS (SELECT *, CASE WHEN s0 = s1 THEN v0 WHEN s1 - s0 <= 43200 THEN v0 + (v1 - v0) * (s - s0) / (s1 - s0) WHEN early AND s - s0 <= 21600 THEN v0 WHEN NOT early AND s1 - s <= 21600 THEN v1 END AS p FROM n)
SELECT lat, lon, day, {", ".join(f"round(max(p) FILTER (WHERE slot = {k}), 6) AS p_{k}" for k in range(6))} FROM x GROUP BY ALL""")
def cell_report(spark, sf_dir):
    """Every cell and day: the values at its slots' times from the irregular views."""
    df = rows(spark, sf_dir)
    slots = df.select("lat", "lon", "day", "slot").distinct().withColumn("s", F.unix_timestamp(F.col("day").cast("timestamp")) + F.col("slot") * 14400)
    views = df.where("event_type = 'view'").groupBy("lat", "lon", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("vs")).agg(F.max("predictor").alias("p"))
    out = climatology.cell_report(slots, views, ["lat", "lon"], "day", "s", "vs", "p", range(6), 43_200, 21_600)
    return out.select("lat", "lon", "day", *[F.round(f"p_{k}", 6).alias(f"p_{k}") for k in range(6)])


@query("skill_fold_stability")
def stability(spark, sf_dir):
    """How alike the folds' fits of the distance from the middle value are; no SQL, a test compares with plain NumPy."""
    out = inversion.fold_stability(sample(spark, sf_dir).select("event_id", "day", "distance", "flag"), "distance", "flag", "day", "binned", 3)
    return out.withColumn("stability", F.round("stability", 5))


@query("bat_curves", f"""WITH {ROWS}, t AS (SELECT quantile_cont(target, 0.9) AS q FROM rows), s AS (SELECT u.id, u.x, CAST(target > q AS INT) AS flag, event_id FROM t, rows, LATERAL (VALUES ('value', predictor), ('factor', control), ('slot', CAST(slot AS DOUBLE)), ('distance', abs(predictor - 60))) u(id, x)),
b AS (SELECT id, x, flag, (row_number() OVER (PARTITION BY id ORDER BY x, event_id) - 1) * 20 // count(*) OVER (PARTITION BY id) AS bin FROM s), a AS (SELECT id, CAST(bin AS INT) AS bin, count(*) AS n, quantile_cont(x, 0.5) AS median, avg(flag) AS rate FROM b GROUP BY ALL)
SELECT id, bin, n, round(median, 6) AS median, round(rate, 6) AS rate, round(sqrt(rate * (1 - rate) / n), 6) AS se FROM a""")
def stored_curves(spark, sf_dir):
    """The curve of every test that is not inverted, written for a run and read back."""
    at = fresh_path(spark, "curves")
    suite.write_curves(suite.curves(sample(spark, sf_dir), [h for h in REGISTRY if not h.invert], "event_id"), at, "first")
    return suite.load_curves(spark, at, "first").select("id", "bin", "n", *[F.round(c, 6).alias(c) for c in ("median", "rate", "se")])


SCORES = {"value": "predictor", "factor": "control", "slot": "slot"}
TAIL = ROWS + """, t AS (SELECT quantile_cont(target, 0.9) AS p90, quantile_cont(target, 0.99) AS p99 FROM rows), s AS (SELECT u.id, u.x, event_id, target > p90 AS p90, target > p99 AS p99 FROM t, rows, LATERAL (VALUES ('value', CAST(predictor AS DOUBLE)), ('factor', CAST(control AS DOUBLE)), ('slot', CAST(slot AS DOUBLE))) u(id, x) WHERE x IS NOT NULL AND target IS NOT NULL),
b AS (SELECT id, CAST((row_number() OVER (PARTITION BY id ORDER BY x, event_id) - 1) * 100 // count(*) OVER (PARTITION BY id) AS INT) + 1 AS bin, p90, p99 FROM s),
r AS (SELECT id, label, bin, count(*) AS n, count(*) FILTER (WHERE flag) AS n_events FROM b, LATERAL (VALUES ('p90', p90), ('p99', p99)) l(label, flag) GROUP BY ALL),
tail AS (SELECT id, label, bin, n, n_events, sum(n_events / n) OVER (PARTITION BY id, label ORDER BY bin) / nullif(sum(n_events / n) OVER (PARTITION BY id, label), 0) AS cum_freq FROM r)"""


@query("bat_tail_curves", f"WITH {TAIL} SELECT id, label, bin, n, n_events, round(cum_freq, 6) AS cum_freq FROM tail")
def tail_curves(spark, sf_dir):
    """Tail curves of three scores at two set points, stored for a sample and read back."""
    found = suite.tail_curves(rows(spark, sf_dir), SCORES, "target", {"p90": 90, "p99": 99}, "event_id", absolute=False)
    at = fresh_path(spark, "tails")
    suite.write_tail_curves(found, at, "whole")
    results = spark.createDataFrame([(i,) for i in SCORES], "id string")
    return suite.load_tail_curves(results, at, "whole").withColumn("cum_freq", F.round("cum_freq", 6))


@query("bat_folders", f"""WITH {TAIL}, w AS (SELECT id, label, bin, printf('%d,%d,%d,%.6f', bin, n, n_events, cum_freq) AS text FROM tail)
SELECT id, 'tail_' || label || '.csv' AS file, count(*) + 1 AS n_lines, md5(string_agg(text, chr(10) ORDER BY bin)) AS body FROM w GROUP BY id, label""")
def folders(spark, sf_dir):
    """The same as one folder per test with a CSV file per set point, read back as text: lines and a digest of the body of each file."""
    found = suite.tail_curves(rows(spark, sf_dir), SCORES, "target", {"p90": 90, "p99": 99}, "event_id", absolute=False)
    found = written(found, "tails").withColumn("cum_freq", F.format_string("%.6f", "cum_freq"))
    at, columns = fresh_path(spark, "folders"), ["bin", "n", "n_events", "cum_freq"]
    files = [suite.csv_lines(found.where(F.col("label") == p), f"tail_{p}.csv", columns, ["bin"]) for p in ("p90", "p99")]
    suite.write_folders(files[0].unionByName(files[1]), at)
    texts = spark.read.schema("value string, id string, file string").text(at, wholetext=True)
    text = F.regexp_replace("value", "\n$", "")
    return texts.select("id", "file", F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.md5(F.regexp_replace(text, "^[^\n]*\n", "")).alias("body"))


@query("bat_presets", f"""WITH {CELLS}, p AS (SELECT day, lat, lon, slot, CASE WHEN x > 20 THEN x END AS a, CASE WHEN lat <> 3 THEN y END AS b, CASE WHEN slot < 5 OR lon < 6 THEN n END AS c FROM cells), k AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)
SELECT 'all' AS preset, count(*) AS n FROM k UNION ALL SELECT 'complete', count(*) FROM (SELECT * FROM k QUALIFY count(slot) OVER (PARTITION BY day, lat, lon) = 6) UNION ALL SELECT 'first_last', count(*) FROM p WHERE a IS NOT NULL AND c IS NOT NULL""")
def presets(spark, sf_dir):
    """Rows that each preset of a configuration admits."""
    p = cells(spark, sf_dir).select("day", "lat", "lon", "slot", F.when(F.col("x") > 20, F.col("x")).alias("a"), F.when(F.col("lat") != 3, F.col("y")).alias("b"), F.when((F.col("slot") < 5) | (F.col("lon") < 6), F.col("n")).alias("c"))
    parts = [suite.admitted(p, RunConfig.preset(name, ["a", "b", "c"]), ["day", "lat", "lon"], 6).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("preset"), "n") for name in ("all", "complete", "first_last")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("src_sample_counts", "SELECT CAST(o_custkey % 7 AS INT) AS part, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1")
def sample_counts(spark, sf_dir):
    """Orders that have a large line, by part of the customers."""
    lines = tables.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], "l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = tables.scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey"], "TRUE")
    return tables.count_samples(orders, lines, ["o_orderkey"], (F.col("o_custkey") % 7).cast("int"))


@query("src_stale_parts", f"WITH {CELLS} SELECT DISTINCT day AS part FROM cells WHERE lat = 3 AND CASE WHEN n > 1 THEN 3 END IS DISTINCT FROM 3")
def stale_parts(spark, sf_dir):
    """Days with a cell whose labels were not made under setting 3."""
    labels = cells(spark, sf_dir).where("lat = 3").withColumn("setting", F.when(F.col("n") > 1, 3))
    return tables.stale_parts(labels, F.col("day"), "setting", 3)
