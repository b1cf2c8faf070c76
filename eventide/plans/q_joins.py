"""Queries: joins on keys and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import also, query
from ..operators import asof
from .frames import CELLS, DAILY, ROWS, cells, daily, load, rows

CELL_DAY = ["day", "lat", "lon"]


@query("jn_left_daily", f"WITH {CELLS}, daily AS (SELECT day, lat, lon, avg(predictor) AS v FROM rows WHERE slot < 3 GROUP BY ALL) SELECT day, slot, lat, lon, round(x, 6) AS x, round(v, 6) AS v FROM cells LEFT JOIN daily USING (day, lat, lon)")
def left_daily(spark, sf_dir):
    early = rows(spark, sf_dir).where("slot < 3").groupBy(*CELL_DAY).agg(F.avg("predictor").alias("v"))
    return cells(spark, sf_dir).join(early, CELL_DAY, "left").select("day", "slot", "lat", "lon", F.round("x", 6).alias("x"), F.round("v", 6).alias("v"))


@query("jn_merge_normalised", "SELECT o_orderkey, round(o_totalprice, 2) AS total, sum_qty FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS sum_qty FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def merge_normalised(spark, sf_dir):
    """Left join with checked one-to-one keys, here floating-point ones."""
    left = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("double").alias("key"), "o_totalprice")
    right = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("double").alias("key")).agg(F.sum("l_quantity").alias("sum_qty"))
    return asof.merge_left(left, right, ["key"]).select(F.col("key").cast("long").alias("o_orderkey"), F.round("o_totalprice", 2).alias("total"), "sum_qty")


@query("jn_multi_source", f"""WITH {DAILY}, c AS (SELECT lat, lon, avg(v) AS clim FROM daily GROUP BY ALL), e AS (SELECT day, lat, lon, count(*) AS errors FROM rows WHERE event_type = 'error' GROUP BY ALL)
SELECT day, lat, lon, round(v - clim, 8) AS anomaly, errors FROM daily LEFT JOIN c USING (lat, lon) LEFT JOIN e USING (day, lat, lon)""")
def multi_source(spark, sf_dir):
    d = daily(spark, sf_dir)
    clim = d.groupBy("lat", "lon").agg(F.avg("v").alias("clim"))
    errors = rows(spark, sf_dir).where("event_type = 'error'").groupBy(*CELL_DAY).agg(F.count(F.lit(1)).alias("errors"))
    return d.join(clim, ["lat", "lon"], "left").join(errors, CELL_DAY, "left").select("day", "lat", "lon", F.round(F.col("v") - F.col("clim"), 8).alias("anomaly"), "errors")


@query("jn_align_times", f"WITH {ROWS} SELECT day, slot FROM rows WHERE event_type = 'view' AND predictor > 100 INTERSECT SELECT day, slot FROM rows WHERE event_type = 'click' AND predictor > 100")
def align_times(spark, sf_dir):
    df = rows(spark, sf_dir).where("predictor > 100")
    a, b = (df.where(F.col("event_type") == t).select("day", "slot").distinct() for t in ("view", "click"))
    return a.join(b, ["day", "slot"], "inner")


@query("jn_semi_reference", f"WITH {ROWS} SELECT event_id FROM rows WHERE (day, slot) IN (SELECT day, slot FROM rows WHERE target > 20000)")
def semi_reference(spark, sf_dir):
    df = rows(spark, sf_dir)
    return df.join(df.where("target > 20000").select("day", "slot"), ["day", "slot"], "left_semi").select("event_id")


@query("jn_anti_unlabelled", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("jn_floor_bulletin", f"""WITH {ROWS}, f AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) // 10800 * 10800 AS bulletin FROM rows), b AS (SELECT bulletin, count(*) AS n FROM f GROUP BY 1 HAVING count(*) % 2 = 0)
SELECT event_id, bulletin, n FROM f LEFT JOIN b USING (bulletin)""")
def floor_bulletin(spark, sf_dir):
    """Each event with the 3-hourly bulletin that governs it; a missing bulletin gives null."""
    f = rows(spark, sf_dir).select("event_id", asof.floor_time("ts", 3).alias("bulletin"))
    b = f.groupBy("bulletin").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0")
    return f.join(b, "bulletin", "left").select("event_id", "bulletin", "n")


T_ROWS = ROWS + ", t AS (SELECT event_id, user_id, event_type, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, predictor FROM rows)"


def timed(spark, sf_dir):
    return rows(spark, sf_dir).select("event_id", "user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("s"), "predictor")


@query("jn_nearest_within", f"""WITH {T_ROWS}, m AS (SELECT a.event_id, b.s AS rs, b.predictor AS rp, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.s - b.s), b.s, b.predictor) AS k
FROM t a JOIN t b ON a.user_id = b.user_id AND b.event_type = 'signup' AND abs(a.s - b.s) <= 14400 WHERE a.event_type = 'click')
SELECT t.event_id, rs, rp FROM t LEFT JOIN (SELECT * FROM m WHERE k = 1) m ON t.event_id = m.event_id WHERE t.event_type = 'click'""")
def nearest_within(spark, sf_dir):
    t = timed(spark, sf_dir)
    right = t.where("event_type = 'signup'").select("user_id", F.col("s").alias("rs"), F.col("predictor").alias("rp"))
    return asof.nearest_within(t.where("event_type = 'click'"), right, ["user_id"], "s", "rs", 14400, "event_id", ["rp"]).select("event_id", "rs", "rp")


@query("jn_last_before", f"""WITH {T_ROWS}, r AS (SELECT user_id, s, max(predictor) AS p FROM t WHERE event_type = 'signup' GROUP BY ALL)
SELECT a.event_id, r.s AS rs_before, r.p AS rp FROM (SELECT * FROM t WHERE event_type = 'click') a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.s > r.s""")
def last_before(spark, sf_dir):
    t = timed(spark, sf_dir)
    right = t.where("event_type = 'signup'").groupBy("user_id", F.col("s").alias("rs")).agg(F.max("predictor").alias("rp"))
    return asof.last_before(t.where("event_type = 'click'"), right, ["user_id"], "s", "rs", ["rp"]).select("event_id", "rs_before", "rp")


@query("jn_last_at_or_before", """WITH o AS (SELECT o_custkey, o_orderdate, max(o_totalprice) AS p FROM orders GROUP BY ALL), c AS (SELECT o_orderkey, min(o_custkey) AS o_custkey FROM orders GROUP BY 1),
k AS (SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey FROM lineitem LEFT JOIN c ON l_orderkey = o_orderkey)
SELECT k.l_orderkey, k.l_linenumber, k.l_shipdate, o.p FROM k ASOF LEFT JOIN o ON k.o_custkey = o.o_custkey AND k.l_shipdate >= o.o_orderdate""")
def last_at_or_before(spark, sf_dir):
    """Every lineitem row with its customer's last order; a row without one stays, with null."""
    orders = load(spark, sf_dir, "orders")
    right = orders.where("o_custkey IS NOT NULL").groupBy("o_custkey", "o_orderdate").agg(F.max("o_totalprice").alias("p"))
    customers = orders.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.min("o_custkey").alias("o_custkey"))
    left = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(customers, "l_orderkey", "left")
    return asof.last_before(left, right, ["o_custkey"], "l_shipdate", "o_orderdate", ["p"], strictly=False).select("l_orderkey", "l_linenumber", "l_shipdate", "p")


also("jn_last_at_or_before", "jn_last_at_or_before_whole")


@query("jn_bracketed", f"""WITH {T_ROWS}, r AS (SELECT user_id, s, max(predictor) AS v FROM t WHERE event_type = 'view' GROUP BY ALL), q AS (SELECT event_id, user_id, s FROM t WHERE event_type = 'click'),
a AS (SELECT q.*, r.s AS s0, r.v AS v0 FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.s >= r.s), b AS (SELECT q.event_id, r.s AS s1, r.v AS v1 FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.s <= r.s)
SELECT event_id, round(CASE WHEN s0 = s1 THEN v0 WHEN s1 - s0 <= 172800 THEN v0 + (v1 - v0) * (s - s0) / (s1 - s0) END, 5) AS v FROM a JOIN b USING (event_id)""")
def bracketed(spark, sf_dir):
    t = timed(spark, sf_dir)
    right = t.where("event_type = 'view'").groupBy("user_id", F.col("s").alias("rs")).agg(F.max("predictor").alias("rv"))
    out = asof.bracketed(t.where("event_type = 'click'").select("event_id", "user_id", "s"), right, ["user_id"], "s", "rs", "rv", 172800, "v")
    return out.select("event_id", F.round("v", 5).alias("v"))


FALLBACK = f"""WITH {DAILY}, cd AS (SELECT day, lat, lon, avg(v) AS a FROM daily WHERE n >= 4 GROUP BY ALL), c AS (SELECT lat, lon, avg(v) AS b FROM daily WHERE lat < 6 GROUP BY ALL),
f AS (SELECT day, lat, lon, coalesce(a, b, 50.0) AS v, CASE WHEN a IS NOT NULL THEN 'assessed' WHEN b IS NOT NULL THEN 'climatology' ELSE 'analytic' END AS source FROM daily LEFT JOIN cd USING (day, lat, lon) LEFT JOIN c USING (lat, lon))"""


def depth(spark, sf_dir):
    d = daily(spark, sf_dir)
    assessed = d.where("n >= 4").groupBy(*CELL_DAY).agg(F.avg("v").alias("a"))
    climatology = d.where("lat < 6").groupBy("lat", "lon").agg(F.avg("v").alias("b"))
    out = asof.fallback(d.select(*CELL_DAY), [("assessed", assessed, CELL_DAY, "a"), ("climatology", climatology, ["lat", "lon"], "b")], "v")
    return out.withColumn("v", F.coalesce("v", F.lit(50.0))).withColumn("source", F.coalesce("source", F.lit("analytic")))


@query("jn_fallback_chain", FALLBACK + " SELECT day, lat, lon, round(v, 6) AS v, source FROM f")
def fallback_chain(spark, sf_dir):
    return depth(spark, sf_dir).select(*CELL_DAY, F.round("v", 6).alias("v"), "source")


@query("jn_fallback_tally", FALLBACK + " SELECT source, count(*) AS n FROM f GROUP BY source")
def fallback_tally(spark, sf_dir):
    return depth(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("jn_point_to_cell", f"WITH {ROWS} SELECT CAST(floor(predictor / 25) AS BIGINT) AS ilat, CAST(rint(control / 10) AS BIGINT) AS ilon, count(*) AS n FROM rows GROUP BY ALL".replace("rint(control / 10)", "round_even(control / 10, 0)"))
def point_to_cell(spark, sf_dir):
    """Points to grid cells by a computed key: floor on one axis, half-to-even rounding on the other."""
    return rows(spark, sf_dir).groupBy(F.floor(F.col("predictor") / 25).alias("ilat"), F.rint(F.col("control") / 10).cast("long").alias("ilon")).agg(F.count(F.lit(1)).alias("n"))


@query("jn_kernel_surface", f"""WITH {DAILY}, k AS (SELECT lat, lon, dlat, dlon, 1.0 / (1 + abs(dlat) + abs(dlon)) AS w FROM (SELECT DISTINCT lat, lon FROM daily), (VALUES (-1), (0), (1)) a(dlat), (VALUES (-1), (0), (1)) b(dlon)),
s AS (SELECT lat, lon, avg(v) AS v FROM daily WHERE (lat + lon) % 5 <> 0 GROUP BY ALL)
SELECT k.lat, k.lon, round(sum(w * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0), 6) AS value, round(sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END) / sum(w), 6) AS coverage
FROM k LEFT JOIN s ON s.lat = k.lat + dlat AND s.lon = k.lon + dlon GROUP BY k.lat, k.lon""")
def kernel_surface(spark, sf_dir):
    from ..operators.trajectory import apply_kernel

    d = daily(spark, sf_dir)
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dlat"), F.lit(b).alias("dlon"), F.lit(1.0 / (1 + abs(a) + abs(b))).alias("w")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    kernel = d.select("lat", "lon").distinct().select("lat", "lon", offsets.alias("o")).select("lat", "lon", "o.*").select("lat", "lon", (F.col("lat") + F.col("dlat")).alias("slat"), (F.col("lon") + F.col("dlon")).alias("slon"), "w")
    surface = d.where("(lat + lon) % 5 <> 0").groupBy(F.col("lat").alias("slat"), F.col("lon").alias("slon")).agg(F.avg("v").alias("v"))
    out = apply_kernel(kernel, surface, ["lat", "lon"], ["slat", "slon"], "w", "v")
    return out.select("lat", "lon", F.round("value", 6).alias("value"), F.round("coverage", 6).alias("coverage"))
