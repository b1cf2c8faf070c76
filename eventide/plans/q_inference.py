"""Queries: inference, climatology, gap filling, physics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import also, query
from ..functions import physics as phys
from ..operators import climatology as clim
from ..operators import gapfill, inference, thresholds, trajectory, windows
from ..sources.scratch import written
from .frames import CELLS, DAILY, ROWS, cells, daily, rows
from .q_screens import PATH, paths
from .q_skill import FLAGGED, flagged


@query("inf_bin_day_matrix", f"WITH {FLAGGED}, b AS (SELECT day, flag, CAST((row_number() OVER (ORDER BY value, event_id) - 1) * 16 // count(*) OVER () AS INT) AS bin FROM flagged) SELECT bin, day, count(*) AS n, CAST(sum(flag) AS BIGINT) AS e FROM b GROUP BY bin, day")
def bin_day(spark, sf_dir):
    return inference.bin_day_matrix(flagged(spark, sf_dir), [], "predictor", "flag", "day", "event_id", 16)


@query("inf_block_bootstrap")
def block_bootstrap(spark, sf_dir):
    m = inference.bin_day_matrix(flagged(spark, sf_dir), ["event_type"], "predictor", "flag", "day", "event_id", 128)
    return inference.bootstrap(m, ["event_type"], "event_type string", reps=300)


@query("inf_fdr", f"""WITH {ROWS}, t AS (SELECT user_id, avg(CAST(control AS DOUBLE)) / 200 * CASE WHEN user_id % 9 = 0 THEN 0.01 ELSE 1 END AS p FROM rows GROUP BY user_id), u AS (SELECT user_id, round(p, 9) AS p FROM t), r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM u)
SELECT user_id, p, p <= (SELECT max(p) FROM r WHERE p <= 0.05 * k / m) AS fdr_significant FROM r""")
def fdr(spark, sf_dir):
    df = rows(spark, sf_dir)
    p = df.groupBy("user_id").agg((F.avg("control") / 200).alias("p")).withColumn("p", F.round(F.col("p") * F.when(F.col("user_id") % 9 == 0, 0.01).otherwise(1.0), 9))
    return inference.fdr(p)


@query("inf_trend", f"""WITH {ROWS}, h AS (SELECT event_type, slot, avg(predictor) AS g FROM rows GROUP BY ALL), f AS (SELECT event_type, regr_count(g, slot) AS n, regr_slope(g, slot) AS slope, regr_sxx(g, slot) AS xx, regr_syy(g, slot) AS yy, regr_sxy(g, slot) AS xy FROM h GROUP BY event_type)
SELECT event_type, CAST(n AS BIGINT) AS n, round(slope, 5) AS slope, round(sqrt((yy - slope * xy) / (n - 2) / xx), 5) AS se, abs(slope) > 2 * sqrt((yy - slope * xy) / (n - 2) / xx) AS significant FROM f""")
def trend(spark, sf_dir):
    h = rows(spark, sf_dir).groupBy("event_type", "slot").agg(F.avg("predictor").alias("g"))
    return inference.trend(h, "slot", "g", ["event_type"]).withColumns({"slope": F.round("slope", 5), "se": F.round("se", 5)})


@query("inf_partial_correlation", f"""WITH {ROWS}, c AS (SELECT event_type, corr(predictor, target) AS r, corr(predictor, control) AS a, corr(target, control) AS b FROM rows GROUP BY event_type)
SELECT event_type, round(r, 6) AS r, round((r - a * b) / sqrt((1 - a * a) * (1 - b * b)), 6) AS partial FROM c""")
def partial(spark, sf_dir):
    return inference.partial_correlation(rows(spark, sf_dir), "predictor", "target", "control", ["event_type"]).withColumns({"r": F.round("r", 6), "partial": F.round("partial", 6)})


@query("inf_origin_slope", f"WITH {ROWS} SELECT slot, round(sum(predictor * target) / sum(predictor * predictor), 6) AS slope FROM rows GROUP BY slot")
def origin_slope(spark, sf_dir):
    return inference.origin_slope(rows(spark, sf_dir), "predictor", "target", ["slot"]).withColumn("slope", F.round("slope", 6))


@query("inf_counts_bootstrap")
def counts_bootstrap(spark, sf_dir):
    from .q_grid import counts

    csi = phys.contingency_scores(*[F.col(c) for c in ("pred_hit", "pred_miss", "truth_hit", "truth_miss")])["csi"]
    return inference.counts_bootstrap(counts(spark, sf_dir), ["dilation"], "day", ["pred_hit", "pred_miss", "truth_hit", "truth_miss"], csi)


def permuted_gini(name: str, predictor: str, control: str) -> str:
    return f"""(WITH g AS (SELECT {predictor} * (1 + {control} / 50) AS s, count(*) AS n, sum(flag) AS e FROM m GROUP BY 1), r AS (SELECT *, sum(e) OVER (ORDER BY s) - e AS b FROM g)
SELECT '{name}' AS permuted, CAST(sum(n) AS BIGINT) AS n, CAST(sum(e) AS BIGINT) AS n_events, round(1 - 2 * CAST(sum(n * (b + CAST(e AS DOUBLE) / 2)) AS DOUBLE) / (CAST(sum(n) AS DOUBLE) * sum(e)), 6) AS gini FROM r)"""


@query("inf_permutation_importance", f"""WITH {FLAGGED}, k AS (SELECT event_id, predictor, control, flag, row_number() OVER (ORDER BY event_id) AS i, row_number() OVER (ORDER BY CAST('0x' || substr(md5('11:' || event_id), 1, 15) AS BIGINT)) AS j FROM flagged),
m AS (SELECT a.flag, a.predictor, a.control, b.predictor AS other_predictor, b.control AS other_control FROM k a JOIN k b ON a.i = b.j)
{permuted_gini("none", "predictor", "control")} UNION ALL {permuted_gini("predictor", "other_predictor", "control")} UNION ALL {permuted_gini("control", "predictor", "other_control")}""")
def permutation(spark, sf_dir):
    """Loss of Gini when a column is permuted over the rows."""
    df = written(rows(spark, sf_dir).select("event_id", "predictor", "control", "target"), "rows")  # read by every pass for the threshold
    (t,) = thresholds.percentile_thresholds(df, "target", [90])
    df = df.withColumn("flag", thresholds.exceeds("target", t))
    out = inference.permutation_importance(df, ["predictor", "control"], lambda c: c["predictor"] * (1 + c["control"] / 50), "flag", "event_id", 11)
    return out.select("permuted", "n", "n_events", F.round("gini", 6).alias("gini"))


HARMONIC = "2 * pi() / 365.25 * dayofyear(day)"


#: Least squares in 1, cos and sin of the year for each cell of at least nine days, by the determinants of the normal equations.
HARMONIC = DAILY + """, h AS (SELECT *, cos(2 * pi() / 365.25 * dayofyear(day)) AS c, sin(2 * pi() / 365.25 * dayofyear(day)) AS s FROM daily),
n AS (SELECT lat, lon, count(v) AS n, sum(c) AS c, sum(s) AS s, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS ss, sum(v) AS v, sum(c * v) AS cv, sum(s * v) AS sv FROM h WHERE v IS NOT NULL GROUP BY ALL),
d AS (SELECT *, n * (cc * ss - cs * cs) - c * (c * ss - cs * s) + s * (c * cs - cc * s) AS det FROM n WHERE n >= 9),
f AS (SELECT lat, lon, (v * (cc * ss - cs * cs) - c * (cv * ss - cs * sv) + s * (cv * cs - cc * sv)) / det AS b0, (n * (cv * ss - cs * sv) - v * (c * ss - cs * s) + s * (c * sv - cv * s)) / det AS b1, (n * (cc * sv - cv * cs) - c * (c * sv - cv * s) + v * (c * cs - cc * s)) / det AS b2 FROM d)"""


@query("clm_harmonic_anomaly", f"WITH {HARMONIC} SELECT day, h.lat, h.lon, round(v - (b0 + b1 * c + b2 * s), 5) AS anomaly FROM h LEFT JOIN f ON f.lat = h.lat AND f.lon = h.lon")
def harmonic_anomaly(spark, sf_dir):
    d = daily(spark, sf_dir)
    fit = clim.harmonic_fit(d, ["lat", "lon"], "v", "lat int, lon int", n=1)
    return clim.deseasonalise(d, fit, ["lat", "lon"], "v", "anomaly", n=1).select("day", "lat", "lon", F.round("anomaly", 5).alias("anomaly"))


@query("clm_overpass_to_slots", f"WITH {CELLS} SELECT day, slot, lat, lon, round(max(x) FILTER (WHERE slot = 2) OVER (PARTITION BY day, lat, lon), 6) AS x_overpass FROM cells")
def overpass(spark, sf_dir):
    return clim.overpass_to_slots(cells(spark, sf_dir), ["day", "lat", "lon"], "x", 2, "x_overpass").select("day", "slot", "lat", "lon", F.round("x_overpass", 6).alias("x_overpass"))


@query("clm_interpolate_slots", f"""WITH {CELLS}, k AS (SELECT day, lat, lon, max(x) FILTER (WHERE slot = 0) AS a, max(x) FILTER (WHERE slot = 1) AS b, max(x) FILTER (WHERE slot = 2) AS c FROM cells GROUP BY ALL)
SELECT day, lat, lon, 0 AS wanted_slot, round(a * 0.75 + b * 0.25, 6) AS x FROM k WHERE a IS NOT NULL OR b IS NOT NULL UNION ALL SELECT day, lat, lon, 1, round(c, 6) FROM k WHERE c IS NOT NULL""")
def interpolate_slots(spark, sf_dir):
    return clim.interpolate_slots(cells(spark, sf_dir), ["day", "lat", "lon"], "x", [2, 6, 10, 14, 18, 22], [3, 10, 23]).withColumn("x", F.round("x", 6))


@query("clm_monthly_diurnal", f"""WITH {ROWS}, c AS (SELECT lat, lon, CAST(hour(ts) // 3 AS INT) AS s, avg(predictor) AS v FROM rows GROUP BY ALL)
SELECT event_id, round(a.v + (b.v - a.v) * ((hour(ts) + minute(ts) / 60) - 3 * (hour(ts) // 3)) / 3, 9) AS clim FROM rows r LEFT JOIN c a ON a.lat = r.lat AND a.lon = r.lon AND a.s = hour(ts) // 3 LEFT JOIN c b ON b.lat = r.lat AND b.lon = r.lon AND b.s = (hour(ts) // 3 + 1) % 8""")
def monthly_diurnal(spark, sf_dir):
    df = rows(spark, sf_dir)
    table = df.groupBy("lat", "lon", F.month("day").alias("month"), F.expr("CAST(hour(ts) div 3 AS INT)").alias("slot")).agg(F.avg("predictor").alias("v"))
    hour = F.hour("ts") + F.minute("ts") / 60
    return clim.monthly_diurnal(df, table, ["lat", "lon"], F.month("day"), hour, "v", "clim").select("event_id", F.round("clim", 9).alias("clim"))


@query("clm_prewindow_daily", f"WITH {CELLS}, d AS (SELECT day, lat, lon, avg(x) FILTER (WHERE slot < 3) AS pre FROM cells GROUP BY ALL) SELECT a.day, a.lat, a.lon, round(a.pre, 6) AS pre, round(b.pre, 6) AS pre_lag1 FROM d a LEFT JOIN d b ON a.lat = b.lat AND a.lon = b.lon AND b.day = a.day - 1")
def prewindow(spark, sf_dir):
    d = cells(spark, sf_dir).groupBy("day", "lat", "lon").agg(F.avg(F.when(F.col("slot") < 3, F.col("x"))).alias("pre"))
    return windows.calendar_lags(d, ["lat", "lon"], "pre", [1]).select("day", "lat", "lon", F.round("pre", 6).alias("pre"), F.round("pre_lag1", 6).alias("pre_lag1"))


def gappy(spark, sf_dir):
    return gapfill.hidden(daily(spark, sf_dir), "v", (F.col("lat") * 7 + F.col("lon") * 3 + F.dayofmonth("day")) % 4 == 0)


@query("gap_krige")
def krige(spark, sf_dir):
    return gapfill.fill(gappy(spark, sf_dir), ["day"], "day date", "v", "krige").withColumn("filled", F.round("filled", 5))


NEAREST = DAILY + """, g AS (SELECT day, lat, lon, v AS truth, CASE WHEN (lat * 7 + lon * 3 + day(day)) % 4 <> 0 THEN v END AS v FROM daily),
k AS (SELECT a.day, a.lat, a.lon, arg_min(b.v, (pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2), b.lat, b.lon)) AS f FROM g a JOIN g b ON a.day = b.day AND b.v IS NOT NULL WHERE a.v IS NULL GROUP BY a.day, a.lat, a.lon)"""


@query("gap_nearest", f"WITH {NEAREST} SELECT day, lat, lon, round(coalesce(v, f), 6) AS filled, CASE WHEN v IS NOT NULL THEN 0 WHEN f IS NOT NULL THEN 1 ELSE -1 END AS gap_type FROM g LEFT JOIN k USING (day, lat, lon)")
def nearest(spark, sf_dir):
    out = gapfill.fill(gappy(spark, sf_dir), ["day"], "day date", "v", "nearest")
    return out.select("day", "lat", "lon", F.round("filled", 6).alias("filled"), F.col("gap_type").cast("int").alias("gap_type"))


@query("gap_mean_metrics", f"""WITH {NEAREST}, m AS (SELECT *, coalesce(v, avg(v) OVER (PARTITION BY day)) AS filled FROM g), s AS (SELECT 'all' AS kind, 'all' AS stratum, truth, filled FROM m WHERE v IS NULL UNION ALL SELECT 'lat', CASE WHEN lat < 6 THEN 'south' ELSE 'north' END, truth, filled FROM m WHERE v IS NULL)
SELECT kind, stratum, count(*) AS n, round(avg(filled - truth), 5) AS bias, round(sqrt(avg(pow(filled - truth, 2))), 5) AS rmse, round(corr(filled, truth), 5) AS corr FROM s WHERE truth IS NOT NULL AND filled IS NOT NULL GROUP BY kind, stratum""")
def mean_metrics(spark, sf_dir):
    m = gapfill.fill_mean(gappy(spark, sf_dir), ["day"], "v").where("v IS NULL")
    out = gapfill.reconstruction_metrics(m, {"all": F.lit("all"), "lat": F.when(F.col("lat") < 6, "south").otherwise("north")})
    return out.withColumns({c: F.round(c, 5) for c in ("bias", "rmse", "corr")})


@query("gap_two_source", f"""WITH {DAILY}, a AS (SELECT day, lat, lon, v, n / 5.0 AS f FROM daily WHERE lat % 3 <> 0), b AS (SELECT day, lat, lon, v + 1 AS w FROM daily WHERE lon % 2 = 0)
SELECT day, lat, lon, round(CASE WHEN f >= 0.5 AND v IS NOT NULL THEN v ELSE w END, 6) AS v, CASE WHEN f >= 0.5 AND v IS NOT NULL THEN 'primary' WHEN w IS NOT NULL THEN 'backup' END AS source FROM a FULL JOIN b USING (day, lat, lon)""")
def two_source(spark, sf_dir):
    d = daily(spark, sf_dir)
    a = d.where("lat % 3 <> 0").select("day", "lat", "lon", "v", (F.col("n") / 5.0).alias("valid_frac"))
    b = d.where("lon % 2 = 0").select("day", "lat", "lon", (F.col("v") + 1).alias("v"))
    return gapfill.two_source(a, b, ["day", "lat", "lon"], "v", 0.5).withColumn("v", F.round("v", 6))


@query("fn_geo", f"""WITH {ROWS} SELECT event_id, round(111.195 * cos(radians(control / 2)), 6) AS km_lon, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(slot) / 2), 2) + cos(radians(control / 2)) * cos(radians(control / 2 + slot)) * pow(sin(radians(lon) / 2), 2)))), 5) AS km,
round((hour(ts) + lon * 10 / 15) % 24, 6) AS solar, CASE WHEN hour(ts) < 12 THEN hour(ts) + 24 ELSE hour(ts) END AS linear, CAST(floor(lon * 10.0 / 45 + 0.5) AS INT) AS slot_offset FROM rows""")
def geo(spark, sf_dir):
    lat, lon = F.col("control") / 2, F.col("lon") * 10.0
    return rows(spark, sf_dir).select(
        "event_id", F.round(phys.km_per_deg_lon(lat), 6).alias("km_lon"), F.round(phys.haversine_km(lat, lon, lat + F.col("slot"), lon + F.col("lon")), 5).alias("km"),
        F.round(phys.local_solar_hour(lon, F.hour("ts")), 6).alias("solar"), phys.linear_hour(F.hour("ts")).cast("long").alias("linear"), phys.local_slot_offset(lon).alias("slot_offset"),
    )


@query("fn_thermo", f"""WITH {ROWS}, b AS (SELECT event_id, 270 + control / 3 AS t, 0.001 + predictor / 100000 AS r, 1000 - slot * 50 AS p FROM rows), e AS (SELECT *, ln(r * p / (0.622 + r) / 6.112) AS x FROM b), d AS (SELECT *, 243.5 * x / (17.67 - x) + 273.15 AS td FROM e), l AS (SELECT *, 1 / (1 / (td - 56) + ln(t / td) / 800) + 56 AS lcl FROM d)
SELECT event_id, round(td, 6) AS td, round(t * (1 + r / 0.622) / (1 + r), 6) AS tv, round(r * p / (0.622 + r) / (6.112 * exp(17.67 * (t - 273.15) / (t - 273.15 + 243.5))), 6) AS rh,
round(t * pow(1000 / p, 0.2854 * (1 - 0.00028 * r * 1000)) * exp((3.376 / lcl - 0.00254) * r * 1000 * (1 + 0.00081 * r * 1000)), 5) AS theta_e FROM l""")
def thermo(spark, sf_dir):
    t, r, p = 270 + F.col("control") / 3, 0.001 + F.col("predictor") / 100000, 1000 - F.col("slot") * 50.0
    return rows(spark, sf_dir).select("event_id", F.round(phys.dew_point_k(r, p), 6).alias("td"), F.round(phys.virtual_k(t, r), 6).alias("tv"), F.round(phys.relative_humidity(t, r, p), 6).alias("rh"), F.round(phys.theta_e(t, r, p), 5).alias("theta_e"))


@query("fn_contact_and_discount", f"""WITH {ROWS}, c AS (SELECT event_id, predictor * 20 AS alt, control * 15 AS depth, predictor AS q FROM rows)
SELECT event_id, round(CASE WHEN depth <= 0 OR alt < 0 THEN 0.0 WHEN alt <= depth THEN 1.0 WHEN alt >= depth * 1.2 THEN 0.0 ELSE 1 - (alt - depth) / (depth * 0.2) END, 6) AS contact, round(greatest(0, least(1, 50 / q)), 6) AS discount, round(20 + 0.1 * q, 6) AS sigma FROM c""")
def contact(spark, sf_dir):
    alt, depth, q = F.col("predictor") * 20, F.col("control") * 15, F.col("predictor")
    return rows(spark, sf_dir).select("event_id", F.round(phys.contact_weight(alt, depth), 6).alias("contact"), F.round(phys.condensation_discount(F.lit(50.0), q), 6).alias("discount"), F.round(phys.spread_km(q), 6).alias("sigma"))


@query("fn_solar", f"""WITH {ROWS}, z AS (SELECT event_id, radians(-23.44) * cos(2 * pi() * (dayofyear(ts) + 10) / 365.0) AS dec, radians(((hour(ts) + lon * 10 / 15.0) % 24 - 12) * 15) AS ha, radians(control / 2) AS la FROM rows), m AS (SELECT event_id, greatest(0.0, sin(la) * sin(dec) + cos(la) * cos(dec) * cos(ha)) AS mu FROM z)
SELECT event_id, round(mu, 6) AS mu, round(1361.0 * mu * 0.75, 4) AS flux FROM m""")
def solar(spark, sf_dir):
    mu = phys.cos_zenith(F.col("control") / 2, F.col("lon") * 10.0, F.dayofyear("ts"), F.hour("ts"))
    return rows(spark, sf_dir).select("event_id", F.round(mu, 6).alias("mu"), F.round(phys.clear_sky_flux(mu), 4).alias("flux"))


@query("trj_resample", f"""WITH {PATH}, q AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, px, py FROM p),
s AS (SELECT user_id, t AS a, lead(t) OVER w AS b, px, lead(px) OVER w AS px1, py, lead(py) OVER w AS py1, min(t) OVER (PARTITION BY user_id) AS t0 FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t, px, py)),
g AS (SELECT *, UNNEST(range(t0 + CAST(ceil((a - t0) / 3600) AS BIGINT) * 3600, b, 3600)) AS t FROM s WHERE b > a)
SELECT user_id, t, round(px + (px1 - px) * ((t - a) / (b - a)), 5) AS px, round(py + (py1 - py) * ((t - a) / (b - a)), 5) AS py FROM g UNION ALL SELECT user_id, a, round(px, 5), round(py, 5) FROM s WHERE b IS NULL""")
def resample(spark, sf_dir):
    p = paths(spark, sf_dir).select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "px", "py")
    out = trajectory.resample(p, ["user_id"], "t", ["px", "py"], 3600)
    return out.select("user_id", "t", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"))


@query("trj_deposit", f"""WITH {PATH}, q AS (SELECT event_id, user_id, px / 20 AS y, py / 10 AS x, 0.5 + py / 100 AS s FROM p), r AS (SELECT *, CAST(CASE WHEN s < 0.5 THEN 0 ELSE ceil(s * 4) END AS BIGINT) AS r FROM q),
i AS (SELECT *, CAST(round_even(y, 0) AS BIGINT) + UNNEST(range(-r, r + 1)) AS ilat FROM r), c AS (SELECT *, CAST(round_even(x, 0) AS BIGINT) + UNNEST(range(-r, r + 1)) AS ilon FROM i),
w AS (SELECT *, CASE WHEN r = 0 THEN 1.0 WHEN pow(ilat - y, 2) + pow(ilon - x, 2) <= pow(s * 4, 2) THEN exp(-(pow(ilat - y, 2) + pow(ilon - x, 2)) / (2 * s * s)) ELSE 0.0 END AS w FROM c), t AS (SELECT *, sum(w) OVER (PARTITION BY event_id) AS t FROM w)
SELECT user_id, CAST(ilat AS INT) AS ilat, CAST(ilon AS INT) AS ilon, round(sum(w / t), 8) AS mass FROM t WHERE w > 0 GROUP BY ALL""")
def deposit(spark, sf_dir):
    """All points of all paths; the spread follows the control, which bounds it."""
    spread = 0.5 + F.col("py") / 100
    p = paths(spark, sf_dir).select("user_id", (F.col("px") / 20).alias("y"), (F.col("py") / 10).alias("x"), spread.alias("s"), F.lit(1.0).alias("m"))
    return trajectory.deposit(p, ["user_id"], "y", "x", "s", "m").withColumn("mass", F.round("mass", 8))


also("trj_deposit", "trj_deposit_whole")


@query("trj_containment", f"""WITH {ROWS}, c AS (SELECT event_type, slot, avg(predictor) AS cx, avg(control) AS cy, count(*) AS n FROM rows GROUP BY ALL), d AS (SELECT r.event_type, r.slot, cx, cy, n, sqrt(pow(predictor - cx, 2) + pow(control - cy, 2)) AS d FROM rows r JOIN c USING (event_type, slot)), k AS (SELECT *, row_number() OVER (PARTITION BY event_type, slot ORDER BY d) AS k FROM d)
SELECT event_type, slot, round(cx, 6) AS cx, round(cy, 6) AS cy, round(CASE WHEN n >= 20 THEN min(d) FILTER (WHERE k >= ceil(0.9 * n)) END, 6) AS radius FROM k GROUP BY event_type, slot, cx, cy, n""")
def containment(spark, sf_dir):
    out = trajectory.containment(rows(spark, sf_dir), ["event_type", "slot"], "predictor", "control")
    return out.select("event_type", "slot", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "radius")])


KERNEL = ROWS + ", k AS (SELECT lat, lon, slot AS lag, CAST(control AS INT) % 5 - 2 AS dlat, CAST(floor(predictor) AS INT) % 7 - 3 AS dlon, sum(predictor) AS raw FROM rows GROUP BY ALL), kk AS (SELECT *, CASE WHEN abs(dlat) <= 1 AND lag <> 4 THEN raw ELSE 0 END AS masked FROM k)"


def kernel(spark, sf_dir):
    k = rows(spark, sf_dir).groupBy("lat", "lon", F.col("slot").alias("lag"), (F.col("control").cast("int") % 5 - 2).alias("dlat"), (F.floor("predictor").cast("int") % 7 - 3).alias("dlon")).agg(F.sum("predictor").alias("raw"))
    return k.withColumn("masked", F.when((F.abs("dlat") <= 1) & (F.col("lag") != 4), F.col("raw")).otherwise(0.0))


@query("trj_normalise_per_lag", f"""WITH {KERNEL}, u AS (SELECT *, CASE WHEN sum(masked) OVER w = 0 AND sum(raw) OVER w > 0 THEN raw ELSE masked END AS u FROM kk WINDOW w AS (PARTITION BY lat, lon, lag))
SELECT lat, lon, lag, dlat, dlon, round(u / nullif(sum(u) OVER (PARTITION BY lat, lon, lag), 0), 6) AS kernel, round(sum(u) OVER (PARTITION BY lat, lon, lag) / nullif(sum(u) OVER (PARTITION BY lat, lon), 0), 6) AS lag_weight FROM u""")
def normalise_per_lag(spark, sf_dir):
    out = trajectory.normalise_per_lag(kernel(spark, sf_dir), ["lat", "lon"], "lag", "raw", "masked")
    return out.select("lat", "lon", "lag", "dlat", "dlon", F.round("kernel", 6).alias("kernel"), F.round("lag_weight", 6).alias("lag_weight"))


@query("trj_kernel_shape", f"WITH {KERNEL}, s AS (SELECT lat, lon, sum(raw) AS total, sum(raw * dlat) / sum(raw) AS clat, sum(raw * dlon) / sum(raw) AS clon, sum(raw * lag) / sum(raw) AS mean_lag FROM k GROUP BY lat, lon) SELECT lat, lon, round(total, 5) AS total, round(clat, 6) AS clat, round(clon, 6) AS clon, round(mean_lag, 6) AS mean_lag, round(sqrt(clat * clat + clon * clon), 6) AS fetch FROM s")
def kernel_shape(spark, sf_dir):
    out = trajectory.kernel_shape(kernel(spark, sf_dir), ["lat", "lon"], "raw", "dlat", "dlon", "lag")
    return out.select("lat", "lon", F.round("total", 5).alias("total"), *[F.round(c, 6).alias(c) for c in ("clat", "clon", "mean_lag", "fetch")])


FOOTPRINT_TOTALS = f"""WITH {PATH}, h AS (SELECT *, epoch_us(ts) / 3600000000 AS h FROM p), r AS (SELECT *, (coalesce(h - lag(h) OVER w, 0) + coalesce(lead(h) OVER w - h, 0)) / 2 AS res, last_value(h) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - h AS back FROM h WINDOW w AS (PARTITION BY user_id ORDER BY step))
SELECT user_id, CAST(round_even(back / 24, 0) AS INT) AS lag, round(sum(res * CASE WHEN px * 20 <= py * 15 THEN 1.0 WHEN px * 20 >= py * 15 * 1.2 THEN 0.0 ELSE 1 - (px * 20 - py * 15) / (py * 15 * 0.2) END), 5) AS mass FROM r GROUP BY ALL"""


@query("trj_footprint_totals", FOOTPRINT_TOTALS)
def footprint_totals(spark, sf_dir):
    """Contact-weighted residence hours per path and day back from its end."""
    from pyspark.sql import Window

    df = paths(spark, sf_dir).withColumn("h", F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0)
    df = windows.residence_hours(df, ["user_id"], "step", "h", "res").withColumn("back", F.max("h").over(Window.partitionBy("user_id")) - F.col("h"))
    mass = F.sum(F.col("res") * phys.contact_weight(F.col("px") * 20, F.col("py") * 15))
    return df.groupBy("user_id", F.rint(F.col("back") / 24).cast("int").alias("lag")).agg(F.round(mass, 5).alias("mass"))


also("trj_footprint_totals", "trj_footprint_totals_whole")
