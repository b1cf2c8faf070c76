"""Queries: point reads, expected swaths, base tables of a configuration, pooled results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions.physics import cycle_day
from ..operators import aggregates, grid, krige_blocks, pooling
from ..sources.point_scan import lay_out, point_profile
from ..sources.scratch import fresh_path
from ..sources.tables import newest
from .base_table import BaseConfig, build_base_table, prepare
from .frames import CELLS, DAILY, ROWS, cells, daily, rows
from .q_fields import swath


@query("src_point_profile", f"""WITH {CELLS}, d AS (SELECT min(day) AS d0 FROM cells)
SELECT day, slot, lat, lon, round(nullif(greatest(x - 40, 0), 0), 6) AS qv FROM cells, d WHERE lat = 4 AND lon = 8 AND day BETWEEN d0 AND d0 + 1""")
def point_profile_query(spark, sf_dir):
    """The whole table laid out for point reads, then the cell nearest to a place on the first two days; zeros are missing."""
    df = cells(spark, sf_dir).select("day", "slot", "lat", "lon", F.greatest(F.col("x") - 40, F.lit(0.0)).alias("qv"))
    at = fresh_path(spark, "points")
    lay_out(df, at, band=4.0)
    first = df.agg(F.min("day")).first()[0]
    out = point_profile(spark, at, (3.6, 8.4), first, positive=["qv"], band=4.0)
    return out.select("day", "slot", "lat", "lon", F.round("qv", 6).alias("qv"))


@query("grd_expected_swath", f"""WITH RECURSIVE {DAILY}, g AS (SELECT d.day, i.i AS lat, j.j AS lon, coalesce(s.v > 20, FALSE) AS seen FROM (SELECT DISTINCT day FROM daily) d, (SELECT UNNEST(range(0, 12)) AS i) i, (SELECT UNNEST(range(0, 12)) AS j) j LEFT JOIN daily s ON s.day = d.day AND s.lat = i.i AND s.lon = j.j),
bank AS (SELECT CAST((day - DATE '2000-01-01') % 16 AS INT) AS cyc, lat, lon, avg(CAST(seen AS INT)) >= 0.5 AS expected FROM g GROUP BY ALL HAVING count(DISTINCT day) >= 2), known AS (SELECT DISTINCT cyc FROM bank),
grown AS (SELECT a.day, a.lat, a.lon FROM g a JOIN g b ON a.day = b.day AND abs(a.lat - b.lat) <= 1 AND abs(a.lon - b.lon) <= 1 AND b.seen GROUP BY ALL),
closed AS (SELECT a.day, a.lat, a.lon FROM g a JOIN grown b ON a.day = b.day AND abs(a.lat - b.lat) <= 1 AND abs(a.lon - b.lon) <= 1 GROUP BY ALL HAVING count(*) = 9),
free AS (SELECT g.day, g.lat, g.lon FROM g ANTI JOIN closed USING (day, lat, lon)),
reach AS (SELECT day, lat, lon FROM free WHERE lat IN (0, 11) OR lon IN (0, 11) UNION SELECT f.day, f.lat, f.lon FROM reach r JOIN free f ON f.day = r.day AND abs(f.lat - r.lat) + abs(f.lon - r.lon) = 1),
c AS (SELECT g.*, CASE WHEN k.cyc IS NOT NULL THEN coalesce(b.expected, FALSE) ELSE r.day IS NULL END AS inside, CASE WHEN k.cyc IS NOT NULL THEN 'bank' ELSE 'envelope' END AS source FROM g LEFT JOIN known k ON k.cyc = (g.day - DATE '2000-01-01') % 16 LEFT JOIN bank b ON b.cyc = k.cyc AND b.lat = g.lat AND b.lon = g.lon LEFT JOIN reach r ON r.day = g.day AND r.lat = g.lat AND r.lon = g.lon)
SELECT day, CAST(lat AS INT) AS lat, CAST(lon AS INT) AS lon, inside, source, CASE WHEN seen THEN 'observed' WHEN inside THEN 'cloud' ELSE 'out_of_swath' END AS gap FROM c""")
def expected_swath(spark, sf_dir):
    """Gap types by the 16-day composite where it knows two overpasses, by the day's envelope elsewhere."""
    s = swath(spark, sf_dir).withColumn("hour", F.lit(0))
    bank = aggregates.coverage_bank(s, cycle_day(F.col("day")), ["hour", "lat", "lon"], F.col("seen"), "day", 2)
    out = grid.gap_types(s, bank, ["day", "hour"], "day date, hour int", "seen", "day", "hour", cycle_day(F.col("day")), fewest_days=2)
    return out.select("day", "lat", "lon", "inside", "source", "gap")


BASE = BaseConfig(parts=(0, 1, 2), slots=(0, 1, 2, 3), lat_range=(2, 11), lon_range=(0, 9))


def compile_part(df, part):
    """A slab: the mean of the predictor and the largest target of each cell and slot, and the cell's mean before slot 2."""
    slot = df.groupBy("day", "slot", "lat", "lon").agg(F.avg("predictor").alias("x"), F.max("target").alias("y"))
    early = df.where("slot < 2").groupBy("day", "lat", "lon").agg(F.avg("predictor").alias("early"))
    return slot.join(early, ["day", "lat", "lon"], "left").withColumn("part", F.lit(part))


BASE_SQL = ROWS + """, r AS (SELECT *, CAST((day(day) - 1) % 3 AS INT) AS part FROM rows WHERE slot <= 3 AND lat BETWEEN 2 AND 11 AND lon BETWEEN 0 AND 9),
s AS (SELECT part, day, slot, lat, lon, avg(predictor) AS x, max(target) AS y FROM r GROUP BY ALL), e AS (SELECT day, lat, lon, avg(predictor) AS early FROM r WHERE slot < 2 GROUP BY ALL), base AS (SELECT s.*, e.early FROM s LEFT JOIN e USING (day, lat, lon))"""


@query("clm_base_config", f"WITH {BASE_SQL}, q AS (SELECT quantile_cont(y, [0.9, 0.99]) AS q FROM base) SELECT part, day, slot, lat, lon, round(x, 6) AS x, round(early, 6) AS early, coalesce(y > q[1], FALSE) AS flag_p90, coalesce(y > q[2], FALSE) AS flag_p99 FROM base, q WHERE x < 150 AND slot > 0")
def base_config(spark, sf_dir):
    """Compiled in three parts, of which a second call only reads; thresholds from the unscreened rows, flags on the screened ones."""
    part, root = F.pmod(F.dayofmonth("day") - 1, F.lit(3)), fresh_path(spark, "base")
    events = rows(spark, sf_dir)
    build_base_table(events, BASE, root, compile_part, part)
    done = prepare(events, BASE, root, compile_part, "y", [90, 99], {"low": F.col("x") < 150, "later": F.col("slot") > 0}, part)
    return done.table.select("part", "day", "slot", "lat", "lon", F.round("x", 6).alias("x"), F.round("early", 6).alias("early"), "flag_p90", "flag_p99")


@query("src_newest_version", f"WITH {DAILY} SELECT day, lat, lon, n, 2 AS version FROM daily")
def newest_version(spark, sf_dir):
    """Labels asked for in version 4 where versions 1 and 2 have been written."""
    root, d = fresh_path(spark, "labels"), daily(spark, sf_dir).select("day", "lat", "lon", "n")
    for v in (1, 2):
        d.withColumn("version", F.lit(v)).write.parquet(f"{root}/labels-v{v}")
    return newest(spark, root, "labels", 4)


FRAMES = ROWS + """, f AS (SELECT event_type || CASE WHEN slot = 5 THEN '-ens2' ELSE '' END || CASE WHEN event_type = 'error' THEN '' ELSE '_fold' || slot END || CASE WHEN lat % 2 = 0 THEN '_even' ELSE '_odd' END AS name, lon % 3 AS km, avg(predictor) AS csi, sqrt(avg(predictor * predictor)) AS rmse, count(*) AS n FROM rows GROUP BY event_type, slot, lat % 2, lon % 3)"""


def frames(spark, sf_dir):
    """A result frame per run; runs of one type have no folds."""
    name = F.concat("event_type", F.when(F.col("slot") == 5, "-ens2").otherwise(""), F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("_fold"), F.col("slot").cast("string"))), F.when(F.col("lat") % 2 == 0, "_even").otherwise("_odd"))
    df = rows(spark, sf_dir).withColumns({"even": F.col("lat") % 2, "km": F.col("lon") % 3})
    out = df.groupBy("event_type", "slot", "even", "km").agg(F.first(name).alias("name"), F.avg("predictor").alias("csi"), F.sqrt(F.avg(F.col("predictor") ** 2)).alias("rmse"), F.count(F.lit(1)).alias("n"))
    return pooling.leg_parts(out, "name")


@query("ver_leg_selection", f"""WITH {FRAMES}, l AS (SELECT *, regexp_replace(name, '_fold[0-9]+', '') AS leg FROM f), o AS (SELECT *, CASE WHEN leg = 'error_odd' THEN 0 WHEN regexp_matches(leg, '-ens[0-9]+(_|$)') THEN 1 ELSE 2 END AS kind FROM l WHERE leg LIKE '%\\_even' ESCAPE '\\' OR leg = 'error_odd'),
p AS (SELECT leg, CAST(row_number() OVER (ORDER BY kind, leg) AS INT) AS place FROM (SELECT DISTINCT leg, kind FROM o)), v AS (SELECT leg, CAST(km AS INT) AS km, round(avg(csi), 6) AS csi, count(*) AS n_frames FROM o GROUP BY ALL) SELECT v.*, place FROM v JOIN p USING (leg)""")
def leg_selection(spark, sf_dir):
    """The runs of one source and the benchmark in the order of a figure, folds pooled without weights."""
    own = pooling.legs_for_source(frames(spark, sf_dir), "even", "error_odd")
    return pooling.pooled_frames(own, ["km", "place"], ["csi"]).select("leg", "km", "place", F.round("csi", 6).alias("csi"), "n_frames")


@query("ver_weighted_pool", f"""WITH {FRAMES}, l AS (SELECT *, regexp_extract(name, '_([^_]*)$', 1) AS source FROM f WHERE coalesce(try_cast(regexp_extract(name, '_fold([0-9]+)', 1) AS INT), 2) = 2)
SELECT source, CAST(km AS INT) AS km, CAST(sum(n) AS BIGINT) AS n, round(sum(n * csi) / sum(n), 6) AS csi, round(sqrt(sum(n * rmse * rmse) / sum(n)), 6) AS rmse FROM l GROUP BY ALL""")
def weighted_pool(spark, sf_dir):
    """One fold and the runs without folds, each frame weighted by its count."""
    out = pooling.weighted_frames(pooling.for_fold(frames(spark, sf_dir), 2), ["source", "km"], "n", ["csi"], ["rmse"])
    return out.withColumns({c: F.round(c, 6) for c in ("csi", "rmse")})


COSTS = ROWS + """, t AS (SELECT 'm' || slot // 2 || '_fold' || slot % 2 || CASE WHEN user_id % 2 = 0 THEN '_a' ELSE '_b' END AS run, CASE WHEN slot % 2 = 0 AND event_id % 3 = 0 THEN 'mean' ELSE 'raw' END AS stat, lat % 4 AS dilation, CASE WHEN lon % 3 = 0 THEN 'none' ELSE 'f' || lon % 3 END AS front, event_type AS channel, predictor AS cost FROM rows)"""


@query("ver_permutation_costs", f"""WITH {COSTS}, k AS (SELECT *, bool_or(stat = 'mean') OVER (PARTITION BY run) AS means FROM t WHERE channel <> 'view'), u AS (SELECT *, max(dilation) OVER (PARTITION BY run) AS widest FROM k WHERE stat = CASE WHEN means THEN 'mean' ELSE 'raw' END),
o AS (SELECT run, front, channel, avg(cost) AS cost FROM u WHERE dilation = widest AND front <> 'none' GROUP BY ALL)
SELECT right(run, 1) AS source, regexp_replace(left(run, length(run) - 2), '_fold[0-9]+', '') AS leg, front, channel, round(avg(cost), 6) AS cost FROM o GROUP BY ALL""")
def permutation_costs(spark, sf_dir):
    run = F.concat(F.lit("m"), F.expr("slot div 2").cast("string"), F.lit("_fold"), (F.col("slot") % 2).cast("string"), F.when(F.col("user_id") % 2 == 0, "_a").otherwise("_b"))
    df = rows(spark, sf_dir).select(run.alias("run"), F.when((F.col("slot") % 2 == 0) & (F.col("event_id") % 3 == 0), "mean").otherwise("raw").alias("stat"), (F.col("lat") % 4).alias("dilation"), F.when(F.col("lon") % 3 == 0, "none").otherwise(F.concat(F.lit("f"), (F.col("lon") % 3).cast("string"))).alias("front"), F.col("event_type").alias("channel"), F.col("predictor").alias("cost"))
    return pooling.permutation_costs(df, "run", "view", "none", "cost").withColumn("cost", F.round("cost", 6))


@query("gap_krige_blocks")
def krige_in_blocks(spark, sf_dir):
    """The mean field of all days with every seventh diagonal hidden, kriged in tiles; the tests hold it to the dense system."""
    field = daily(spark, sf_dir).groupBy("lat", "lon").agg(F.avg("v").alias("truth")).withColumn("v", F.when((F.col("lat") + F.col("lon")) % 7 != 0, F.col("truth")))
    out = krige_blocks.fill_large(field, "lat", "lon", "v", tile=40)
    return out.select("lat", "lon", F.round("truth", 6).alias("truth"), F.round("filled", 5).alias("filled"))
