"""The roles of the driver's tables: rows with a predictor, a target, a day, a slot and a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: day, slot 0-5, cell (lat, lon), predictor, target and strata."""
    k = F.get_json_object("props", "$.k").cast("double")
    return load(spark, sf_dir, "events").select(
        "event_id", "ts", F.to_date("ts").alias("day"), F.expr("hour(ts) div 4").cast("int").alias("slot"), F.expr("user_id % 12").cast("int").alias("lat"),
        F.expr("(user_id div 12) % 12").cast("int").alias("lon"), "user_id", "event_type", F.col("value").alias("predictor"), (F.col("value") * k).alias("target"), k.alias("control"),
    )


#: The same as a DuckDB CTE.
ROWS = """rows AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS day, CAST(hour(ts) // 4 AS INT) AS slot, CAST(user_id % 12 AS INT) AS lat,
         CAST((user_id // 12) % 12 AS INT) AS lon, user_id, event_type, value AS predictor,
         value * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS target, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS control
  FROM events)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (day, slot, lat, lon): the mean predictor and the largest target."""
    return rows(spark, sf_dir).groupBy("day", "slot", "lat", "lon").agg(F.avg("predictor").alias("x"), F.max("target").alias("y"), F.count(F.lit(1)).alias("n"))


CELLS = ROWS + """, cells AS (SELECT day, slot, lat, lon, avg(predictor) AS x, max(target) AS y, count(*) AS n FROM rows GROUP BY ALL)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (day, lat, lon)."""
    return rows(spark, sf_dir).groupBy("day", "lat", "lon").agg(F.avg("predictor").alias("v"), F.count(F.lit(1)).alias("n"))


DAILY = ROWS + """, daily AS (SELECT day, lat, lon, avg(predictor) AS v, count(*) AS n FROM rows GROUP BY ALL)"""
