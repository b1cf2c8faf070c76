"""Text and XML records of polylines as tables of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keyword -> type of line (fixed values of the format).
KINDS = {"COLD": "cold", "WARM": "warm", "STNRY": "stationary", "OCFNT": "occluded"}
STRENGTHS = ("WK", "MDT", "STG")


def read_bulletins(spark: SparkSession, path: str) -> DataFrame:
    """(text): records separated by the control character 1."""
    return spark.read.option("lineSep", "\x01").text(path).select(F.col("value").alias("text"))


def points_of(bulletins: DataFrame, text: str, year: Column, tie: str | None = None) -> DataFrame:
    """(valid, kind, line_id, seq, lat, lon): the most complete bulletin per valid time, its lines point by point.

    ``tie`` is a column that tells all bulletins apart; of equally complete ones that with the largest counts.  Without it bulletins are told
    apart by a digest of their text, and repeats of a text are one bulletin.
    Points are 4 or 5 digits, latitude then longitude west.  A section ends at anything that is no point, keyword or
    strength.  Bulletins with six-digit points are another product and go.
    """
    head = F.regexp_extract(text, r"(?m)^VALID\s+(\d{6})Z", 1)
    bulletins = bulletins if tie else bulletins.dropDuplicates([text])
    b = bulletins.where(head != "").select((F.col(tie) if tie else F.sha2(text, 256)).alias("bulletin"), head.alias("stamp"), year.alias("year"), F.split(F.trim(F.regexp_extract(text, r"(?s)VALID\s+\d{6}Z(.*)", 1)), r"\s+").alias("tokens"))
    b = b.where(~F.exists("tokens", lambda t: t.rlike(r"^\d{6,}$")))
    stamp = F.to_timestamp(F.concat(F.col("year").cast("string"), F.col("stamp")), "yyyyMMddHH")
    t = b.select("bulletin", stamp.alias("valid"), F.posexplode("tokens").alias("pos", "token")).where(~F.col("token").isin(*STRENGTHS))
    kinds = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
    is_point = F.col("token").rlike(r"^\d{4,5}$")
    w = Window.partitionBy("bulletin").orderBy("pos")
    sections = t.withColumn("line_id", F.sum((~is_point).cast("int")).over(w)).withColumn("kind", F.first(F.when(~is_point, kinds[F.col("token")])).over(Window.partitionBy("bulletin", "line_id").orderBy("pos")))
    points = sections.where(is_point & F.col("kind").isNotNull())
    n = points.groupBy("valid", "bulletin").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("valid").agg(F.max(F.struct("n", "bulletin")).alias("b")).select("valid", F.col("b.bulletin").alias("bulletin"))
    kept = points.join(best, ["valid", "bulletin"])
    seq = F.row_number().over(Window.partitionBy("valid", "line_id").orderBy("pos"))
    return kept.select("valid", "kind", "line_id", seq.alias("seq"), F.substring("token", 1, 2).cast("double").alias("lat"), (-F.substring("token", 3, 3).cast("double")).alias("lon"))


def read_xml_lines(spark: SparkSession, path: str, tag: str = "Line") -> DataFrame:
    """(kind, line_id, seq, lat, lon) from XML elements with Point children."""
    df = spark.read.format("xml").option("rowTag", tag).schema("_pgenType string, Point array<struct<_Lat double, _Lon double, _VALUE string>>").load(path)
    lines = df.withColumn("line_id", F.monotonically_increasing_id())
    return lines.select(F.col("_pgenType").alias("kind"), "line_id", F.posexplode("Point").alias("seq", "p")).select("kind", "line_id", "seq", F.col("p._Lat").alias("lat"), F.col("p._Lon").alias("lon"))


def split_and_unwrap(points: DataFrame, line: list[str], middle: float) -> DataFrame:
    """Adds ``run`` (cut at points out of range, which go) and ``lon`` on one continuous branch near the middle longitude."""
    w = Window.partitionBy(*line).orderBy("seq")
    ok = (F.abs("lat") <= 90) & (F.abs("lon") <= 180)
    p = points.withColumn("run", F.sum((~ok).cast("int")).over(w)).where(ok)
    r = Window.partitionBy(*line, "run").orderBy("seq")
    step = F.pmod(F.col("lon") - F.lag("lon").over(r) + 180, F.lit(360.0)) - 180
    p = p.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("_u", F.first("lon").over(r) + F.sum("_s").over(r))
    shift = 360 * F.rint((F.avg("_u").over(Window.partitionBy(*line, "run")) - middle) / 360)
    return p.withColumn("lon", F.col("_u") - shift).drop("_s", "_u")
