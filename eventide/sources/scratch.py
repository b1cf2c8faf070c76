"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local master (tests); on a cluster that is an error.
    """
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="eventide-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return f"{known.get()}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a frame as Parquet to a fresh path and read it back.

    Cuts the lineage: later plans neither analyse nor recompute what led here, and lost executors cost nothing.
    """
    at = fresh_path(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
