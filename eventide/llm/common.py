"""Shared plumbing: table access, shared scratch storage and batched text mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One sub-batch of texts handed to a text function holds at most this many characters (or one text).
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local master (tests); on a cluster that is an error.
    """
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="eventide-")
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialised(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike ``checkpoint`` the copy is columnar and compressed; unlike ``cache`` it survives lost executors.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def map_texts(
    df: DataFrame,
    keys: Sequence[str],
    text: str | Column,
    factory: Callable[[], Callable[[list], Sequence]],
    fields: Sequence[tuple[str, str]],
    null_as: str | None = "",
) -> DataFrame:
    """Run a text function over whole texts in Arrow batches, carrying ``keys`` through.

    ``factory`` is called once a task and returns ``f(texts) -> one sequence per output field``.
    ``fields`` are (name, Spark type).  Null texts arrive as ``null_as``.
    """
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
    body = F.col(text) if isinstance(text, str) else text
    if null_as is not None:
        body = F.coalesce(body, F.lit(null_as))
    source = df.select(*[F.col(k) for k in keys], body.alias("__text"))
    schema = ", ".join([*(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys), *(f"`{n}` {t}" for n, t in fields)])
    names, kinds, n_keys = [*keys, *(n for n, _ in fields)], [types[t] for _, t in fields], len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = factory()
        for batch in batches:
            for part in sub_batches(batch, n_keys):
                out = f(part.column(n_keys).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keys], *(pa.array(c, type=t) for c, t in zip(out, kinds, strict=True))], names=names)

    return source.mapInArrow(run, schema)


def sub_batches(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part holds much more text than ``CHUNK_CHARS``."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


class RecentCache:
    """A bounded cache in two generations: what was not used while the newer one filled up goes.

    ``new`` is a plain dict for fast lookups; call :meth:`turn` between texts.  Within one text :meth:`keep` stops at the bound,
    so that a very long text of distinct words does not outgrow it.
    """

    def __init__(self, entries: int) -> None:
        self.entries, self.new, self.old = entries, {}, {}

    def turn(self) -> None:
        if len(self.new) >= self.entries:
            self.old, self.new = self.new, {}

    def older(self, key):
        """The value from the older generation, brought over; None if there is none."""
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self.new) < self.entries:
            self.new[key] = value
