"""Scoring a given model over a table: anything with ``predict``, one copy a worker, in Arrow batches or in grid tiles."""

from __future__ import annotations

import inspect
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

#: A model that is shipped as an object may be this large (bytes); larger ones come from a loader that each worker calls.
LARGEST_MODEL = 64 << 20
#: Models that one Python worker holds.
MODELS_HELD = 2
_HELD: dict[str, object] = {}


def held_model(token: str, make: Callable[[], object]):
    """This worker's copy of a model, made when it is first asked for."""
    if token not in _HELD:
        while len(_HELD) >= MODELS_HELD:
            del _HELD[next(iter(_HELD))]
        _HELD[token] = make()
    return _HELD[token]


def on_workers(spark: SparkSession, model) -> Callable[[], object]:
    """A function for tasks that gives the worker's model.

    ``model`` is an object with ``predict``, broadcast if it is not too large, or a function without arguments that loads one.
    """
    token = uuid.uuid4().hex
    if isinstance(model, type) or not hasattr(model, "predict"):
        if not callable(model):
            raise TypeError("a model has a method predict; a loader is a function that returns one")
        return lambda: held_model(token, model)
    raw = cloudpickle.dumps(model)
    if len(raw) > LARGEST_MODEL:
        raise ValueError(f"the model takes {len(raw)} bytes, more than {LARGEST_MODEL}: give a function that loads it on the workers")
    sent = spark.sparkContext.broadcast(raw)
    return lambda: held_model(token, lambda: cloudpickle.loads(sent.value))


def predicted(model, x: np.ndarray, batch_size: int) -> np.ndarray:
    """``model.predict`` over the first axis, at most ``batch_size`` rows at once."""
    try:
        takes = inspect.signature(model.predict).parameters
    except (TypeError, ValueError):
        takes = {}
    extra = {k: v for k, v in (("batch_size", batch_size), ("verbose", 0)) if k in takes}
    parts = [np.asarray(model.predict(x[a : a + batch_size], **extra), np.float64) for a in range(0, len(x), batch_size)]
    out = np.concatenate(parts)
    if len(out) != len(x):
        raise ValueError(f"the model gave {len(out)} predictions for {len(x)} rows")
    return out


def matrix(batch: pa.RecordBatch, inputs: Sequence[str]) -> np.ndarray:
    """(rows, features) as doubles, missing ones NaN: number columns, and array columns of one length each."""
    columns = []
    for name in inputs:
        c = batch.column(name)
        if pa.types.is_list(c.type):
            lengths = {n for n in c.value_lengths().to_pylist() if n is not None}
            if len(lengths) > 1:
                raise ValueError(f"{name} holds vectors of {len(lengths)} lengths")
            wide = np.full((len(c), *lengths), np.nan)
            known = c.is_valid().to_numpy(zero_copy_only=False)
            wide[known] = c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(known.sum(), -1)
            columns.append(wide)
        else:
            columns.append(c.cast(pa.float64()).to_numpy(zero_copy_only=False)[:, None])
    return np.concatenate(columns, axis=1)


def as_column(values: np.ndarray, known: np.ndarray, width: int | None) -> pa.Array:
    """Predictions of the known rows as doubles, or as lists of ``width`` doubles; null elsewhere."""
    if width is None:
        if values.ndim > 1 and values.shape[1:] != (1,):
            raise ValueError(f"the model gives {values.shape[1:]} numbers a row: name their count as width")
        full = np.full(len(known), np.nan)
        full[known] = values.reshape(-1)
        return pa.array(full, pa.float64(), mask=~known)
    if values.shape[1:] != (width,):
        raise ValueError(f"the model gives {values.shape[1:]} numbers a row, not {width}")
    offsets = np.concatenate([[0], np.cumsum(np.where(known, width, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), pa.float64()), mask=pa.array(~known))


def score(df: DataFrame, model, inputs: Sequence[str], out: str, width: int | None = None, keep: Sequence[str] | None = None, batch_size: int = 8192, missing: str = "skip") -> DataFrame:
    """``keep`` (all columns if not given) and the model's prediction as ``out``: a number, or with ``width`` an array of numbers.

    ``inputs`` are number columns or array columns, in the model's order.  Rows with a missing input (null or NaN) are not shown to
    the model and get null; with ``missing="nan"`` the model sees NaN.  No shuffle: batches are scored where they lie.
    """
    if missing not in ("skip", "nan"):
        raise ValueError("missing is skip or nan")
    keep = list(df.columns if keep is None else keep)
    source = df.select(*keep, *[F.col(c).alias(f"_in_{i}") for i, c in enumerate(inputs)])
    schema = StructType([*(source.schema[c] for c in keep), StructField(out, DoubleType() if width is None else ArrayType(DoubleType()))])
    names, own = [f"_in_{i}" for i in range(len(inputs))], on_workers(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b, names)
            known = ~np.isnan(x).any(axis=1) if missing == "skip" else np.ones(len(x), bool)
            found = predicted(own(), x[known], batch_size) if known.any() else np.zeros((0, width) if width else 0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], as_column(found, known, width)], names=[*keep, out])

    return source.mapInArrow(run, schema)


def best_class(scores: str) -> Column:
    """0-based index of the largest score, the first of equal ones; null where the scores are."""
    return (F.array_position(F.col(scores), F.array_max(scores)) - 1).cast("int")


def tiles_of(df: DataFrame, keys: Sequence[str], row: str, col: str, channels: Sequence[str], tile: int, halo: int) -> DataFrame:
    """(keys, _ti, _tj, _cells): the cells of each tile and of the ``halo`` rows and columns around it, as one bounded list.

    Cells near an edge go to every tile that sees them; tiles that own no cell are left out.
    """
    seen = lambda x: F.explode(F.sequence(F.floor((F.col(x) - halo) / tile).cast("int"), F.floor((F.col(x) + halo) / tile).cast("int")))
    copies = df.select(*keys, F.col(row).cast("int").alias("_r"), F.col(col).cast("int").alias("_c"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(channels)])
    copies = copies.withColumn("_ti", seen("_r")).withColumn("_tj", seen("_c"))
    owned = (F.floor(F.col("_r") / tile) == F.col("_ti")) & (F.floor(F.col("_c") / tile) == F.col("_tj"))
    cell = F.struct("_r", "_c", F.array(*[f"_x{i}" for i in range(len(channels))]).alias("_x"), owned.alias("_own"))
    return copies.groupBy(*keys, "_ti", "_tj").agg(F.collect_list(cell).alias("_cells"), F.max(owned).alias("_any")).where("_any").drop("_any")


def score_tiles(df: DataFrame, model, keys: Sequence[str], row: str, col: str, channels: Sequence[str], out: str, width: int | None = None, tile: int = 64, halo: int = 8, fill: float = float("nan"), batch_tiles: int = 8) -> DataFrame:
    """(keys, row, col, out): a model over fields, one row of ``df`` per cell of a key's grid, whatever the grid's size.

    The model sees (tiles, height, width, channels) with ``tile + 2 * halo`` rows and columns, absent cells as ``fill``, and gives a number
    (or ``width`` numbers) for each cell; only the tile itself is kept, so a model that looks no farther than ``halo`` cells gives
    the values of the uncut field.  Two rows for one cell are an error.
    """
    source = tiles_of(df, keys, row, col, channels, tile, halo)
    kind = DoubleType() if width is None else ArrayType(DoubleType())
    cell = StructType([StructField("_r", IntegerType()), StructField("_c", IntegerType()), StructField("_y", kind)])
    schema = StructType([*(source.schema[k] for k in keys), StructField("_found", ArrayType(cell))])
    own, side, n = on_workers(df.sparkSession, model), tile + 2 * halo, len(channels)

    def field(cells: pa.StructArray, ti: int, tj: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tile's input, and row, column and ownership of its cells."""
        r, c, mine = (cells.field(k).to_numpy(zero_copy_only=False) for k in ("_r", "_c", "_own"))
        at = (r - (ti * tile - halo)) * side + c - (tj * tile - halo)
        if len(np.unique(at)) < len(at):
            raise ValueError("two rows for one cell of a field")
        x = np.full((side * side, n), fill)
        values = cells.field("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        x[at] = np.where(np.isnan(values), fill, values)
        return x.reshape(side, side, n), r, c, mine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), batch_tiles):
                b = batch.slice(a, batch_tiles)
                tiles = [field(b.column("_cells")[i].values, b.column("_ti")[i].as_py(), b.column("_tj")[i].as_py()) for i in range(len(b))]
                y = predicted(own(), np.stack([t[0] for t in tiles]), batch_tiles)
                found = []
                for (_, r, c, mine), i, j, part in zip(tiles, b.column("_ti").to_pylist(), b.column("_tj").to_pylist(), y, strict=True):
                    r, c = r[mine], c[mine]
                    values = part.reshape(side, side, -1)[r - (i * tile - halo), c - (j * tile - halo)]
                    column = as_column(values, np.ones(len(values), bool), width)
                    found.append(pa.StructArray.from_arrays([pa.array(r, pa.int32()), pa.array(c, pa.int32()), column], names=["_r", "_c", "_y"]))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.concat_arrays(found))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], lists], names=[*keys, "_found"])

    scored = source.mapInArrow(run, schema)
    flat = scored.select(*keys, F.inline("_found"))
    return flat.select(*keys, F.col("_r").alias(row), F.col("_c").alias(col), F.col("_y").alias(out))
