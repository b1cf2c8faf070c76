"""Integer vectors in column blocks: what the centroid and the code operators share.

Rows are dealt evenly into chunks, whatever their ids and values, and each chunk is cut by columns.  A block is one record: the
components of some columns of all rows of a chunk, packed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components up to this size keep a squared distance over up to 16,384 of them below 2**62.
LARGEST = 1 << 23
BLOCK = "chunk long, shard int, n int, {carried}block binary"


def usable(v: str) -> Column:
    """True for vectors without null or non-finite components."""
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 32-bit integers; components of more than ``LARGEST`` are an error, since sums would leave 64 bits."""
    x = np.floor(scale * flat)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    return x.astype(np.int32)


def floor_divided(total: str, count: str) -> Column:
    """Exact floor of a quotient of integers."""
    return F.expr(f"({total} - pmod({total}, {count})) div {count}")


def blocks_of(rows: DataFrame, v: str, dim: int, scale: int, cuts: Sequence[int], carried: Sequence[str], count: int, chunk: int) -> DataFrame:
    """(chunk, shard, n, carried columns, block): one record per chunk of at most ``chunk`` rows and column block.

    ``rows`` has ``count`` rows with vectors of ``dim`` components; ``cuts`` are the first columns of the blocks.  The carried
    columns are arrays of the chunk's values and stand in shard 0 alone, null elsewhere.
    """
    source = rows.select(*carried, v).repartition(max(1, -(-count // chunk)))
    types = {c: source.schema[c].dataType.simpleString() for c in carried}
    schema = BLOCK.format(carried="".join(f"`{c}` array<{t}>, " for c, t in types.items()))
    bounds = list(zip(cuts, [*cuts[1:], dim], strict=True))

    def lists(column: pa.Array, shards: int) -> pa.Array:
        """One list of all values, then nulls."""
        offsets = pa.array([0] + [len(column)] * shards, pa.int32())
        mask = pa.array([False] + [True] * (shards - 1))
        return pa.ListArray.from_arrays(offsets, column, mask=mask)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def emit(t: pa.Table, at: int) -> pa.RecordBatch:
            t = t.combine_chunks()
            x = integers(t.column(v).chunk(0).flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, dim)
            shards = len(bounds)
            columns = [lists(t.column(k).chunk(0), shards) for k in carried]
            parts = pa.array([np.ascontiguousarray(x[:, a:b]).tobytes() for a, b in bounds], pa.binary())
            ids = [pa.array([(part << 24) + at] * shards, pa.int64()), pa.array(range(shards), pa.int32()), pa.array([len(x)] * shards, pa.int32())]
            return pa.RecordBatch.from_arrays([*ids, *columns, parts], names=["chunk", "shard", "n", *carried, "block"])

        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= chunk:
                t = pa.Table.from_batches(held)
                yield emit(t.slice(0, chunk), made)
                made, held = made + 1, t.slice(chunk).to_batches()
        if sum(map(len, held)):
            yield emit(pa.Table.from_batches(held), made)

    return source.mapInArrow(pack, schema)
