"""Operator 5: sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an offset and a step from two hashes of its
name).  Shards take turns; each claims the next free slot of its permutation.  The table has a fixed size whatever
the data, so it is broadcast, and a row's shard is one lookup: slot = hash(key) mod size.  Shards get shares that
differ by at most one slot, and when a shard goes, nearly all keys of the others stay where they are.

Hot keys: rows of one key go to one shard by design of the placement; :func:`assign` therefore takes several key
columns, and the registered query places documents by id, so a hot source spreads over all shards.

Defined cases: a null key is placed like the empty string; repeated rows go to the same shard; an empty table gives
an empty result; further columns, also ones named ``slot`` or ``shard``, stay in the result of
:func:`assign` inside ``row``.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

#: A prime well above 100 times the number of shards keeps shares within one per cent of each other.
SLOTS = 65_537
SHARDS = 256


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Slot -> index of its shard.  ``slots`` must be prime and at least the number of shards."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must be distinct and at least one")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime not below the number of shards")
    place = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            at = place[i]
            while owner[at] >= 0:
                at = (at + step[i]) % slots
            owner[at], place[i] = i, (at + step[i]) % slots
            free -= 1
            if not free:
                break
    return owner


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the lookup table as a frame of ``slots`` rows."""
    owner = lookup_table(shards, slots)
    return spark.createDataFrame([(i, shards[o]) for i, o in enumerate(owner)], "slot long, shard string")


def slot_of(keys: list[str], slots: int = SLOTS):
    """Slot of a key: 60 bits of the MD5 of its parts, modulo the table's prime size."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots))


def assign(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(row, slot, shard): every row with its slot and shard; the table is broadcast, its size being fixed."""
    placed = df.select(F.struct(*df.columns).alias("row"), slot_of(keys, slots).alias("slot"))
    return placed.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot")


def write_shards(df: DataFrame, keys: list[str], shards: list[str], path: str | None = None, slots: int = SLOTS) -> str:
    """Write the rows as Parquet partitioned by shard; every task writes to each shard's folder, so no shard is one task."""
    path = path or f"{shared_dir(df.sparkSession)}/shards-{uuid.uuid4().hex}"
    assign(df, keys, shards, slots).select("row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)
    return path


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document, placed by its id."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return assign(docs, ["doc_id"], shard_names()).select("row.doc_id", "slot", "shard")
