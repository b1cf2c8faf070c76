"""Operator 11: centroid clustering by dimension-sharded Lloyd iterations, exact in integers.

The vectors are stored once as column blocks: a record holds some columns of the rows of one chunk, and the records are
bucketed by column shard and chunk.  In a round a task on one block meets only its shard's slice of the centroids: it
computes the exact partial distances of its rows to all slices.  Partial distances are added by chunk and give each row's
nearest centroid; the choices (one byte or two a row) go back to every shard, where the bucketed blocks stay in place, and each
shard sums its own columns by cluster and so updates its own slice.  What reaches the driver in a round is the new
centroids, k times the number of components.  A round reads the table and the centroids alone, so a lost executor costs its tasks.

Defined cases: vectors that are null, of another number of components, or hold null or non-finite components take no part; null ids
take part (they start no centroid while others do); repeated rows count once each; of equal distances the smaller cluster
wins, of equal hashes the lesser vector starts the smaller cluster; fewer rows than clusters make fewer clusters; a cluster without
rows stays where it is; an empty table gives an empty result; components whose integer is beyond 2**23 are an error; other columns, also
ones named like results, are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialised, shared_dir, table
from .vector_blocks import blocks_of, floor_divided, usable

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
#: Columns of a shard, rows of a chunk, blocks of a bucket.
SHARD_COLUMNS, CHUNK, BUCKET_BLOCKS = 32, 8192, 32
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def partial_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(rows, clusters) squared distances over one shard's columns, in 64-bit integers."""
    x = x.astype(np.int64)
    return np.stack([np.square(x - c).sum(axis=1) for c in centroids], axis=1)


def bucketed(blocks: DataFrame, count: int) -> DataFrame:
    """The blocks written under the shared folder in buckets by shard and chunk, so that joins on these leave them in place."""
    spark, name = blocks.sparkSession, f"lloyd_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{name}"
    blocks.repartition(count, "shard", "chunk").write.option("path", at).bucketBy(count, "shard", "chunk").saveAsTable(name)
    return spark.table(name)


def assigned(blocks: DataFrame, slices: list[np.ndarray], carry: bool) -> DataFrame:
    """Nearest centroid of every row.

    (chunk, clusters) with one packed byte pair a row; with ``carry`` one row per vector, (vec_id, cluster, distance).
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                r = b.slice(i, 1)
                own = slices[r.column("shard")[0].as_py()]
                x = np.frombuffer(r.column("block")[0].as_buffer(), np.int32).reshape(-1, own.shape[1])
                columns = [r.column("chunk"), pa.array([partial_distances(x, own).tobytes()], pa.binary()), *([r.column("vec_id")] if carry else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "partial", *(["vec_id"] if carry else [])])

    k = len(slices[0])
    parts = blocks.select("chunk", "shard", "block", *(["vec_id"] if carry else []))
    parts = parts.mapInArrow(partial, "chunk long, partial binary" + (", vec_id array<long>" if carry else ""))

    def nearest(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_buffer(), np.int64).reshape(-1, k) for p in group.column("partial"))
        best = total.argmin(axis=1)  # of equal distances the smaller cluster
        if not carry:
            return pa.table({"chunk": group.column("chunk").slice(0, 1), "clusters": pa.array([best.astype(np.uint16).tobytes()], pa.binary())})
        ids = next(x.values for x in group.column("vec_id") if x.is_valid)
        return pa.table({"vec_id": ids, "cluster": pa.array(best, pa.int32()), "distance": pa.array(total[np.arange(len(best)), best], pa.int64())})

    return parts.groupBy("chunk").applyInArrow(nearest, "vec_id long, cluster int, distance long" if carry else "chunk long, clusters binary")


def updated(blocks: DataFrame, chosen: DataFrame, slices: list[np.ndarray]) -> list[np.ndarray]:
    """Every shard's new slice: floor of the mean of each cluster's rows; a cluster without rows keeps its own."""
    k, shards = len(slices[0]), len(slices)
    widths = [s.shape[1] for s in slices]
    back = chosen.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for b in batches:
            for shard, block, clusters in zip(b.column("shard").to_pylist(), b.column("block"), b.column("clusters"), strict=True):
                x = np.frombuffer(block.as_buffer(), np.int32).reshape(-1, widths[shard]).astype(np.int64)
                own = np.frombuffer(clusters.as_buffer(), np.uint16)
                total, n = totals.setdefault(shard, (np.zeros((k, widths[shard]), np.int64), np.zeros(k, np.int64)))
                for c in np.unique(own):
                    mine = own == c
                    total[c] += x[mine].sum(axis=0)
                    n[c] += mine.sum()
        for shard, (total, n) in totals.items():
            c, j = map(np.ravel, np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), shard), pa.int32()), pa.array(c, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel()), pa.array(n[c])], names=["shard", "cluster", "j", "s", "n"])

    # The choices are the small side: hashed, so that the blocks need not be sorted.
    joined = blocks.select("shard", "chunk", "block").join(back.hint("shuffle_hash"), ["shard", "chunk"]).select("shard", "block", "clusters")
    found = joined.mapInArrow(sums, "shard int, cluster int, j int, s long, n long").groupBy("shard", "cluster", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = [s.copy() for s in slices]
    for r in found.where("n > 0").select("shard", "cluster", "j", floor_divided("s", "n").alias("x")).collect():  # k times the components
        out[r["shard"]][r["cluster"], r["j"]] = r["x"]
    return out


def lloyd(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, shard_columns: int = SHARD_COLUMNS, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): exact clustering of integer vectors floor(scale * x)."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where((F.size("v") == dim) & usable("v"))
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    cuts, n = list(range(0, dim, shard_columns)), rows.count()
    records = -(-n // chunk) * len(cuts)
    blocks = bucketed(blocks_of(rows, "v", dim, scale, cuts, ["vec_id"], n, chunk), max(len(cuts), -(-records // BUCKET_BLOCKS)))
    start = np.floor(scale * np.array([r["v"] for r in first])).astype(np.int64)
    slices = [start[:, a : a + shard_columns] for a in cuts]
    for _ in range(rounds):
        slices = updated(blocks, assigned(blocks, slices, False), slices)
    found = materialised(assigned(blocks, slices, True), "clusters")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a cluster
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(c, sums[c], sum(sums.values()), digest(np.concatenate([s[c] for s in slices]))) for c in sums]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _round_sql(i: int) -> str:
    """Assignment to the centroids of round i, in DuckDB."""
    distance = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"a{i} AS MATERIALIZED (SELECT rid, min(struct_pack(d := {distance}::BIGINT, c := c.c)) AS m FROM points p, c{i} c GROUP BY rid)"


def _update_sql(i: int, dim: int) -> str:
    """The centroids after round i."""
    return (
        f"m{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.m.c AS c, unnest(p.v) AS x, unnest(range({dim})) AS j FROM a{i} a JOIN points p USING (rid)) GROUP BY c, j), "
        f"c{i + 1} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM m{i} GROUP BY c UNION ALL SELECT c, v FROM c{i} WHERE c NOT IN (SELECT c FROM m{i}))"
    )


def lloyd_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    steps = ", ".join(f"{_round_sql(i)}, {_update_sql(i, dim)}" for i in range(rounds))
    return f"""
    WITH points AS MATERIALIZED (
      SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
    c0 AS MATERIALIZED (SELECT c - 1 AS c, v FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) AS c, v FROM points) WHERE c <= {k}),
    {steps}, {_round_sql(rounds)},
    final AS (SELECT rid, m.c AS c, m.d AS d FROM a{rounds})
    SELECT p.vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
      sha256(array_to_string(z.v, ',')) AS centroid_sha256
    FROM final JOIN points p USING (rid) JOIN (SELECT c, v FROM c{rounds}) z USING (c)"""


OP11_SQL = lloyd_sql()
