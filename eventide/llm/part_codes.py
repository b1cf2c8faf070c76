"""Operator 12: vector codes by parts, their codebooks trained over metric trees built with anchors.

Each vector is cut into equal parts, and each part is replaced by the nearest entry of its position's codebook.  For every chunk
of rows and every part position one tree of balls is built over the distinct parts, middle-out: about sqrt(n) anchors are chosen
by farthest point, each taking from the others only points beyond half the distance between the two (triangle inequality); anchors are
merged upwards, smallest enclosing ball first, into the top of the tree; the same is done inside every anchor for the tree
below.  Balls cache count and sum of their points, copies included.  Trees are built once, written, and read in every round.

A round goes down each tree level by level.  A ball inherits its parent's list of entries that may be nearest to any of its
points and drops those that lie farther than the best one from all of the ball (the difference of squared distances is linear, so its least value
over a ball is known).  When one entry is left the ball is wholly owned: its cached sum and count are added and nothing below is
visited.  Leaves that stay shared compare each point with the entries left.  Sums meet by part and entry; only the codebooks, whose size is fixed,
reach the driver.

Defined cases: vectors that are null or hold null or non-finite components are dropped; vectors of another length than most (of equally
common lengths the longer counts), or where the parts do not divide it, take no part; null ids take part, last in the order of ids; rows of
equal ids start entries in the order of their vectors; repeated rows count once each; fewer rows than entries make shorter codebooks; of
equal distances the lower index wins; null labels are summed together; an empty table gives an empty result; components whose integer
is beyond 2**23 are an error; other columns, also ones named like results, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialised, table
from .vector_blocks import blocks_of, floor_divided, usable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a chunk, distinct parts of a leaf, salts of the join on labels.
CHUNK, LEAF, SALTS = 32_768, 128, 16
RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
TREE = "chunk long, part int, points binary, places binary, balls binary, ranges binary, sums binary"


class Tree:
    """Balls over the distinct points of one chunk and part.

    ``points`` stand in the order of the leaves, so that a ball's points are the range [begin, end); ``places`` has the position of each
    row's point.  Ball 0 is the root; ``balls`` has centre and radius, ``ranges`` begin, end and the two children (-1 for leaves),
    ``sums`` the count and sums of the rows in it.
    """

    def __init__(self, points: np.ndarray, places: np.ndarray, weights: np.ndarray, balls: np.ndarray, ranges: np.ndarray, sums: np.ndarray) -> None:
        self.points, self.places, self.weights, self.balls, self.ranges, self.sums = points, places, weights, balls, ranges, sums

    def packed(self) -> tuple[bytes, ...]:
        return tuple(a.tobytes() for a in (self.points, self.places, self.balls, self.ranges, self.sums))

    @classmethod
    def unpacked(cls, width: int, points: bytes, places: bytes, balls: bytes, ranges: bytes, sums: bytes) -> Tree:
        places = np.frombuffer(places, np.int32)
        points = np.frombuffer(points, np.int32).reshape(-1, width)
        shaped = (np.frombuffer(balls, np.float64).reshape(-1, width + 1), np.frombuffer(ranges, np.int32).reshape(-1, 4), np.frombuffer(sums, np.int64).reshape(-1, width + 1))
        return cls(points, places, np.bincount(places, minlength=len(points)), *shaped)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("...j,...j->...", x, x))


def anchors(points: np.ndarray, wanted: int) -> np.ndarray:
    """Number of the anchor of each point: the next anchor is the point farthest from its own, until there are enough."""
    n = len(points)
    own = np.zeros(n, np.int64)
    distance = lengths(points - points[0])
    chosen = np.empty((wanted, points.shape[1]))
    chosen[0], made = points[0], 1
    while made < wanted:
        far = int(distance.argmax())
        if distance[far] == 0:
            break
        pivot = points[far]
        half = lengths(chosen[:made] - pivot) / 2
        asked = np.flatnonzero(distance >= half[own])  # all others are nearer to their own anchor
        d = lengths(points[asked] - pivot)
        taken = d < distance[asked]
        own[asked[taken]], distance[asked[taken]], chosen[made] = made, d[taken], pivot
        made += 1
    return own


class Builder:
    """Grows a tree; nodes are lists until :meth:`tree` lays them out."""

    def __init__(self, points: np.ndarray, weights: np.ndarray) -> None:
        self.points, self.weights = points.astype(np.float64), weights
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray | None] = []

    def leaf(self, members: np.ndarray) -> int:
        x = self.points[members]
        centre = x.sum(axis=0) / len(x)
        return self.node(centre, float(lengths(x - centre).max()), None, members)

    def node(self, centre: np.ndarray, radius: float, children: tuple[int, int] | None, members: np.ndarray | None) -> int:
        self.centres.append(centre)
        self.radii.append(radius)
        self.children.append(children)
        self.members.append(members)
        return len(self.centres) - 1

    def grow(self, members: np.ndarray) -> int:
        """The root of a tree over some points: anchors, their own trees, then the merges above."""
        if len(members) <= LEAF:
            return self.leaf(members)
        own = anchors(self.points[members], int(np.ceil(np.sqrt(len(members)))))
        order = np.argsort(own, kind="stable")
        groups = np.split(members[order], np.flatnonzero(np.diff(own[order])) + 1)
        return self.merge([self.grow(g) if len(groups) > 1 else self.leaf(g) for g in groups])

    def merge(self, nodes: list[int]) -> int:
        """Join the two balls whose common ball is smallest until one is left."""
        nodes = list(nodes)
        centres, radii = np.array([self.centres[i] for i in nodes]), np.array([self.radii[i] for i in nodes])
        size = lengths(centres[:, None] - centres[None]) + radii[:, None] + radii[None]
        np.fill_diagonal(size, np.inf)
        for _ in range(len(nodes) - 1):
            a, b = divmod(int(size.argmin()), len(nodes))
            apart = float(lengths(centres[a] - centres[b]))
            if apart + radii[b] <= radii[a]:
                centre, radius = centres[a].copy(), radii[a]
            elif apart + radii[a] <= radii[b]:
                centre, radius = centres[b].copy(), radii[b]
            else:
                radius = (apart + radii[a] + radii[b]) / 2
                centre = centres[a] + (centres[b] - centres[a]) * ((radius - radii[a]) / apart)
            nodes[a] = self.node(centre, float(radius), (nodes[a], nodes[b]), None)
            centres[a], radii[a] = centre, radius
            row = lengths(centres - centre) + radii + radius
            row[np.isinf(size[a])] = np.inf
            size[a], size[:, a] = row, row
            size[b], size[:, b] = np.inf, np.inf
        return nodes[a] if len(nodes) > 1 else nodes[0]

    def tree(self, root: int, points: np.ndarray, places: np.ndarray) -> Tree:
        """Nodes numbered from the root, points in the order of the leaves, sums from their prefix sums."""
        order, numbers, members, at, stack = [], {}, [], 0, [root]
        ranges = np.full((len(self.centres), 4), -1, np.int32)
        while stack:  # depth first, so that a ball's points are one range
            i = stack.pop()
            if i < 0:
                ranges[numbers[~i], 1] = at
                continue
            numbers[i] = len(order)
            order.append(i)
            ranges[numbers[i], 0] = at
            stack.append(~i)
            if self.children[i] is None:
                members.append(self.members[i])
                at += len(members[-1])
            else:
                stack += self.children[i][::-1]
        for i in order:
            if self.children[i] is not None:
                ranges[numbers[i], 2:] = [numbers[c] for c in self.children[i]]
        by_leaf = np.concatenate(members)
        position = np.empty(len(by_leaf), np.int32)
        position[by_leaf] = np.arange(len(by_leaf), dtype=np.int32)
        weights = self.weights[by_leaf]
        facts = np.column_stack([weights, points[by_leaf].astype(np.int64) * weights[:, None]])
        before = np.concatenate([np.zeros((1, facts.shape[1]), np.int64), np.cumsum(facts, axis=0)])
        balls = np.column_stack([np.array([self.centres[i] for i in order]), [self.radii[i] for i in order]])
        return Tree(points[by_leaf], position[places], weights, balls, ranges, before[ranges[:, 1]] - before[ranges[:, 0]])


def tree_of(rows: np.ndarray) -> Tree:
    """The tree over the rows of one chunk and part; copies are one point of more weight."""
    points, places, weights = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    builder = Builder(points, weights)
    return builder.tree(builder.grow(np.arange(len(points))), points, places.reshape(-1))


def settled(tree: Tree, book: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(wholly owned balls with their entries, points of shared leaves, entries of these points)."""
    entries = book.astype(np.float64)
    between = lengths(entries[:, None] - entries[None])
    # Of equal entries the first wins everywhere; the others are out from the start.
    alive = np.array([not (between[e, :e] == 0).any() for e in range(len(entries))])
    owned, shared = [], []
    balls, lists = np.zeros(1, np.int64), alive[None]
    while len(balls):
        d = np.square(tree.balls[balls, None, :-1] - entries[None]).sum(axis=2)
        d[~lists] = np.inf
        best = d.argmin(axis=1)
        least = d[np.arange(len(balls)), best][:, None]
        reach = 2 * tree.balls[balls, -1:] * between[best]
        lists = lists & (d - least <= reach + 1e-9 * (least + reach + 1))
        single = lists.sum(axis=1) == 1
        owned.append((balls[single], best[single]))
        leaf = ~single & (tree.ranges[balls, 2] < 0)
        shared.append((balls[leaf], lists[leaf]))
        on = ~single & ~leaf
        balls, lists = tree.ranges[balls[on], 2:].astype(np.int64).reshape(-1), np.repeat(lists[on], 2, axis=0)
    balls, lists = (np.concatenate([s[i] for s in shared]) for i in (0, 1))
    points, chosen = among(tree, book, balls, lists)
    return owned, points, chosen


def among(tree: Tree, book: np.ndarray, leaves: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, entries): every point of the leaves with the nearest entry of its leaf's list, in integers."""
    if not len(leaves):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = tree.ranges[leaves, 0].astype(np.int64), tree.ranges[leaves, 1].astype(np.int64)
    sizes, asked = end - begin, lists.sum(axis=1)
    of = np.repeat(np.arange(len(leaves)), sizes)
    points = np.arange(len(of)) + np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    entries, first = np.nonzero(lists)[1], np.concatenate([[0], np.cumsum(asked)[:-1]])
    many = asked[of]
    starts = np.concatenate([[0], np.cumsum(many)[:-1]])
    entry = entries[np.arange(many.sum()) + np.repeat(first[of] - starts, many)]
    d = np.square(tree.points[np.repeat(points, many)].astype(np.int64) - book[entry]).sum(axis=1)
    nearest = d == np.repeat(np.minimum.reduceat(d, starts), many)
    return points, np.minimum.reduceat(np.where(nearest, entry, len(book)), starts)


def part_sums(tree: Tree, book: np.ndarray) -> np.ndarray:
    """(entries, 1 + width): count and sums of the rows nearest to each entry."""
    owned, points, chosen = settled(tree, book)
    out = np.zeros((len(book), 1 + book.shape[1]), np.int64)
    for balls, entries in owned:
        np.add.at(out, entries, tree.sums[balls])
    weights = tree.weights[points][:, None]
    np.add.at(out, chosen, np.column_stack([weights, tree.points[points].astype(np.int64) * weights]))
    return out


def part_codes(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row."""
    owned, points, chosen = settled(tree, book)
    codes = np.empty(len(tree.points), np.int64)
    codes[points] = chosen
    for balls, entries in owned:
        for (a, b), e in zip(tree.ranges[balls, :2].tolist(), entries.tolist(), strict=True):
            codes[a:b] = e
    errors = np.square(tree.points.astype(np.int64) - book[codes]).sum(axis=1)
    return codes[tree.places], errors[tree.places]


def trees_of(blocks: DataFrame, width: int) -> DataFrame:
    """One row per chunk and part with its tree."""
    names = [f.split()[0] for f in TREE.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, part, block in zip(b.column("chunk"), b.column("shard"), b.column("block"), strict=True):
                packed = tree_of(np.frombuffer(block.as_buffer(), np.int32).reshape(-1, width)).packed()
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()]), pa.array([part.as_py()], pa.int32()), *(pa.array([p], pa.binary()) for p in packed)], names=names)

    return blocks.select("chunk", "shard", "block").mapInArrow(build, TREE)


def each_tree(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, Tree]]:
    for i in range(len(batch)):
        chunk, part, *packed = (c[i].as_py() for c in batch.columns)
        yield chunk, part, Tree.unpacked(width, *packed)


def trained(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, width) after one round; unused entries stay."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + width), np.int64)
        for b in batches:
            for _, part, tree in each_tree(b, width):
                total[part] += part_sums(tree, books[part])
        used = total[..., 0] > 0
        part, entry = (np.repeat(a, width) for a in np.nonzero(used))
        own = total[used]
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(np.tile(np.arange(width), len(own)), pa.int32()), pa.array(own[:, 1:].ravel()), pa.array(np.repeat(own[:, 0], width))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "j", "s", "n"])

    found = trees.mapInArrow(sums, "part int, entry int, j int, s long, n long").groupBy("part", "entry", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = books.copy()
    for r in found.select("part", "entry", "j", floor_divided("s", "n").alias("x")).collect():  # parts times entries times width
        out[r["part"], r["entry"], r["j"]] = r["x"]
    return out


def coded(trees: DataFrame, blocks: DataFrame, books: np.ndarray, label_type: str) -> DataFrame:
    """(vec_id, label, code, error) of every row: the parts of a chunk meet."""
    width = books.shape[2]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, part, tree in each_tree(b, width):
                entries, errors = part_codes(tree, books[part])
                columns = [pa.array([chunk]), pa.array([part], pa.int32()), pa.array([entries.astype(np.uint8).tobytes()], pa.binary()), pa.array([errors.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "codes", "errors"])

    def join(rows: pa.Table, own: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("part").to_numpy())
        entries = np.stack([np.frombuffer(rows.column("codes")[int(i)].as_buffer(), np.uint8) for i in order], axis=1)
        errors = sum(np.frombuffer(e.as_buffer(), np.int64) for e in rows.column("errors"))
        return pa.table({"vec_id": own.column("vec_id").combine_chunks().flatten(), "label": own.column("label").combine_chunks().flatten(), "code": pa.array([r.tobytes().hex() for r in entries], pa.string()), "error": pa.array(errors, pa.int64())})

    per_part = trees.mapInArrow(codes, "chunk long, part int, codes binary, errors binary")
    ids = blocks.where("shard = 0").select("chunk", "vec_id", "label")
    return per_part.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(join, f"vec_id long, label {label_type}, code string, error long")


def encode(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes of integer vectors floor(scale * x); at most 256 entries."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v")).where(usable("v"))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().where((F.col("dim") > 0) & (F.col("dim") % parts == 0)).orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], RESULT)
    dim, n = sizes["dim"], sizes["count"]
    rows, width = rows.where(F.size("v") == dim), dim // parts
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    books = np.floor(scale * np.array([r["v"] for r in first])).astype(np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    blocks = materialised(blocks_of(rows, "v", dim, scale, list(range(0, dim, width)), ["vec_id", "label"], n, chunk), "part-blocks")
    records = -(-n // chunk) * parts
    trees = materialised(trees_of(blocks.repartition(records, "chunk", "shard"), width), "part-trees")
    for _ in range(rounds):
        books = trained(trees, books)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    found = materialised(coded(trees, blocks, books, rows.schema["label"].dataType.simpleString()), "codes")
    # One label may hold any share of the rows, so its total meets them in salted pieces.
    totals = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).alias("f")
    joined = salted.join(totals.alias("t"), F.col("f.label").eqNullSafe(F.col("t.label")) & (F.col("f.salt") == F.col("t.salt")))
    return joined.select("f.vec_id", "f.code", "f.error", "t.label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


def codes_sql(dim: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB, for tables whose vectors all have ``dim`` components."""
    width = dim // parts
    distance = " + ".join(f"(q.w[{j}] - c.w[{j}]) * (q.w[{j}] - c.w[{j}])" for j in range(1, width + 1))
    assign = f"a{{i}} AS MATERIALIZED (SELECT rid, part, min(struct_pack(d := {distance}, e := c.e)) AS m FROM pieces q JOIN c{{i}} c USING (part) GROUP BY rid, part)"
    means = ", ".join(f"(s{j} - ((s{j} % n) + n) % n) // n" for j in range(1, width + 1))
    sums = ", ".join(f"sum(w[{j}])::BIGINT AS s{j}" for j in range(1, width + 1))
    update = (
        f"m{{i}} AS (SELECT part, m.e AS e, count(*) AS n, {sums} FROM a{{i}} JOIN pieces USING (rid, part) GROUP BY part, m.e), "
        f"c{{j}} AS MATERIALIZED (SELECT part, e, [{means}] AS w FROM m{{i}} UNION ALL SELECT part, e, w FROM c{{i}} ANTI JOIN m{{i}} USING (part, e))"
    )
    steps = ", ".join(f"{assign.format(i=i)}, {update.format(i=i, j=i + 1)}" for i in range(rounds))
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    pieces AS MATERIALIZED (SELECT rid, part, v[{width} * part + 1 : {width} * part + {width}] AS w FROM (SELECT rid, v, unnest(range({parts})) AS part FROM kept)),
    c0 AS MATERIALIZED (SELECT part, rid - 1 AS e, w FROM pieces WHERE rid <= {entries}),
    {steps}, {assign.format(i=rounds)},
    coded AS (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
      (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY part, e)) FROM c{rounds}) AS codebooks_sha256
    FROM coded JOIN kept USING (rid)"""


OP12_SQL = codes_sql()
