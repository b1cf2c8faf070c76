"""Operator 1: n-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of hashed word shingles.  Equal sets are one *node* (copies are never expanded).  Banded MinHash
values propose pairs of nodes; a pair's MinHash values are then compared a few at a time, and it is dropped as soon
as the posterior probability that its similarity reaches the threshold (uniform prior, binomial matches) falls
below a tolerance.  Survivors link nodes into candidate clusters; inside a cluster all pairs are pruned the same way
and the rest are verified exactly on the shingle sets.

Scale.  Buckets and clusters are processed as sorted runs that stream through tasks.  One with more than ``BLOCK`` nodes is cut
into blocks, and each pair of blocks is a run of its own, so that no task holds an unbounded group.  Pairs are never rows: a
run returns per node a count of links and one representative of its connected part.  Exact counts of links
inside one huge group of different near copies do cost work that grows with the square of that group.

Result: per document its class (the least id of all documents linked directly or through others, or with
an equal shingle set) and its number of links: the different shingle sets with a similarity of at least the threshold.

Defined cases: words are what white space separates, in lower case; a text of one to four words has one shingle, all
of it; null, empty and blank texts have no shingles and are classes of their own without links; repeated rows
are copies of each other; a null id is never joined (null class, no links); texts of any length are taken whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RecentCache, map_texts, materialised, table

WORDS, THRESHOLD = 5, 0.8
#: A pair at the threshold shares at least one of the bands with probability 1 - (1 - 0.8**5)**28 > 0.99998.
BANDS, ROWS = 28, 5
HASHES = BANDS * ROWS
#: MinHash values compared between two looks at the posterior, and the posterior at which a pair is dropped.
STEP, TOLERANCE = 20, 1e-4
BLOCK = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    return rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After ``STEP``, ``2 * STEP`` ... values: the fewest matches that keep a pair.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1); its mass above t is the
    probability of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, 0
        while True:
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


class WordHashes:
    def __init__(self) -> None:
        self.cache = RecentCache(150_000)

    def _make(self, word: str) -> int:
        h = self.cache.older(word)
        if h is None:
            h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
            if len(word) <= 64:
                self.cache.keep(word, h)
        return h

    def __call__(self, words: list[str]) -> np.ndarray:
        self.cache.turn()
        found = list(map(self.cache.new.get, words))
        if None in found:
            make = self._make
            found = [make(w) if h is None else h for w, h in zip(words, found, strict=True)]
        return np.array(found, np.uint64)


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: str, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes()(words)
    k = min(k, len(words))
    n = len(words) - k + 1
    acc = np.full(n, k, np.uint64)
    for i in range(k):
        acc = (acc ^ h[i : i + n]) * _ODD
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    a, b = permutations()
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = None
    for at in range(0, len(x), 2048):
        part = (x[at : at + 2048, None] * a + b).min(axis=0)
        out = part if out is None else np.minimum(out, part)
    return out


def band_hashes(sig: np.ndarray) -> list[int]:
    """One 64-bit hash per band, with the band's number in it."""
    rows = sig.astype(np.uint64).reshape(BANDS, ROWS)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        acc = (acc ^ rows[:, i]) * _ODD
        acc ^= acc >> np.uint64(31)
    return acc.view(np.int64).tolist()


def nodes_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, sig): the 128-bit hash of each document's shingle set and its MinHash values (null without shingles)."""

    def factory():
        def f(texts):
            sets = [shingles(t) for t in texts]
            return [[xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], [signature(s).tobytes() if len(s) else None for s in sets]]

        return f

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL"), ["doc_id"], "text", factory, [("node", "binary"), ("sig", "binary")])


def block_pairs(members: DataFrame, group: list[str], size: str) -> DataFrame:
    """Deal the nodes of each group into blocks of about ``BLOCK`` and copy each to the block pairs it takes part in."""
    count = F.greatest(F.lit(1), F.ceil(F.col(size) / BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("node"), count).cast("int")
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    keys = [*group, "lo", "hi"]
    return dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "node")


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Complete groups of rows with equal leading columns from a sorted stream; many small ones may come together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cut = last_start(b, n_keys)
        if held and (cut or not same_key(held[-1], b, n_keys)):
            head = [*held, b.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(head)
            held = []
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def key_changes(t: pa.Table | pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Positions at which a new group starts (without 0)."""
    n = t.num_rows
    if n < 2:
        return np.zeros(0, np.int64)
    change = np.zeros(n - 1, bool)
    for i in range(n_keys):
        c = t.column(i)
        change |= pa.compute.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change) + 1


def last_start(b: pa.RecordBatch, n_keys: int) -> int:
    found = key_changes(b, n_keys)
    return int(found[-1]) if len(found) else 0


def same_key(a: pa.RecordBatch, b: pa.RecordBatch, n_keys: int) -> bool:
    return all(a.column(i)[a.num_rows - 1] == b.column(i)[0] for i in range(n_keys))


def binary_matrix(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """Fixed-width binary values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Mask of the pairs that are left after incremental comparison."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int16)
    for i, fewest in enumerate(least):
        part = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (sig[left[alive], part] == sig[right[alive], part]).sum(axis=1, dtype=np.int16)
        keep = matches >= fewest
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    mask = np.zeros(len(left), bool)
    mask[alive] = True
    return mask


def components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least member of each node's connected part."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def run_pairs(starts: list[int], ends: list[int], mine: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside each run: within one block, or across its two blocks; at most about a million at a time."""
    lefts, rights, total = [], [], 0
    for a, b in zip(starts, ends, strict=True):
        if lo[a] == hi[a]:
            sides = [(np.arange(a, b), None)]
        else:
            in_lo = mine[a:b] == lo[a]
            sides = [(a + np.flatnonzero(in_lo), a + np.flatnonzero(~in_lo))]
        for x, y in sides:
            if y is None:
                i, j = np.triu_indices(len(x), 1)
                left, right = x[i], x[j]
            else:
                left, right = np.repeat(x, len(y)), np.tile(y, len(x))
            lefts.append(left)
            rights.append(right)
            total += len(left)
        if total > 500_000:
            yield np.concatenate(lefts), np.concatenate(rights)
            lefts, rights, total = [], [], 0
    if lefts:
        yield np.concatenate(lefts), np.concatenate(rights)


def candidate_links(buckets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): star links that connect the nodes of each connected part of surviving pairs in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(threshold)
        for t in runs(batches, 3):
            node = t.column("node").to_pylist()
            sig = binary_matrix(t.column("sig"), np.uint32, HASHES)
            mine, lo, hi = (t.column(c).to_numpy() for c in ("mine", "lo", "hi"))
            cuts = [0, *key_changes(t, 3).tolist(), t.num_rows]
            for left, right in run_pairs(cuts[:-1], cuts[1:], mine, lo, hi):
                keep = survivors(sig, left, right, least)
                if keep.any():
                    label = components(t.num_rows, left[keep], right[keep])
                    own = np.flatnonzero(label != np.arange(t.num_rows)).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([node[label[i]] for i in own], pa.binary()), pa.array([node[i] for i in own], pa.binary())], names=["a", "b"])

    return block_pairs(buckets, ["bucket"], "size").select("bucket", "lo", "hi", "mine", "node", "sig").mapInArrow(run, "a binary, b binary")


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's connected component, for all nodes that have links (a, b)."""
    both = links.select("a", "b").where("a <> b").distinct()
    both = materialised(both.union(both.select("b", "a")).distinct(), "links")
    labels = materialised(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = lower.alias("x").join(labels.select(F.col("node").alias("via"), F.col("root").alias("beyond")), F.col("next") == F.col("via"))
        stepped = materialised(jump.select("node", F.least("next", "beyond").alias("root"), (F.least("next", "beyond") < F.col("root")).alias("moved")), "labels")
        labels = stepped.select("node", "root")
        if stepped.where("moved").isEmpty():
            return labels


def intersections(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over the shingles that two sets share at least."""
    owner = np.repeat(np.arange(rows), [len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    place = np.full(len(values), -1, np.int64)
    place[shared] = np.arange(len(shared))
    column = place[inverse]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((rows, rows), np.float32)
    for at in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((rows, min(4096, len(shared) - at)), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m @ m.T
    return out


def exact_links(clusters: DataFrame, threshold: float) -> DataFrame:
    """(node, links, hub): per node and run the verified links, and a node of its connected part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(threshold)
        for t in runs(batches, 3):
            cuts = [0, *key_changes(t, 3).tolist(), t.num_rows]
            node = t.column("node").to_pylist()
            mine, lo, hi = (t.column(c).to_numpy() for c in ("mine", "lo", "hi"))
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            sig = np.stack([signature(s) for s in sets])
            for a, b in zip(cuts, cuts[1:], strict=False):
                n = b - a
                links, label = np.zeros(n, np.int64), np.arange(n)
                found: list[tuple[np.ndarray, np.ndarray]] = []
                common = None
                for left, right in run_pairs([a], [b], mine, lo, hi):
                    keep = survivors(sig, left, right, least)
                    left, right = left[keep], right[keep]
                    if not len(left):
                        continue
                    if n == 2:
                        both = np.array([len(np.intersect1d(sets[a], sets[a + 1], assume_unique=True))])
                    else:
                        common = intersections(sets[a:b], n) if common is None else common
                        both = common[left - a, right - a]
                    good = both >= threshold * (sizes[left] + sizes[right] - both) - 1e-9
                    left, right = left[good] - a, right[good] - a
                    links += np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
                    found.append((left, right))
                if found:
                    label = components(n, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
                yield pa.RecordBatch.from_arrays([pa.array(node[a:b], pa.binary()), pa.array(links), pa.array([node[a + i] for i in label.tolist()], pa.binary())], names=["node", "links", "hub"])

    return block_pairs(clusters, ["root"], "size").select("root", "lo", "hi", "mine", "node", "shingles").mapInArrow(run, "node binary, links long, hub binary")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies): one row per document."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialised(nodes_of(source, "doc_id", "text"), "signatures")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    nodes = materialised(nodes, "nodes")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = binary_matrix(b.column(1), np.uint32, HASHES)
            hashes = np.array([band_hashes(s) for s in sig], np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))], names=["bucket", "node"])

    banded = nodes.select("node", "sig").mapInArrow(bands, "bucket long, node binary")
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = materialised(banded.join(sizes, "bucket"), "buckets")
    candidates = connected(candidate_links(crowded.join(nodes.select("node", "sig"), "node"), threshold))
    # Exact verification needs the shingle sets of clustered nodes only: one document of each is read again.
    clusters = candidates.join(candidates.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root").join(nodes.select("node", "first"), "node")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x or "") for x in b.column(3).to_pylist()]
            same = [i for i, (s, n) in enumerate(zip(sets, b.column(1).to_pylist(), strict=True)) if xxhash.xxh128_digest(s.tobytes()) == n]
            part = b.take(pa.array(same, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([sets[i].tobytes() for i in same], pa.binary())], names=["root", "node", "size", "shingles"])

    read = source.join(clusters, F.col("doc_id") == F.col("first")).select("root", "node", "size", "text")
    sets = read.mapInArrow(again, "root binary, node binary, size long, shingles binary").dropDuplicates(["node"])
    linked = materialised(exact_links(sets, threshold), "exact-links")
    counts = linked.groupBy("node").agg(F.sum("links").alias("n_links"))
    parts = connected(linked.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    firsts = parts.join(nodes.select("node", "first"), "node")
    classes = firsts.groupBy("root").agg(F.min("first").alias("class_id"))
    of_node = nodes.select("node", "first", "copies").join(parts, "node", "left").join(classes, "root", "left").join(counts, "node", "left")
    # Nodes that stand for one document and link to nothing need no join: their documents are classes of their own.
    told = of_node.where("copies > 1 OR class_id IS NOT NULL").select("node", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "copies")
    out = signed.select("doc_id", "node").join(told, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"))
    lost = source.where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(lost)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
