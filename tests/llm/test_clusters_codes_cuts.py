"""Dimension-sharded clustering, part codes over metric trees, and forced-boundary BPE."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import lloyd, part_codes, queries, word_bpe

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, code string, chunk long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, 7, "zz", 3) for i, v, l in rows], SCHEMA).repartition(3)


def odd_rows(dim, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.standard_normal(dim) / 4).tolist(), None if i % 7 == 0 else int(i % 3)) for i in range(n)]
    rows += [rows[4]] * 3 + [(rows[5][0], rows[6][1], 1), (None, rows[1][1], 2), (None, rows[2][1], None)]
    rows += [(900 + i, rows[3][1], 1) for i in range(n // 2)]  # one vector in many rows
    bad = [(700, None, 1), (701, [], 1), (702, [1.0] * (dim - 1), 1), (703, [None] + [1.0] * (dim - 1), 1), (704, [float("nan")] * dim, 1), (705, [float("inf")] + [0.0] * (dim - 1), 2)]
    return rows, bad


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_centroids", "op12_part_codes"])
def test_registered_queries_match_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    cursor = c.execute(queries.SQL[name])
    got = queries.QUERIES[name](spark, DATA).select([d[0] for d in cursor.description])
    assert sorted_rows(got) == sorted(map(tuple, cursor.fetchall()), key=str)


def plain_lloyd(rows, k, rounds, scale, seed):
    x = [[int(np.floor(scale * v)) for v in r[1]] for r in rows]
    key = lambda i: (rows[i][0] is None, hashlib.sha256(f"{seed}:{rows[i][0]}".encode()).hexdigest() if rows[i][0] is not None else "", rows[i][1])
    centroids = [x[i] for i in sorted(range(len(x)), key=key)[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for at in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for v in x]  # noqa: B023
        if at < rounds:
            for c in range(len(centroids)):
                mine = [v for v, o in zip(x, own, strict=True) if o == c]
                if mine:
                    centroids[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    d = [far(v, centroids[o]) for v, o in zip(x, own, strict=True)]
    inertia = {c: sum(e for e, o in zip(d, own, strict=True) if o == c) for c in own}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((r[0], o, e, inertia[o], sum(d), sha[o]) for r, o, e in zip(rows, own, d, strict=True)), key=str)


@pytest.mark.parametrize(("k", "shard_columns", "chunk"), [(3, 2, 10), (5, 4, 1000), (200, 3, 17)])
def test_lloyd_against_plain_python(spark, k, shard_columns, chunk):
    rows, bad = odd_rows(6, 40, 1)
    got = lloyd.lloyd(vectors(spark, rows + bad), k=k, rounds=4, dim=6, scale=64, shard_columns=shard_columns, chunk=chunk)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted_rows(got) == plain_lloyd(rows, k, 4, 64, lloyd.SEED)


def test_lloyd_of_nothing_and_of_too_much(spark):
    assert lloyd.lloyd(vectors(spark, [(1, None, 1)])).count() == 0
    assert lloyd.lloyd(vectors(spark, []).limit(0)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        lloyd.lloyd(vectors(spark, [(1, [1e9, 0.0], 1)]), dim=2, shard_columns=1).count()


def test_lloyd_leaves_the_blocks_in_place(spark):
    """A round shuffles partial distances, choices and sums, never the blocks."""
    rows, _ = odd_rows(6, 40, 2)
    df = vectors(spark, rows).select("vec_id", F.col("embedding").alias("v"))
    blocks = lloyd.bucketed(lloyd.blocks_of(df, "v", 6, 64, [0, 3], ["vec_id"], len(rows), 10), 4)
    slices = [np.zeros((2, 3), np.int64)] * 2
    back = lloyd.assigned(blocks, slices, False).withColumn("shard", F.explode(F.array(F.lit(0), F.lit(1))))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = blocks.select("shard", "chunk", "block").join(back.hint("shuffle_hash"), ["shard", "chunk"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = next(p for p in plan.split("\n") if "block#" in p and "Scan" in p)
    assert "Bucketed: true" in scan
    assert plan.count("hashpartitioning(shard") == 1  # the choices alone


def plain_codes(rows, parts, entries, rounds, scale):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[int(np.floor(scale * v)) for v in r[1]] for r in rows])
    pieces = x.reshape(len(x), parts, -1)
    books = pieces[:entries].copy()
    choose = lambda: np.array([[np.square(books[:, p] - v).sum(axis=1).argmin() for p, v in enumerate(row)] for row in pieces])
    for _ in range(rounds):
        own = choose()
        for p in range(parts):
            for e in range(len(books)):
                mine = pieces[own[:, p] == e, p]
                if len(mine):
                    books[e, p] = mine.sum(axis=0) // len(mine)
    own = choose()
    errors = [int(np.square(books[o, range(parts)] - row).sum()) for o, row in zip(own, pieces, strict=True)]
    labels = {}
    for r, e in zip(rows, errors, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for p in range(parts) for e in range(len(books)) for v in books[e, p]).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in o), e, labels[r[2]], sha) for r, o, e in zip(rows, own, errors, strict=True)), key=str)


@pytest.mark.parametrize(("entries", "chunk"), [(8, 30), (16, 5000), (250, 64)])
def test_codes_against_plain_numpy(spark, entries, chunk):
    rows, bad = odd_rows(8, 60, 3)
    got = part_codes.encode(vectors(spark, rows + bad), parts=4, entries=entries, rounds=3, scale=32, chunk=chunk)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted_rows(got) == plain_codes(rows, 4, entries, 3, 32)


def test_codes_of_nothing(spark):
    assert part_codes.encode(vectors(spark, [(1, None, 1), (2, [1.0, 2.0], 2)])).count() == 0


@pytest.mark.parametrize("kind", ["normal", "clustered", "copies", "line"])
def test_trees_hold_their_points_and_give_the_nearest(kind):
    rng = np.random.default_rng(4)
    x = {
        "normal": rng.normal(0, 40, (3000, 4)), "clustered": rng.normal(0, 3, (3000, 4)) + rng.normal(0, 300, (9, 4))[rng.integers(0, 9, 3000)],
        "copies": np.tile(rng.normal(0, 40, (3, 4)), (500, 1)), "line": np.arange(2000)[:, None] * np.ones((1, 4)),
    }[kind].astype(np.int32)
    tree = part_codes.tree_of(x)
    assert np.array_equal(tree.points[tree.places], x) and tree.sums[0].tolist() == [len(x), *x.sum(axis=0).tolist()]
    for ball, (a, b, left, right) in zip(tree.balls, tree.ranges, strict=True):
        assert np.sqrt(np.square(tree.points[a:b] - ball[:-1]).sum(axis=1)).max() <= ball[-1] + 1e-6
        assert left < 0 or (tree.ranges[left, 0], tree.ranges[left, 1], tree.ranges[right, 1]) == (a, tree.ranges[right, 0], b)
    book = x[rng.integers(0, len(x), 64)].astype(np.int64)  # with repeated entries
    d = np.square(x[:, None].astype(np.int64) - book[None]).sum(axis=2)
    codes, errors = part_codes.part_codes(tree, book)
    assert np.array_equal(codes, d.argmin(axis=1)) and np.array_equal(errors, d.min(axis=1))
    want = np.zeros((64, 5), np.int64)
    np.add.at(want, codes, np.column_stack([np.ones(len(x), np.int64), x]))
    assert np.array_equal(part_codes.part_sums(tree, book), want)
    owned, points, _ = part_codes.settled(tree, book)
    assert sum((tree.ranges[b, 1] - tree.ranges[b, 0]).sum() for b, _ in owned) + len(points) == len(tree.points)
    if kind == "clustered":  # balls of one cluster go to one entry as a whole, most points are never visited
        far = np.stack([x[i] for i in rng.permutation(len(x))[:8]]).astype(np.int64)
        assert len(part_codes.settled(tree, far)[1]) < len(tree.points) / 2


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe.VOCABULARY)
    t.no_padding()
    t.no_truncation()
    return t


def texts_for_cuts():
    rng = random.Random(5)
    bits = [*"abcstmdrevl'\"!?.,0123 \n\t\x1c\x85\xa0", "'s", "'re", "'ll", "'ve", "<|endoftext|>", "<|startoftext|>", "é", "é", "İ", "Σ", "ΑΣ", "ß", "日本", "😀", "½", "Ⅷ", "̀", "Ᲊ", "Ɤ", "한", "'S", "<|", "|>"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    return [*out, "", " \n", "x" * 5000, "thethe" * 900 + "s", "é" * 3000, "".join(rng.choice("abcdefghij") for _ in range(5000))]


def test_forced_cuts_against_the_library(library):
    c, texts = word_bpe.codec(word_bpe.VOCABULARY), texts_for_cuts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(p, "<u4").tolist() for p in c.encode_packed(texts)] == want
    assert [c.encode(t) for t in texts[:200]] == want[:200]
    assert [c.decode(ids).decode() for ids in want] == [library.decode(ids, skip_special_tokens=False) for ids in want]


def test_no_token_holds_a_pair_that_is_cut():
    """The cuts are certain: between them stand whole tokens, and words are really cut inside."""
    c = word_bpe.codec(word_bpe.VOCABULARY)
    rng = random.Random(6)
    words = ["".join(rng.choice("aeiqxzjkv") for _ in range(9)) for _ in range(500)]
    blob, breaks = c.words_blob([" ".join(words)])
    assert breaks.tolist() == [0]
    cuts = c.fragments(blob)
    assert len(cuts) > 1.5 * len(words)
    ends = [(t.removesuffix(b"</w>"), t.endswith(b"</w>")) for t in c.strings if not t.startswith(b"<|")]
    inner = {p for t, end in ends for p in zip(t, t[1 : len(t) - end], strict=False)}
    final = {(t[-2], t[-1]) for t, end in ends if end and len(t) > 1}
    for i in cuts[1:]:
        if blob[i - 1] != 32:
            assert (blob[i - 1], blob[i]) not in (final if blob[i + 1] == 32 else inner)


def test_codec_on_odd_documents(spark, odd_docs, no_docs, library):
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    encoded = word_bpe.encode(odd_docs)
    want = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in rows]
    assert sorted_rows(encoded) == sorted(want, key=str)
    assert sorted_rows(word_bpe.decode(encoded)) == sorted(((i, library.decode(ids, skip_special_tokens=False)) for i, ids in want), key=str)
    assert word_bpe.encode(no_docs).count() == 0


def test_op13_against_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted_rows(word_bpe.op13_word_bpe(spark, DATA)) == sorted(want, key=str)
