"""Line dedup, token counts, BPE, media columns, sharding."""

import base64
import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventide.llm import bpe, common, line_dedup, matroska, sharding, token_counts

ALPHABET = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "'r", "'ll", "é", "日本", "1", "23", "!", "<|endoftext|>", "<|endo", " ", "　", "don't", "😀", "the", "\t", "\x1c", "\x85", "²"]
mixed = st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join)


# -- line dedup ---------------------------------------------------------------------------------------------


def line_reference(rows, min_docs, min_chars=1):
    """rows: (id, text); documents differ by id and text."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add((i, t or ""))
    bad = {k for k, d in holders.items() if len(k) >= min_chars and len(d) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in bad]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def dropped(docs, **kw):
    return Counter((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.drop_lines(docs, **kw).collect())


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_match_plain_python(spark, odd_docs, min_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert dropped(odd_docs, min_docs=min_docs) == line_reference(rows, min_docs)


def test_lines_many_positions_and_min_chars(spark):
    texts = ["\n".join([f"own {i} {k}" for k in range(150)] + ["shared TEXT ", "ab"] + ["shared text"] * 3) for i in range(12)] + ["ab\n" * 70]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for m in (1, 3):
        assert dropped(docs, min_docs=10, min_chars=m) == line_reference(list(enumerate(texts)), 10, m)


def test_registered_lines_match_sql_on_repeated_and_null_ids(spark, tmp_path):
    """An id with different texts, null ids and repeated rows: the query and its SQL give the same rows."""
    rows = [(i % 4 if i % 3 else None, f"own {i}\nShared by all \n\nshared BY all") for i in range(14)] + [(1, "Rare"), (1, "Rare")] * 8 + [(5, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == Counter(c.execute(line_dedup.OP9_SQL).fetchall())
    want = Counter((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in line_reference(rows, 10).elements())
    assert got == want and any(d for _, _, d, _ in got)


def test_lines_empty_table(no_docs):
    assert line_dedup.drop_lines(no_docs).count() == 0


def test_keep_bitmaps_hold_no_text(spark):
    docs = spark.createDataFrame([(i, "x\ny%d\nX" % i) for i in range(10)], "doc_id long, text string")
    rows = line_dedup.keep_bitmaps(docs).collect()
    assert len(rows) == 10 and all(r["drops"] == {0: 0b101} for r in rows)


# -- token counts -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(mixed)
def test_every_prefix_counts_as_the_library_does(text):
    c, lib = token_counts.counter(token_counts.VOCABULARY), Tokenizer_cached()
    table = c.table(text)
    assert [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)] == table.tolist()


_lib = []


def Tokenizer_cached():
    if not _lib:
        _lib.append(Tokenizer.from_file(token_counts.VOCABULARY))
    return _lib[0]


def test_token_counts_frame(odd_docs, no_docs, library):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(odd_docs).collect())
    want = Counter()
    for r in odd_docs.collect():
        t = r["text"] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        want[r["doc_id"], len(t.encode()), n, n > 512] += 1
    assert got == want
    assert token_counts.token_counts(no_docs).count() == 0


def test_fits_is_the_longest_prefix_within_the_limit(spark, library):
    text = "This is a longer sentence, with words that split unhappily: antidisestablishmentarianism."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    fits = token_counts.token_counts(docs, limit=7).first()["fits"]
    assert fits == max(i for i in range(len(text) + 1) if len(library.encode(text[:i]).ids) <= 7)
    counts = token_counts.prefix_tables(docs).first()["counts"]
    assert counts[-1] == len(library.encode(text).ids) and len(counts) == len(text) + 1


# -- byte-level BPE -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(tik):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(ALPHABET, rng.integers(0, 15))) for _ in range(5000)] + ["ab" * 3000, "thea" * 2000, "aaaa" * 500, "", " ", "'", "x's", " 's", "\n's", "''s"]
    c = bpe.codec(bpe.RANKS)
    for t, packed in zip(texts, c.encode_packed(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == tik.encode_ordinary(t), t
        assert c.decode(packed) == t.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_bpe_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    c = bpe.codec(bpe.RANKS)
    packed = c.encode_packed([text])[0]
    assert c.decode(packed) == text.encode()


def test_bpe_frames(odd_docs, no_docs, tik):
    encoded = bpe.encode(odd_docs)
    for r in encoded.collect():
        assert len(r["ids"]) == len(r["ends"])
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect())
    assert got == Counter((r["doc_id"], tuple(tik.encode_ordinary(r["text"] or ""))) for r in odd_docs.collect())
    assert Counter((r["doc_id"], r["text"]) for r in bpe.decode(encoded).collect()) == Counter((r["doc_id"], r["text"] or "") for r in odd_docs.collect())
    assert bpe.encode(no_docs).count() == 0


# -- Matroska -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 64, 799, 800, 801, 6400, 6401, 102_400, 250_003])
def test_matroska_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    stored = matroska.mux(data)
    parsed = matroska.demux(stored)
    assert matroska.samples_of(stored) == data
    stamps = [p[0] for p in parsed["packets"]]
    assert stamps == sorted(stamps) and stamps[0] == 0
    assert parsed["tracks"] == {1: "A_PCM/INT/LIT"}
    for _, _, at in parsed["cues"]:
        assert stored[at : at + 4] == (0x1F43B675).to_bytes(4, "big")


def test_matroska_other_lacings_groups_and_unknown_sizes():
    frames = [bytes([i]) * n for i, n in enumerate((300, 3, 255, 17))]
    xiph = bytes([3]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]) + b"".join(frames)
    group = matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, matroska.vint(2) + struct.pack(">hB", -3, 0x02) + xiph))
    ebml = matroska.block(1, 5, frames)
    unknown = b"\x01" + b"\xff" * 7
    first = (matroska.CLUSTER).to_bytes(4, "big") + unknown + matroska.element(matroska.TIME, 10) + group
    second = (matroska.CLUSTER).to_bytes(4, "big") + unknown + matroska.element(matroska.TIME, 20) + ebml
    data = matroska.element(matroska.EBML, b"") + (matroska.SEGMENT).to_bytes(4, "big") + unknown + first + second
    packets = matroska.demux(data)["packets"]
    assert [(t // 1_000_000, n) for t, n, _, _ in packets] == [(7, 2)] * 4 + [(25, 1)] * 4
    assert [data[a:b] for _, _, a, b in packets] == frames * 2


def test_matroska_bad_input():
    with pytest.raises(ValueError):
        matroska.demux(b"\x00\x00")


def test_media_frames(odd_docs, no_docs):
    media = matroska.media_column(odd_docs)
    sizes = Counter((r["doc_id"], len(matroska.samples_of(bytes(r["media"])))) for r in media.collect())
    assert sizes == Counter((r["doc_id"], len(matroska.padded((r["text"] or "").encode()))) for r in odd_docs.collect())
    packets = matroska.packet_table(media).where("doc_id = 7").orderBy("packet").collect()
    data = bytes(media.where("doc_id = 7").first()["media"])
    assert b"".join(data[p["start"] : p["stop"]] for p in packets).rstrip(b"\0").decode() == odd_docs.where("doc_id = 7").first()["text"]
    assert matroska.packet_table(matroska.media_column(no_docs)).count() == 0


# -- sharding -----------------------------------------------------------------------------------------------


def test_lookup_table_is_even_and_stable():
    names = sharding.shard_names(50)
    full = sharding.lookup_table(names, 5003)
    shares = Counter(full)
    assert max(shares.values()) - min(shares.values()) <= 1
    less = sharding.lookup_table(names[:-1], 5003)
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 49)
    assert moved < 0.1 * 5003
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 5003)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 5004)


def test_assign_matches_plain_python(spark, odd_docs, no_docs):
    docs = odd_docs.withColumnRenamed("lang", "slot").withColumnRenamed("source", "shard")
    names = sharding.shard_names(7)
    owner = sharding.lookup_table(names, 101)
    got = sharding.assign(docs, ["doc_id"], names, 101).collect()
    assert len(got) == docs.count()
    for r in got:
        key = "" if r["row"]["doc_id"] is None else str(r["row"]["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, names[owner[slot]])
    assert sharding.assign(no_docs, ["doc_id"], names, 101).count() == 0


def test_write_shards(spark, tmp_path):
    docs = spark.range(200).withColumnRenamed("id", "doc_id")
    path = sharding.write_shards(docs, ["doc_id"], sharding.shard_names(4), str(tmp_path / "out"), 101)
    back = spark.read.parquet(path)
    assert back.count() == 200 and back.select("_shard").distinct().count() == 4


def test_queries_agree_with_each_other(spark, tmp_path, odd_docs):
    odd_docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    media = {(r["doc_id"], r["n_bytes"]): r for r in matroska.op4_media_columns(spark, str(tmp_path)).collect()}
    for r in odd_docs.collect():
        raw = (r["text"] or "").encode()
        m = media[r["doc_id"], len(raw)]
        pay = matroska.padded(raw)
        assert m["payload_sha256"] == hashlib.sha256(pay).hexdigest() or raw in (b"", b" ")
        assert m["tail_crc32"] == zlib.crc32(pay[-64:]) or raw in (b"", b" ")
    ids = bpe.op3_bpe_codec(spark, str(tmp_path)).collect()
    assert Counter(r["decoded_sha256"] for r in ids) == Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in odd_docs.collect())


@pytest.fixture(scope="module")
def odd_tables(spark, odd_docs, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    odd_docs.write.parquet(str(at / "documents.parquet"))
    odd_docs.limit(0).write.parquet(str(at / "empty" / "documents.parquet"))
    return str(at), [(r["doc_id"], r["text"]) for r in odd_docs.collect()]


def test_registered_token_counts(spark, odd_tables):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in odd_tables[1]:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    at = odd_tables[0]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.op2_token_counts(spark, at).collect()) == want
    assert token_counts.op2_token_counts(spark, f"{at}/empty").count() == 0


def test_registered_codec(spark, odd_tables):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in odd_tables[1]:
        ids = lib.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    at = odd_tables[0]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op3_bpe_codec(spark, at).collect()) == want
    assert bpe.op3_bpe_codec(spark, f"{at}/empty").count() == 0


def test_registered_media(spark, odd_tables):
    """Every column of every row, nulls, empty and blank texts included; features by their definition."""
    want = Counter()
    for i, t in odd_tables[1]:
        raw = (t or "").encode()
        pay = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        stored, x = matroska.mux(pay), [float(b) for b in pay]
        mean = sum(x) / len(x)
        across = sum((a >= mean) != (b >= mean) for a, b in zip(x, x[1:], strict=False)) / (len(x) - 1)
        steps = sum((b - a) ** 2 for a, b in zip(x, x[1:], strict=False)) / (len(x) - 1)
        feature = f"{mean:.6f},{math.sqrt(sum((a - mean) ** 2 for a in x) / len(x)):.6f},{across:.6f},{steps:.6f}"
        want[i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature] += 1
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    at = odd_tables[0]
    assert Counter(tuple(r[n] for n in names) for r in matroska.op4_media_columns(spark, at).collect()) == want
    assert matroska.op4_media_columns(spark, f"{at}/empty").count() == 0


def test_registered_sharding(spark, odd_tables):
    owner, names = sharding.lookup_table(sharding.shard_names()), sharding.shard_names()
    want = Counter()
    for i, _ in odd_tables[1]:
        slot = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        want[i, slot, names[owner[slot]]] += 1
    at = odd_tables[0]
    assert Counter((r["doc_id"], r["slot"], r["shard"]) for r in sharding.op5_sharding(spark, at).collect()) == want
    assert sharding.op5_sharding(spark, f"{at}/empty").count() == 0


def test_write_shards_twice_and_nothing(spark, no_docs):
    names = sharding.shard_names(3)
    docs = spark.range(50).withColumnRenamed("id", "doc_id")
    first, second = (sharding.write_shards(docs, ["doc_id"], names) for _ in range(2))
    assert first != second and spark.read.parquet(second).count() == 50
    sharding.write_shards(no_docs, ["doc_id"], names)


def test_caches_stay_bounded_within_one_text():
    cache = common.RecentCache(10)
    for i in range(100):
        cache.keep(i, i)
    assert len(cache.new) == 10
    cache.turn()
    assert (cache.new, cache.older(3), cache.new) == ({3: 3}, 3, {3: 3})
