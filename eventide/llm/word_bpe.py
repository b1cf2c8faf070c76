"""Operator 13: BPE encoding and decoding with forced boundaries.

A merge joins neighbouring bytes, so every pair of neighbours inside an id's bytes stands in some token of the
vocabulary.  A byte pair that stands inside no token is therefore a certain cut: no merge ever crosses it, and what
lies left and right of it can be encoded by itself.  One table says for each pair of bytes (and whether the second one ends a
word) if any token holds it.  The texts of a batch become one byte array in which a mark ends each word; looking up all its
neighbours in the table gives all cuts at once; the fragments between cuts are merged by rank with a bounded cache per worker
and their ids are concatenated.

The vocabulary lower-cases, drops white space and marks word ends.  Words follow from character classes: letters, single
numbers, other characters, and the contractions that open where no run of other characters goes on.  Code points that this
Python's Unicode tables do not know are left to the library's own normalisation and splitting; cuts and merges stay the same.  Special
strings inside a text are one token each, as the library's default has it.  The vocabulary names no decoder: decoding
joins the tokens' strings by single spaces.

Defined cases: a null or empty text, or one of white space, has no tokens; repeated rows each give a row; texts and words of
any length are taken whole; nothing is ordered, so there are no ties; an empty table gives an empty result; null ids of documents
stay null; other columns, also ones named like results, are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import BLANK, LETTER, NUMBER, OTHER, WHITE
from .common import RecentCache, map_texts, table
from .token_counts import byte_alphabet

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Entries of the fragment cache in each of two generations; longer fragments are not kept.
FRAGMENTS_KEPT, LONG = 350_000, 64
#: The byte after each word; white space is dropped, so it stands nowhere else.
MARK = 32
UNKNOWN = 4


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point by general category and White_Space; UNKNOWN where it is unassigned here."""
    kinds = {"L": LETTER, "N": NUMBER}
    names = (unicodedata.category(chr(c)) for c in range(0x110000))
    out = np.fromiter((UNKNOWN if k == "Cn" else kinds.get(k[0], OTHER) for k in names), np.uint8, 0x110000)
    for a, b in WHITE:
        out[a : b + 1] = BLANK
    return out


def word_starts(cps: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Marks the first character of each word of lower-case text."""
    start = cls != BLANK
    start[1:] &= (cls[1:] != cls[:-1]) | (cls[1:] == NUMBER)
    quotes = np.flatnonzero(cps == 39)
    quotes = quotes[(quotes == 0) | (cls[quotes - 1] != OTHER)]  # inside a run of others a quote opens nothing
    if len(quotes):
        padded, more = np.concatenate([cps, np.zeros(3, cps.dtype)]), np.concatenate([cls, np.full(3, BLANK, np.uint8)])
        a, b = padded[quotes + 1], padded[quotes + 2]
        long = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        short = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & ~long
        for opens, length in ((quotes[short], 2), (quotes[long], 3)):
            start[opens + 1] = False
            after = opens + length
            start[after[more[after] != BLANK]] = True
    return start


class ForcedCuts:
    """Encoding and decoding under a word-level vocabulary (a tokenizers JSON file)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.as_byte = byte_alphabet()
        letters = {v: k for k, v in self.as_byte.items()}
        self.inner, self.final = ([vocab[letters[b] + e] for b in range(256)] for e in ("", end))
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.pairs = {vocab[x] << 20 | vocab[y]: r << 20 | vocab[x + y] for r, (x, y) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splits = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda t: [t]
        strings = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.strings = [strings.get(i, "").encode() for i in range(max(strings) + 1)]
        self.decimals = [str(i).encode() for i in range(len(self.strings))]
        self.inside = self.pairs_inside(vocab, end)
        self.cache = RecentCache(FRAGMENTS_KEPT)

    def pairs_inside(self, vocab: dict[str, int], end: str) -> np.ndarray:
        """Flat table over (second byte ends the word, first byte, second byte): does any token hold the pair?"""
        out = np.zeros((2, 256, 256), bool)
        for token in vocab:
            ends = token.endswith(end) and token != end
            raw = [self.as_byte[c] for c in (token[: -len(end)] if ends else token) if c in self.as_byte]
            for i, pair in enumerate(zip(raw, raw[1:], strict=False), 2):
                out[int(ends and i == len(raw)), pair[0], pair[1]] = True
        out[:, :, MARK] = True  # the mark goes with the byte before it
        out[:, MARK, :] = False
        return out.reshape(-1)

    def plain(self, text: str) -> str:
        """Normalised text of known code points; white space stays, since it goes later."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # character by character: no final sigma

    def known(self, text: str) -> bool:
        return text.isascii() or not (classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == UNKNOWN).any()

    def words_blob(self, parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bytes with a mark after each word, first position of each part) of parts of known code points."""
        lowered = list(map(self.plain, parts))
        text = "\n".join(lowered) + "\n"
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        cls = classes()[cps]
        start = word_starts(cps, cls)
        end = cls != BLANK
        end[:-1] &= start[1:] | (cls[1:] == BLANK)
        keep = cls != BLANK
        raw = np.frombuffer(text.encode(), np.uint8)
        breaks = np.cumsum([0, *(len(p) + 1 for p in lowered[:-1])])  # where parts begin
        if len(raw) != len(cps):
            width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
            last = np.cumsum(width) - 1
            breaks = np.concatenate([[0], last + 1])[breaks]
            keep, ends = np.repeat(keep, width), np.zeros(len(raw), bool)
            ends[last] = end
            end = ends
        size = keep.astype(np.int64) + end
        at = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(raw, size)
        out[at[1:][end] - 1] = MARK
        return out, at[breaks]

    def library_blob(self, part: str) -> np.ndarray:
        """The same for one part, split into words by the library."""
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return np.frombuffer(b"".join(bytes(self.as_byte[c] for c in w) + b" " for w, _ in words), np.uint8)

    def fragments(self, blob: np.ndarray) -> np.ndarray:
        """Positions at which a fragment starts: after each word's mark, and between bytes whose pair no token holds."""
        n = len(blob)
        if n < 2:
            return np.zeros(min(n, 1), np.int64)
        pair = blob[:-1].astype(np.int32)
        pair <<= 8
        pair |= blob[1:]
        pair[:-1] += (blob[2:] == MARK).astype(np.int32) << 16
        return np.concatenate([[0], np.flatnonzero(~self.inside[pair]) + 1])

    def merged(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the neighbouring pair of lowest rank, leftmost first, until none is left."""
        if fragment[-1] == MARK:
            ids = [self.inner[b] for b in fragment[:-1]]
            ids[-1] = self.final[fragment[-2]]
        else:
            ids = [self.inner[b] for b in fragment]
        if len(ids) == 1:
            return ids
        return self._merged_short(ids) if len(ids) <= LONG else self._merged_long(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        get, none = self.pairs.get, 1 << 60
        ranks = [get(x << 20 | y, none) for x, y in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            ids[i] = low & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked ids: n log n for fragments of any length."""
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (found := get(ids[i] << 20 | ids[j])) is not None:
                heapq.heappush(heap, (found, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            found, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue  # one of the two has merged since
            ids[i], ids[j], after[i] = found & 0xFFFFF, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def _fragment(self, fragment: bytes) -> bytes:
        found = self.cache.older(fragment)
        if found is None:
            ids = self.merged(fragment)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(fragment) <= LONG:
                self.cache.keep(fragment, found)
        return found

    def _encoded(self, blob: np.ndarray, breaks: np.ndarray) -> list[bytes]:
        """Packed ids of each part, which begin at ``breaks``."""
        cuts = self.fragments(blob)
        self.cache.turn()
        raw, bounds = blob.tobytes(), [*cuts.tolist(), len(blob)]
        get, make = self.cache.new.get, self._fragment
        packed = [get(f) or make(f) for f in map(raw.__getitem__, map(slice, bounds, bounds[1:]))]
        at = [*np.searchsorted(cuts, breaks).tolist(), len(packed)]
        return [b"".join(packed[a:b]) for a, b in zip(at, at[1:], strict=False)]

    def encode_packed(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        # A part is a stretch between special strings; it belongs to a text and is encoded with the others of its kind.
        pieces: list[list[bytes | int]] = []
        parts: list[str] = []
        for text in texts:
            own: list[bytes | int] = []
            for i, part in enumerate(self.splits(text) if "<|" in text else [text]):
                if i % 2:
                    own.append(np.array([self.special[part]], "<u4").tobytes())
                elif self.known(part):
                    own.append(len(parts))
                    parts.append(part)
                elif part:
                    blob = self.library_blob(part)
                    own += self._encoded(blob, np.zeros(1, np.int64))
            pieces.append(own)
        found = self._encoded(*self.words_blob(parts)) if parts else []
        return [b"".join(found[p] if isinstance(p, int) else p for p in own) for own in pieces]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<u4").tolist()

    def decode(self, ids: Sequence[int]) -> bytes:
        """The tokens' strings joined by single spaces, in UTF-8; ids that the vocabulary lacks are left out."""
        strings = self.strings
        return b" ".join([s for i in ids if 0 <= i < len(strings) and (s := strings[i])])


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedCuts:
    made = ForcedCuts(path)
    gc.freeze()  # the vocabulary lives as long as the worker; collections need not walk it
    return made


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each text."""

    def factory():
        c = codec(vocabulary)
        return lambda texts: [[np.frombuffer(p, "<u4").astype(np.int64) for p in c.encode_packed(texts)]]

    return map_texts(docs, [id_col], text_col, factory, [("ids", "array<long>")])


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text): what the library's decoding gives for ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            texts = [c.decode(ids or ()).decode() for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    source = encoded.select(id_col, ids_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, text string")


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and return digests of both."""

    def factory():
        c = codec(VOCABULARY)

        def f(texts):
            counts, ids_sha, text_sha = [], [], []
            for packed in c.encode_packed(texts):
                ids = np.frombuffer(packed, "<u4").tolist()
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(b" ".join(map(c.decimals.__getitem__, ids))).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            return [counts, ids_sha, text_sha]

        return f

    return map_texts(table(spark, sf_dir, "documents"), ["doc_id"], "text", factory, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")])
