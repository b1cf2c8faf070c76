"""Operator 2: token counts by prefix dynamic programming.

For a text the operator knows the exact number of tokens of *every* prefix (by code points), so that truncation and
budget questions are lookups and nothing is encoded again.  The table is built from chunks that no merge crosses
(a chunk is a run of non-space characters with at most one space before it, or a run of white space).  Inside a
piece the dynamic programme walks the prefixes: the last token of a prefix is the one suffix token that stays a
token of its own next to the last token of what is left of it, so the count is that of the shorter prefix plus one.
Chunk tables are kept in a bounded cache per worker.

Special strings of the vocabulary inside a text are one token each, as the library's default has it.

Defined cases: a null or empty text has no tokens; repeated rows each give a row; a text of any length is counted
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import RecentCache, map_texts, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Unicode White_Space (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WIDE_SPACE = re.compile(f"[{SPACE}]{{2,}}")
#: Entries of the caches in each of two generations.
CHUNKS_KEPT, WORDS_KEPT, PREFIXES_KEPT, PAIRS_KEPT = 350_000, 400_000, 1_200_000, 400_000


class PrefixCounter:
    """Token counts of all prefixes under a byte-level vocabulary (a tokenizers JSON file)."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        as_byte = byte_alphabet()
        raw = {bytes(as_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in as_byte for c in t)}
        self.longest = max(map(len, raw))
        text_ids = spec["model"]["vocab"]
        letters = {v: k for k, v in as_byte.items()}
        self.single = [text_ids[letters[b]] for b in range(256)]
        # Pair of ids -> rank and id of what they merge into, all as single integers.
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.pairs = {text_ids[x] << 20 | text_ids[y]: r << 20 | text_ids[x + y] for r, (x, y) in enumerate(merges)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.vocab = {t: i for t, i in raw.items() if self.merge(t) == [i]}
        self.apart: dict[int, bool] = {}
        self.chunks, self.words = RecentCache(CHUNKS_KEPT), RecentCache(WORDS_KEPT)
        self.tree: dict[int, int] = {}
        self.known = [0]

    def merge(self, word: bytes) -> list[int]:
        """Plain merging of a short byte string, lowest rank first: the ids."""
        ids = [self.single[b] for b in word]
        get, none = self.pairs.get, 1 << 60
        pairs = [get(x << 20 | y, none) for x, y in zip(ids, ids[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            ids[i] = low & 0xFFFFF
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(ids[i] << 20 | ids[i + 1], none)
            if i:
                pairs[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
        return ids

    def stays_apart(self, left: int, right: int, both: bytes) -> bool:
        """Whether two tokens next to each other (``both`` are their bytes) encode as just these two."""
        if len(self.apart) > PAIRS_KEPT:
            self.apart.clear()
        found = self.apart[left << 20 | right] = self.merge(both) == [left, right]
        return found

    def _last_token(self, piece: bytes, end: int, tails: list[int], sizes: list[int]) -> tuple[int, int]:
        """Start and id of the last token of ``piece[:end]``, given the last tokens (ids and sizes) of all shorter prefixes."""
        vocab, apart, longest = self.vocab.get, self.apart.get, self.longest
        if end <= longest and (token := vocab(piece[:end])) is not None:
            return 0, token
        grown = end - 1 - sizes[end - 1]  # most often the last token grows by a byte
        for start in (grown, *range(end - 1, max(0, end - 1 - longest), -1)):
            if start and (token := vocab(piece[start:end])) is not None:
                fits = apart(tails[start] << 20 | token)
                if fits or fits is None and self.stays_apart(tails[start], token, piece[start - sizes[start] : end]):
                    return start, token
        raise ValueError("the vocabulary lacks single bytes")

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token counts of ``piece[:1]``, ``piece[:2]``, ... by dynamic programming over prefixes.

        The prefixes of short pieces are nodes of a tree that all pieces share.
        """
        counts, tails, sizes = [0], [0], [0]
        if len(piece) > 48:
            for end in range(1, len(piece) + 1):
                start, token = self._last_token(piece, end, tails, sizes)
                counts.append(counts[start] + 1)
                tails.append(token)
                sizes.append(end - start)
            return counts[1:]
        if len(self.tree) > PREFIXES_KEPT:
            self.tree, self.known = {}, [0]
        tree, known, node = self.tree, self.known, 0
        for end, byte in enumerate(piece, 1):
            step = node << 8 | byte
            node = tree.get(step)
            if node is None:
                start, token = self._last_token(piece, end, tails, sizes)
                node = tree[step] = len(known)
                known.append(counts[start] + 1 << 40 | token << 8 | end - start)
            packed = known[node]
            counts.append(packed >> 40)
            tails.append(packed >> 8 & 0xFFFFFFFF)
            sizes.append(packed & 0xFF)
        return counts[1:]

    def _piece(self, piece: str) -> list[int] | bytes:
        """Counts at every code point of a piece."""
        raw = piece.encode("utf-8", "surrogatepass")
        counts = self.piece_counts(raw)
        if piece in ("'re", "'ve", "'ll"):
            counts[1] = 2  # a prefix of a contraction is an apostrophe and a letter
        if len(raw) != len(piece):
            ends = [i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80]
            counts = [counts[e - 1] for e in ends] + counts[-1:]
        if len(piece) <= 32:
            counts = bytes(counts)
            self.words.keep(piece, counts)
        return counts

    def chunk_counts(self, chunk: str) -> list[int] | bytes:
        """Counts at every code point of a chunk."""
        self.words.turn()
        pieces, get, older = self.pieces(chunk), self.words.new.get, self.words.older
        if len(pieces) == 1:
            return get(chunk) or older(chunk) or self._piece(chunk)
        out, base = [], 0
        for piece in pieces:
            out += [base + c for c in get(piece) or older(piece) or self._piece(piece)]
            base = out[-1]
        return out

    def _chunk(self, chunk: str) -> bytes | np.ndarray:
        packed = self.chunks.older(chunk)
        if packed is not None:
            return packed
        counts = self.chunk_counts(chunk)
        packed = counts if type(counts) is bytes else bytes(counts) if max(counts) < 256 else np.array(counts, np.int64)
        if len(chunk) <= 64:
            self.chunks.keep(chunk, packed)
        return packed

    def ordinary(self, text: str) -> np.ndarray:
        """The prefix table of a text in which nothing is special: entry i holds the tokens of ``text[:i]``."""
        if not text:
            return np.zeros(1, np.int64)
        chunks = CHUNK.findall(text)
        self.chunks.turn()
        get, make = self.chunks.new.get, self._chunk
        tables = [get(c) or make(c) if len(c) <= 64 else make(c) for c in chunks]
        if all(type(t) is bytes for t in tables):
            inner = np.frombuffer(b"".join(tables), np.uint8).astype(np.int64)
        else:
            inner = np.concatenate([np.frombuffer(t, np.uint8).astype(np.int64) if type(t) is bytes else t for t in tables])
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(lengths)
        totals = inner[ends - 1]
        table = np.zeros(len(inner) + 1, np.int64)
        table[1:] = inner + np.repeat(np.cumsum(totals) - totals, lengths)
        for run in WIDE_SPACE.finditer(text):  # a prefix that ends in white space has that whole run as one piece
            a, b = run.span()
            table[a + 1 : b + 1] = table[a] + np.array(list(self.chunk_counts(text[a:b])))
        return table

    def table(self, text: str) -> np.ndarray:
        """The prefix table with special strings as one token each."""
        if self.special is None or not self.special.search(text):
            return self.ordinary(text)
        parts, base, at = [np.zeros(1, np.int64)], 0, 0
        for m in [*self.special.finditer(text), None]:
            if m is None:
                parts.append(base + self.ordinary(text[at:])[1:])
                break
            seg = m.start() - at
            whole = self.ordinary(text[at : m.end()])  # prefixes that end inside the special string
            parts.append(base + whole[1 : len(whole) - 1])
            base += int(self.ordinary(text[at : m.start()])[seg]) + 1
            parts.append(np.array([base], np.int64))
            at = m.end()
        return np.concatenate(parts)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte, as byte-level vocabularies write bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    made = PrefixCounter(path)
    gc.freeze()  # the vocabulary lives as long as the worker; collections need not walk it
    return made


def prefix_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, counts): the number of tokens of every prefix of each text, from none to all of it."""

    def factory():
        c = counter(vocabulary)
        return lambda texts: [[c.table(t) for t in texts]]

    return map_texts(docs, [id_col], text_col, factory, [("counts", "array<long>")])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_chars, fits): answers read off the prefix table.

    ``fits`` is the largest number of code points whose prefix takes at most ``limit`` tokens.
    """

    def factory():
        c = counter(vocabulary)

        def f(texts):
            tables = [c.table(t) for t in texts]
            n = [int(t[-1]) for t in tables]
            fits = [len(t) - 1 if k <= limit else int(np.flatnonzero(t <= limit)[-1]) for t, k in zip(tables, n, strict=True)]
            return [[len(t.encode("utf-8", "surrogatepass")) for t in texts], n, [k > limit for k in n], [len(t) for t in texts], fits]

        return f

    return map_texts(docs, [id_col], text_col, factory, [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean"), ("n_chars", "long"), ("fits", "long")])


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
