"""Operator 3: byte-level BPE encoding and decoding.

Texts of a batch become one array of code points, and that an array of character classes.  Piece boundaries are
found without a regular expression: every position carries a symbol (its class, with what the few next characters
decide folded in), every symbol is a function from states to states, and functions compose associatively.  The scan
runs in two levels: all lanes of the array compute the composed function of their stretch at once, the lane functions
are composed in order, and a second sweep over the lanes with known entry states gives every state.  The slices
between boundaries go through pair merging by rank with a bounded cache per worker.  Token end offsets (in bytes) can be
kept, and ids are decoded by joining their byte strings.

Defined cases: a null or empty text has no tokens; repeated rows each give a row; whole texts of any length; an empty
table gives an empty result; other columns are ignored.  Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CACHE_ENTRIES = 400_000
LANE = 256
#: Unicode White_Space (fixed values): ranges of code points.
WHITE = [(9, 13), (32, 32), (133, 133), (160, 160), (5760, 5760), (8192, 8202), (8232, 8233), (8239, 8239), (8287, 8287), (12288, 12288)]

# Character classes.
OTHER, LETTER, NUMBER, BLANK = range(4)
# States after a character: what kind of piece it lies in.  The bit 8 of a step's result says that the character starts a piece.
IN_OTHER, IN_LETTER, IN_NUMBER, IN_BLANK, PREFIX, TAIL1, TAIL2, FRESH = range(8)
# Symbols: the four classes, a single space that joins what follows, the last blank of a longer run, contractions, a new text.
S_OTHER, S_LETTER, S_NUMBER, S_BLANK, S_JOIN, S_LAST, S_SHORT, S_LONG = range(8)
START = 8


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point, by general category and White_Space."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for a, b in WHITE:
        table[a : b + 1] = BLANK
    return table


def transitions() -> np.ndarray:
    """step[symbol, state] -> new state, plus START where the symbol's character begins a piece.

    An apostrophe that may open a contraction is S_SHORT ('s 't 'm 'd) or S_LONG ('re 've 'll); whether it does is
    up to the state: not after an attached space or inside a run of other characters.
    """
    step = np.zeros((8, 8), np.uint8)
    for state in range(8):
        for symbol, inside in ((S_OTHER, IN_OTHER), (S_LETTER, IN_LETTER), (S_NUMBER, IN_NUMBER)):
            goes_on = state in (inside, PREFIX)
            step[symbol, state] = inside + START * (not goes_on)
        step[S_LETTER, TAIL1] = FRESH
        step[S_LETTER, TAIL2] = TAIL1
        step[S_BLANK, state] = IN_BLANK + START * (state != IN_BLANK)
        step[S_JOIN, state] = PREFIX + START
        step[S_LAST, state] = FRESH + START
        opens = state not in (PREFIX, IN_OTHER)
        step[S_SHORT, state] = TAIL1 + START if opens else IN_OTHER
        step[S_LONG, state] = TAIL2 + START if opens else IN_OTHER
    return step


STEP = transitions()


def symbols(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of every code point; ``first`` marks the first one of each text."""
    cls = class_table()[cps]
    n = len(cps)
    sym = cls.copy()
    nxt = np.full(n, 255, np.uint8)
    nxt[:-1] = np.where(first[1:], 255, cls[1:])
    last_blank = (cls == BLANK) & (nxt != BLANK) & (nxt != 255)
    sym[last_blank] = np.where(cps[last_blank] == 32, S_JOIN, S_LAST)
    quotes = np.flatnonzero(cps == 39)
    if len(quotes):
        # Two characters after each apostrophe, 0 beyond the text's end.
        padded, firsts = np.concatenate([cps, np.zeros(2, cps.dtype)]), np.concatenate([first, np.ones(2, bool)])
        a = np.where(firsts[quotes + 1], 0, padded[quotes + 1])
        b = np.where((a == 0) | firsts[quotes + 2], 0, padded[quotes + 2])
        short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        long = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        sym[quotes[short]] = S_SHORT
        sym[quotes[long]] = S_LONG
    return sym


def boundaries(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which a piece starts, by a two-level scan of transition functions."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    lanes = -(-n // LANE)
    grid = np.zeros(lanes * LANE, np.uint8)
    grid[:n] = symbols(cps, first)
    reset = np.zeros(lanes * LANE, bool)
    reset[:n] = first
    grid, reset = np.ascontiguousarray(grid.reshape(lanes, LANE).T), np.ascontiguousarray(reset.reshape(lanes, LANE).T)
    flat = STEP.reshape(-1)
    # Level 1: the composed function of each lane, as its images of all eight states.
    image = np.repeat(np.arange(8, dtype=np.uint8)[:, None], lanes, axis=1)
    for k in range(LANE):
        image[:, reset[k]] = FRESH
        image = flat[(grid[k].astype(np.intp) << 3) + image] & 7
    # Level 2: compose the lane functions in order.
    entry, state = np.empty(lanes, np.uint8), FRESH
    columns = image.T.tolist()
    for i in range(lanes):
        entry[i] = state
        state = columns[i][state]
    # Level 3: the states and starts inside each lane.
    starts = np.empty((LANE, lanes), bool)
    now = entry
    for k in range(LANE):
        out = flat[(grid[k].astype(np.intp) << 3) + np.where(reset[k], FRESH, now)]
        starts[k] = out >= START
        now = out & 7
    found = starts.T.reshape(-1)[:n]
    return np.flatnonzero(found | first)


class Codec:
    """Encoding and decoding by the ranks of a tiktoken file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.cache: dict[bytes, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece: the neighbouring pair of lowest rank, leftmost first, until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._merged_short(piece) if len(piece) <= 40 else self._merged_long(piece)

    def _merged_short(self, piece: bytes) -> list[int]:
        rank, none = self.ranks.get, 1 << 60
        cuts = list(range(len(piece) + 1))
        pair = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            del cuts[i + 1], pair[i]
            if i < len(pair):
                pair[i] = rank(piece[cuts[i] : cuts[i + 2]], none)
            if i:
                pair[i - 1] = rank(piece[cuts[i - 1] : cuts[i + 1]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same with a heap and linked parts: n log n for pieces of any length."""
        n, rank = len(piece), self.ranks.get
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            end[i], alive[j] = stop, False
            if stop < n:
                prev[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _packed(self, piece: bytes) -> bytes:
        packed = np.array(self.merged(piece), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[piece] = packed
        return packed

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        blob = b"".join(raws)
        cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.zeros(len(cps), bool)
        ends = np.cumsum(sizes)
        first[(ends - sizes)[sizes > 0]] = True
        starts = boundaries(cps, first)
        if len(blob) == len(cps):
            at = starts
        else:
            width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
            at = (np.cumsum(width) - width)[starts]
        cuts = [*at.tolist(), len(blob)]
        get, make = self.cache.get, self._packed
        packed = [get(p) or make(p) for p in map(blob.__getitem__, map(slice, cuts, cuts[1:]))]
        text_at = np.searchsorted(starts, np.concatenate([ends - sizes, ends[-1:]])).tolist()
        return [b"".join(packed[a:b]) for a, b in zip(text_at, text_at[1:], strict=False)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<u4").tolist()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """End offset in bytes of each token."""
        return np.cumsum([len(self.tokens[i]) for i in ids.tolist()])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    made = Codec(path)
    gc.freeze()  # the vocabulary lives as long as the worker; collections need not walk it
    return made


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """(id, ids, ends): token ids of each text and the byte offset at which each token ends."""

    def factory():
        c = codec(ranks)

        def f(texts):
            ids = [np.frombuffer(p, "<u4").astype(np.int64) for p in c.encode_packed(texts)]
            return [ids, [c.offsets(i) for i in ids]]

        return f

    return map_texts(docs, [id_col], text_col, factory, [("ids", "array<long>"), ("ends", "array<long>")])


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = RANKS) -> DataFrame:
    """(id, text): the inverse of :func:`encode`; null ids give an empty text."""

    def run(batches):
        import pyarrow as pa

        c = codec(ranks)
        for b in batches:
            texts = [b"".join(c.tokens[i] for i in ids or ()).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    source = encoded.select(id_col, ids_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, text string")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and return digests of both."""

    def factory():
        c = codec(RANKS)

        def f(texts):
            packed = c.encode_packed(texts)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return [[len(p) // 4 for p in packed], [sha(p) for p in packed], [sha(c.decode(p)) for p in packed]]

        return f

    return map_texts(table(spark, sf_dir, "documents"), ["doc_id"], "text", factory, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")])
