"""Operator 10: bounded-space online packing of token sequences.

Documents are tokenised and cut only where they exceed the window.  Each Spark partition keeps a fixed number of open
windows; a piece goes to the open window that it fills best, and when none has room the fullest window is emitted.
What is open when a partition ends is merged by rounds: leftovers of 16 partitions meet in one task, whose input is
bounded by 16 times the number of open windows, until one group is left.  Only piece records travel, never token ids.

Defined cases: a null or empty text is the end token alone; repeated rows are packed once each; a text of any length is
cut into whole windows and a rest; of windows with equal room the one opened first takes a piece, or goes first; other columns, also ones named like results, are ignored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RecentCache, materialised, sub_batches, table
from .token_counts import byte_alphabet

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END = 1
WINDOW = 2048
OPEN_WINDOWS = 64
FAN_IN = 16
#: Entries of the caches in each of two generations; longer chunks are not kept.
CHUNKS_KEPT, WORDS_KEPT, LONG = 300_000, 450_000, 64
#: Below this code point nothing composes, and lower case is a matter of single characters.
LATIN = "\u0250"
#: How the vocabulary splits lower-case text into words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Where a text's chunks between white space can't be told from the text alone, the library takes the whole text:
#: special strings, and separators that only one of the two treats as white space.
WHOLE = re.compile("<\\|(?:startoftext|endoftext)\\|>|[\x1c-\x1f]")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, part long"


class WordCache:
    """Ids of texts under a vocabulary that drops white space, so that chunks between it are encoded once each.

    Chunks of Latin script are lower-cased, split into words and merged here, with caches for chunks and for
    words; all others, and texts with special strings, go through the library.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = {v: k for k, v in byte_alphabet().items()}
        self.inner, self.final = ([ids[letters[b] + e] for b in range(256)] for e in ("", end))
        # Pair of ids -> rank and id of what they merge into, all as single integers.
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.pairs = {ids[x] << 20 | ids[y]: r << 20 | ids[x + y] for r, (x, y) in enumerate(merges)}
        self.words_of = regex.compile(WORDS).findall
        self.chunks, self.words = RecentCache(CHUNKS_KEPT), RecentCache(WORDS_KEPT)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merged(self, word: str) -> bytes:
        """Ids of one word: pairs merge by rank, the leftmost of the lowest rank first."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
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
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk without white space."""
        found = self.chunks.older(chunk)
        if found is None:
            if len(chunk) > LONG or max(chunk) >= LATIN:
                found = self._library([chunk])[0]
            else:
                out, low = [], chunk.lower()
                if low.isalpha():
                    words = (low,)
                elif low[-1] in ".," and low[:-1].isalpha():
                    words = (low[:-1], low[-1])
                else:
                    words = self.words_of(low)
                for word in words:
                    ids = self.words.new.get(word) or self.words.older(word)
                    if ids is None:
                        ids = self._merged(word)
                        self.words.keep(word, ids)
                    out.append(ids)
                found = b"".join(out)
            if len(chunk) <= LONG:
                self.chunks.keep(chunk, found)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        for text in texts:
            if WHOLE.search(text):
                out += self._library([text])
                continue
            self.chunks.turn()
            self.words.turn()
            chunks, make = text.split(), self._chunk
            found = list(map(self.chunks.new.get, chunks))
            if None in found:
                found = [make(c) if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
            out.append(b"".join(found))
        return out


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    made = WordCache(path)
    gc.freeze()  # the vocabulary lives as long as the worker; collections need not walk it
    return made


class OpenWindows:
    """At most ``most`` open windows by room left; ``emit(window, pieces, closed)`` takes what is done with."""

    def __init__(self, most: int, size: int) -> None:
        self.most, self.size = most, size
        self.rooms: list[tuple[int, int]] = []  # (room left, window), ascending
        self.pieces: dict[int, list[tuple]] = {}
        self.n = 0

    def new(self) -> int:
        self.n += 1
        return self.n - 1

    def place(self, piece: tuple, length: int) -> tuple[int, list[tuple]] | None:
        """Best fit; gives back a window that is full or had to make way."""
        done = None
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, w = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.most:
                _, old = self.rooms.pop(0)
                done = old, self.pieces.pop(old)
            room, w = self.size, self.new()
            self.pieces[w] = []
        self.pieces[w].append((*piece, self.size - room))
        if room > length:
            insort(self.rooms, (room - length, w))
        elif done is None:
            done = w, self.pieces.pop(w)
        else:
            insort(self.rooms, (0, w))  # full; it is the fullest and goes next
        return done

    def rest(self) -> Iterator[tuple[int, list[tuple], int]]:
        for room, w in self.rooms:
            yield w, self.pieces[w], room


def pieces_of(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, window: int, most: int) -> DataFrame:
    """Tokenise and pack within each partition; ``open`` marks pieces of windows left open at its end."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [x.split()[0] for x in PIECE.split(", ")]
    tail = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_cache(vocabulary), TaskContext.get().partitionId()
        windows, rows = OpenWindows(most, window), []

        def emit(w: int, pieces: list[tuple], is_open: bool) -> None:
            rows.extend((*p[:5], (part << 32) + w, p[5], is_open, part) for p in pieces)

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.bool_(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        for b in batches:
            for sub in sub_batches(b, 1):
                for doc, ids in zip(sub.column(0).to_pylist(), words.encode(sub.column(1).to_pylist()), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        piece = ids[start * 4 : (start + window) * 4]
                        record = (doc, start, len(piece) // 4, zlib.crc32(piece), n)
                        if len(piece) == window * 4:
                            emit(windows.new(), [(*record, 0)], False)
                        elif (done := windows.place(record, len(piece) // 4)) is not None:
                            emit(*done, False)
                if rows:
                    yield batch()
        for w, pieces, room in windows.rest():
            emit(w, pieces, room > 0)
        if rows:
            yield batch()

    return source.mapInArrow(run, PIECE)


def merge_leftovers(pieces: DataFrame, level: int, last: bool, window: int, most: int) -> DataFrame:
    """Pack the leftovers of ``FAN_IN`` partitions together, largest first; at the last level nothing stays open."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        pdf = pdf.sort_values(["length", "doc_id", "start", "sequence_id", "offset"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        windows, where = OpenWindows(1 << 60, window), [(0, 0, False)] * len(pdf)

        def note(w: int, members: list[tuple], is_open: bool) -> None:
            for row, offset in members:
                where[row] = (w, offset, is_open)

        for row, length in enumerate(pdf["length"].tolist()):
            if (done := windows.place((row,), length)) is not None:
                note(*done, False)
        rest = list(windows.rest())
        for i, (w, members, _) in enumerate(rest):  # ascending room: the emptiest stay open
            note(w, members, not last and i >= len(rest) - most)
        w, offset, is_open = zip(*where, strict=True)
        return pdf.assign(sequence_id=(level << 56) + (part << 32) + np.array(w, np.int64), offset=np.array(offset, np.int64), open=np.array(is_open, bool))

    grouped = pieces.withColumn("part", F.expr(f"part div {FAN_IN}"))
    return grouped.groupBy("part").applyInPandas(merge, PIECE)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece."""
    parts = docs.rdd.getNumPartitions()
    packed = materialised(pieces_of(docs, id_col, text_col, vocabulary, window, open_windows), "packing")
    done, rest, level = [packed.where("not open")], packed.where("open"), 0
    while True:
        parts, level = -(-parts // FAN_IN), level + 1
        last = parts <= 1
        merged = merge_leftovers(rest, level, last, window, open_windows)
        if last:
            done.append(merged)
            break
        merged = materialised(merged, "packing-rest")
        done.append(merged.where("not open"))
        rest = merged.where("open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
