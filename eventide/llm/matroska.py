"""Operator 4: media columns in Matroska.

:func:`mux` stores 8-bit mono PCM samples as a Matroska file: EBML header, segment with info, one audio track,
clusters of simple blocks (fixed-size lacing where frames are of one size, EBML lacing at the end of a cluster) and
cues.  :func:`demux` parses any such file back: variable-length ids and sizes (known and unknown), clusters, block
groups, all lacing modes and cues, into a packet table with timestamps, tracks and byte ranges.  Nothing is decoded
in between: samples are read from the byte ranges of the packet table.

Defined cases: a null or empty text is 64 zero bytes; equal texts give equal files; repeated rows each give a row;
texts of any length are stored whole; an empty table gives an empty result; a null media column has no packets; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

RATE = 8000
FRAME = 800  # samples in a frame: 100 ms
LACED = 8  # frames in a block
BLOCKS = 16  # blocks in a cluster
UNIT = 64

# Element ids (fixed values of the format).
EBML, DOC_TYPE, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
MUXER, WRITER, TRACKS, TRACK, NUMBER, UID, KIND, CODEC = 0x4D80, 0x5741, 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, HERTZ, CHANNELS, BITS, CLUSTER, TIME, SIMPLE, GROUP, BLOCK = 0xE1, 0xB5, 0x9F, 0x6264, 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER, VERSION, READ_VERSION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0x4286, 0x42F7
DOC_VERSION, DOC_READ, LACING = 0x4287, 0x4285, 0x9C
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT}
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, SEGMENT}


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; the all-ones value is reserved for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes | int | float | str) -> bytes:
    if isinstance(body, str):
        body = body.encode()
    elif isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def block(track: int, at: int, frames: list[bytes]) -> bytes:
    """A simple block: no lacing for one frame, fixed-size lacing for equal frames, EBML lacing otherwise."""
    sizes = [len(f) for f in frames]
    mode = 0 if len(frames) == 1 else 2 if len(set(sizes)) == 1 else 3
    head = vint(track) + struct.pack(">hB", at, 0x80 | mode << 1)
    if mode:
        head += bytes([len(frames) - 1])
    if mode == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            d = b - a
            width = next(w for w in range(1, 9) if abs(d) < 1 << 7 * w - 1)
            head += vint(d + (1 << 7 * width - 1) - 1, width)
    return element(SIMPLE, head + b"".join(frames))


def mux(samples: bytes, rate: int = RATE, frame: int = FRAME) -> bytes:
    """Unsigned 8-bit mono samples as a Matroska file."""
    head = element(EBML, element(VERSION, 1) + element(READ_VERSION, 1) + element(DOC_TYPE, "matroska") + element(DOC_VERSION, 4) + element(DOC_READ, 2))
    info = element(INFO, element(SCALE, 1_000_000) + element(DURATION, len(samples) * 1000 / rate) + element(MUXER, "eventide") + element(WRITER, "eventide"))
    audio = element(AUDIO, element(HERTZ, float(rate)) + element(CHANNELS, 1) + element(BITS, 8))
    tracks = element(TRACKS, element(TRACK, element(NUMBER, 1) + element(UID, 1) + element(KIND, 2) + element(LACING, 1) + element(CODEC, "A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    step = frame * LACED * BLOCKS
    for start in range(0, len(samples), step):
        now = start * 1000 // rate
        parts = [element(TIME, now)]
        for b in range(start, min(start + step, len(samples)), frame * LACED):
            stop = min(b + frame * LACED, start + step, len(samples))
            parts.append(block(1, b * 1000 // rate - now, [samples[i : min(i + frame, stop)] for i in range(b, stop, frame)]))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE, element(CUE_TIME, now) + element(CUE_AT, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, next position); None for the reserved unknown size."""
    first = data[at]
    width = 9 - first.bit_length()
    if not first or at + width > len(data):
        raise ValueError(f"bad variable-length integer at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, body start, body end) of the elements of one level.

    An element of unknown size goes on to the next element that can't lie in it: a cluster ends at the next
    element of the segment's level.
    """
    while at < end:
        ident, body = read_vint(data, at, keep_marker=True)
        size, body = read_vint(data, body)
        if size is None:
            stop = end
            if ident == CLUSTER:
                for inner, a, b in elements(data, body, end):
                    if inner in TOP_LEVEL:
                        break
                    stop = b
                else:
                    stop = end
        else:
            stop = body + size
            if stop > end:
                raise ValueError(f"element {ident:#x} at byte {at} ends after its parent")
        yield ident, body, stop
        at = stop


def number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def laced(data: bytes, at: int, end: int, mode: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames in a block's body."""
    if not mode:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if mode == 2:
        if (end - at) % count:
            raise ValueError("a block with fixed-size lacing doesn't divide")
        sizes = [(end - at) // count] * count
    elif mode == 1:
        for _ in range(count - 1):
            size = 0
            while True:
                size, at, more = size + data[at], at + 1, data[at] == 255
                if not more:
                    break
            sizes.append(size)
    else:
        for i in range(count - 1):
            width = 9 - data[at].bit_length()
            n, at = read_vint(data, at)
            if i:
                n = (1 << 7 * width) - 1 if n is None else n
                n = sizes[-1] + n - ((1 << 7 * width - 1) - 1)
            sizes.append(n)
    if mode != 2:
        sizes.append(end - at - sum(sizes))
    out = []
    for n in sizes:
        if n < 0:
            raise ValueError("laced frames exceed their block")
        out.append((at, at + n))
        at += n
    return out


def demux(data: bytes) -> dict:
    """{"packets": [(timestamp in ns, track, start, end)], "cues": [(time, track, cluster position)], "tracks": {...}}."""
    packets, cues, tracks, scale = [], [], {}, 1_000_000

    def frames(a: int, b: int, base: int) -> None:
        track, at = read_vint(data, a)
        offset, flags = struct.unpack_from(">hB", data, at)
        for x, y in laced(data, at + 3, b, flags >> 1 & 3):
            packets.append(((base + offset) * scale, track, x, y))

    for ident, a, b in elements(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        for top, c, d in elements(data, a, b):
            if top == INFO:
                scale = next((number(data, x, y) for i, x, y in elements(data, c, d) if i == SCALE), scale)
            elif top == TRACKS:
                for i, x, y in elements(data, c, d):
                    if i == TRACK:
                        own = {k: (p, q) for k, p, q in elements(data, x, y)}
                        codec = data[slice(*own[CODEC])].decode() if CODEC in own else ""
                        tracks[number(data, *own[NUMBER])] = codec
            elif top == CLUSTER:
                base = 0
                for i, x, y in elements(data, c, d):
                    if i == TIME:
                        base = number(data, x, y)
                    elif i == SIMPLE:
                        frames(x, y, base)
                    elif i == GROUP:
                        for j, p, q in elements(data, x, y):
                            if j == BLOCK:
                                frames(p, q, base)
            elif top == CUES:
                for i, x, y in elements(data, c, d):
                    if i == CUE:
                        own = {k: (p, q) for k, p, q in elements(data, x, y)}
                        place = {k: number(data, p, q) for k, p, q in elements(data, *own[CUE_AT])}
                        cues.append((number(data, *own[CUE_TIME]) * scale, place.get(CUE_TRACK, 0), place.get(CUE_CLUSTER, 0) + a))
    return {"packets": packets, "cues": cues, "tracks": tracks}


def samples_of(data: bytes, track: int = 1) -> bytes:
    return b"".join(data[a:b] for _, t, a, b in demux(data)["packets"] if t == track)


def features(samples: bytes) -> str:
    """Mean, deviation, share of steps across the mean, and energy of the first difference, with six decimals."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64)
    if not len(x):
        return "0.000000,0.000000,0.000000,0.000000"
    mean, d = x.mean(), np.diff(x)
    across = np.mean((x[1:] >= mean) != (x[:-1] >= mean)) if len(x) > 1 else 0.0
    return f"{mean:.6f},{x.std():.6f},{across:.6f},{np.mean(d * d) if len(d) else 0.0:.6f}"


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text as a Matroska file."""
    return map_texts(docs, [id_col], text_col, lambda: lambda texts: [[mux(padded(t.encode())) for t in texts]], [("media", "binary")])


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, packet, ts_ns, track, start, stop): one row per frame of each file."""
    source = media.select(id_col, media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column(0), b.column(1), strict=True):
                if data.is_valid and (packets := demux(data.as_py())["packets"]):
                    ts, track, start, stop = zip(*packets, strict=True)
                    n = len(packets)
                    yield pa.RecordBatch.from_arrays([pa.repeat(key, n), pa.array(range(n), pa.int64()), *(pa.array(x, pa.int64()) for x in (ts, track, start, stop))], names=[id_col, "packet", "ts_ns", "track", "start", "stop"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, packet long, ts_ns long, track long, start long, stop long")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document, read the stored bytes back through the packet table, and return digests and features."""

    def factory():
        def f(texts):
            raws = [t.encode() for t in texts]
            files = [mux(padded(r)) for r in raws]
            packets = [demux(x)["packets"] for x in files]
            back = [b"".join(x[a:b] for _, _, a, b in ps) for x, ps in zip(files, packets, strict=True)]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return [
                [len(r) for r in raws], [len(p) for p in back], [sha(p) for p in back], [zlib.crc32(p[-UNIT:]) for p in back],
                [len(x) for x in files], [sha(x) for x in files], [features(p) for p in back],
                [len(ps) for ps in packets],
            ]

        return f

    fields = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("n_packets", "long")]
    return map_texts(table(spark, sf_dir, "documents"), ["doc_id"], "text", factory, fields)
