"""Matroska: bytes as lossless 8-bit PCM in EBML, and a parser to packet tables.

The writer puts a payload of whole 64-byte packets into one audio track: clusters of SimpleBlocks whose packets are
laced, a cue for each cluster. The parser reads variable-length elements (unknown sizes too), tracks, clusters, simple
blocks and block groups, all four lacings and cues, and gives a packet for each frame: track, timestamp, byte range.

Defined cases: a null text is empty; an empty text's payload is one packet of zeros; any column type but text is
ignored; repeated rows get equal values, as nothing in a file depends on more than its payload; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowfield.llm.common import texts_of, written

PACKET = 64  # bytes, and samples, of a packet
RATE = 8000  # samples a second: a packet lasts 8 ms
LACED = 64  # packets of a block
CLUSTER = 1 << 19  # payload bytes of a cluster

# Element ids of EBML and Matroska.
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOCTYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, ENTRY, NUMBER, UID, KIND, LACING, CODEC, AUDIO, FREQUENCY, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTERS, STAMP, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, POINT, TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """A size or number with its length marker; a value of all ones is left to mean unknown."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, data: bytes) -> bytes:
    return _id(kind) + vint(len(data)) + data


def _uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(sizes: list[int], lacing: int) -> bytes:
    """The lacing head of a block: count, and all sizes but the last."""
    if lacing == NO_LACING:
        return b""
    head = bytes([len(sizes) - 1])
    if lacing == XIPH:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if lacing == EBML_LACING and len(sizes) > 1:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head


def simple_block(track: int, offset: int, sizes: list[int], data: bytes, lacing: int) -> bytes:
    """A block of the packets that lie end to end in data."""
    return element(SIMPLE, vint(track) + struct.pack(">hB", offset, 0x80 | lacing << 1) + lace(sizes, lacing) + data)


_HEAD = element(EBML, _uint(VERSION, 1) + _uint(READ_VERSION, 1) + _uint(MAX_ID, 4) + _uint(MAX_SIZE, 8) + element(DOCTYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2))


def mux(payload: bytes, lacing: int = FIXED, cluster: int = CLUSTER) -> bytes:
    """A whole file. len(payload) is a positive multiple of PACKET; only the payload decides its bytes."""
    ms = 1000 * PACKET // RATE
    info = element(INFO, _uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) / RATE * 1000)) + element(MUXER, b"rowfield") + element(WRITER, b"rowfield"))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", float(RATE))) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(KIND, 2) + _uint(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    per_block = 1 if lacing == NO_LACING else LACED
    cluster = min(cluster, 30_000 // ms * PACKET)  # a block's time in its cluster has 16 bits
    for lo in range(0, len(payload), cluster):
        time, stop, body = lo // PACKET * ms, min(lo + cluster, len(payload)), []
        for b in range(lo, stop, per_block * PACKET):
            data = payload[b : min(b + per_block * PACKET, stop)]
            body.append(simple_block(1, (b - lo) // PACKET * ms, [PACKET] * (len(data) // PACKET), data, lacing))
        made = element(CLUSTERS, _uint(STAMP, time) + b"".join(body))
        cues.append(element(POINT, _uint(TIME, time) + element(POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(made)
        at += len(made)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


class Track(NamedTuple):
    number: int
    kind: int
    codec: str
    rate: float
    channels: int
    depth: int


class Media(NamedTuple):
    """tracks by number; cues as (time in ms, track, byte of the cluster); packets as equally long arrays."""

    tracks: dict[int, Track]
    cues: list[tuple[float, int, int]]
    clusters: int
    duration_ms: float
    track: np.ndarray
    time_ms: np.ndarray
    key: np.ndarray
    start: np.ndarray
    size: np.ndarray


def _number(data: bytes, at: int, end: int, keep_marker: bool) -> tuple[int, int, bool]:
    """(value, next place, whether all of its bits are ones) of a variable-length number."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"a number at {at} is cut off")
    value = int.from_bytes(data[at : at + width], "big")
    low = value & (1 << 7 * width) - 1
    return (value if keep_marker else low), at + width, low == (1 << 7 * width) - 1


#: Elements that end an element of unknown size on the same or a higher level.
_ENDS = {CLUSTERS: {CLUSTERS, CUES, INFO, TRACKS, SEGMENT, EBML}, SEGMENT: {SEGMENT, EBML}}


def children(data: bytes, at: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, place, start, end) of the elements of a range. One of unknown size reaches to the element that ends it."""
    while at < end:
        place = at
        kind, at, _ = _number(data, at, end, True)
        size, at, unknown = _number(data, at, end, False)
        stop = _unknown_end(data, at, end, kind) if unknown else at + size
        if stop > end:
            raise ValueError(f"an element at {place} reaches beyond its parent")
        yield kind, place, at, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int, kind: int) -> int:
    while at < end:
        child, after, _ = _number(data, at, end, True)
        if child in _ENDS.get(kind, ()):
            return at
        size, after, unknown = _number(data, after, end, False)
        at = _unknown_end(data, after, end, child) if unknown else after + size
    return end


def _unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def _sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[int, np.ndarray]:
    """(start of the frames, their sizes) of a block's laced part."""
    if lacing == NO_LACING:
        return at, np.array([end - at])
    n, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError("a fixed lace of unequal frames")
        return at, np.full(n, (end - at) // n)
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            before = at
            value, at, _ = _number(data, at, end, False)
            size = value if i == 0 else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    return at, np.array(sizes)


def parse(data: bytes) -> Media:
    tracks, cues, blocks = {}, [], []
    scale, duration, clusters, base = 1_000_000, 0.0, 0, None
    top = list(children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("not EBML")
    for kind, _, a, b in top:
        if kind != SEGMENT:
            continue
        base = a
        for k, _, a1, b1 in children(data, a, b):
            if k == INFO:
                for k2, _, a2, b2 in children(data, a1, b1):
                    scale = _unsigned(data, a2, b2) if k2 == SCALE else scale
                    duration = _float(data, a2, b2) if k2 == DURATION else duration
            elif k == TRACKS:
                for k2, _, a2, b2 in children(data, a1, b1):
                    if k2 == ENTRY:
                        track = _track(data, a2, b2)
                        tracks[track.number] = track
            elif k == CUES:
                for _, _, a2, b2 in children(data, a1, b1):
                    cues += _cue(data, a2, b2, scale / 1e6, base)
            elif k == CLUSTERS:
                clusters += 1
                stamp = 0
                for k2, _, a2, b2 in children(data, a1, b1):
                    if k2 == STAMP:
                        stamp = _unsigned(data, a2, b2)
                    elif k2 == SIMPLE:
                        blocks.append((stamp, a2, b2, None))
                    elif k2 == GROUP:
                        inner = {x[0]: x for x in children(data, a2, b2)}
                        blocks.append((stamp, *inner[BLOCK][2:], 0xFB not in inner))  # a block without a reference is a key frame
    columns: list[tuple[np.ndarray, ...]] = []
    for stamp, a, b, key in blocks:
        number, at, _ = _number(data, a, b, False)
        offset, flags = struct.unpack_from(">hB", data, at)
        start, sizes = _sizes(data, at + 3, b, flags >> 1 & 3)
        n, track = len(sizes), tracks.get(number)
        places = start + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        # frames of a lace follow each other; PCM tells how long each lasts
        each = track.channels * track.depth // 8 * track.rate if track and track.codec.startswith("A_PCM") else 0
        times = (stamp + offset) * scale / 1e6 + ((places - start) / each * 1000 if each else 0)
        columns.append((np.full(n, number), np.broadcast_to(times, n), np.full(n, bool(flags & 0x80) if key is None else key), places, sizes))
    merged = [np.concatenate(c) for c in zip(*columns, strict=True)] if columns else [np.zeros(0, t) for t in (int, float, bool, int, int)]
    return Media(tracks, cues, clusters, duration * scale / 1e6, *merged)


def _track(data: bytes, a: int, b: int) -> Track:
    found = {k: (x, y) for k, _, x, y in children(data, a, b)}
    audio = {k: (x, y) for k, _, x, y in children(data, *found[AUDIO])} if AUDIO in found else {}
    get = lambda d, k, default: _unsigned(data, *d[k]) if k in d else default
    codec = data[slice(*found[CODEC])].decode() if CODEC in found else ""
    return Track(get(found, NUMBER, 0), get(found, KIND, 0), codec, _float(data, *audio[FREQUENCY]) if FREQUENCY in audio else 8000.0, get(audio, CHANNELS, 1), get(audio, DEPTH, 0))


def _cue(data: bytes, a: int, b: int, ms: float, base: int) -> list[tuple[float, int, int]]:
    time, out = 0, []
    for k, _, x, y in children(data, a, b):
        if k == TIME:
            time = _unsigned(data, x, y)
        elif k == POSITIONS:
            found = {k2: _unsigned(data, x2, y2) for k2, _, x2, y2 in children(data, x, y)}
            out.append((time * ms, found.get(CUE_TRACK, 0), base + found.get(CUE_CLUSTER, 0)))
    return out


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    """The frames of a track, end to end."""
    own = np.flatnonzero(media.track == track)
    starts, ends = media.start[own], media.start[own] + media.size[own]
    cut = np.flatnonzero(starts[1:] != ends[:-1])  # frames of a lace lie side by side
    lo, hi = np.concatenate([starts[:1], starts[1:][cut]]), np.concatenate([ends[:-1][cut], ends[-1:]])
    return b"".join(data[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True))


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % PACKET or (0 if text else PACKET))


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media (a Matroska file), written to the shared folder as a table and read from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, whole in texts_of(batch, 1):
                texts = [t or b"" for t in whole]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=[key, "n_bytes", "media"])

    made, _ = written(docs.select(key, text).mapInArrow(run, f"{key} long, n_bytes long, media binary"), "media")
    return made


def packets(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packet table: key, track, packet, time_ms, keyframe, start, size (the byte range within the media column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in (row for part, files in texts_of(batch, 1) for row in zip(part.column(0).to_pylist(), files, strict=True)):
                m = parse(data)
                n = len(m.start)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), *[pa.array(c, t) for c, t in ((m.track, pa.int64()), (np.arange(n), pa.int64()), (m.time_ms, pa.float64()), (m.key, pa.bool_()), (m.start, pa.int64()), (m.size, pa.int64()))]], names=[key, "track", "packet", "time_ms", "keyframe", "start", "size"])

    return media.select(key, "media").mapInArrow(run, f"{key} long, track long, packet long, time_ms double, keyframe boolean, start long, size long")


def feature(media: Media, payload: bytes) -> str:
    """Packets, clusters, cues and duration, then mean, deviation and crossings of the middle of the samples."""
    x = np.frombuffer(payload, np.uint8)
    n = len(x)
    total, squares = int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.int64).sum())
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    deviation = max(0.0, squares / n - (total / n) ** 2) ** 0.5
    return f"packets={len(media.start)};clusters={media.clusters};cues={len(media.cues)};ms={media.duration_ms:.0f};last={media.time_ms[-1]:.0f};mean={total / n:.3f};sd={deviation:.3f};crossings={crossings}"


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per file, all from its stored bytes: payload, sizes and digests of payload and file, and the feature string."""
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, files in (part for batch in batches for part in texts_of(batch, 2)):
            out = []
            for name, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), files, strict=True):
                m = parse(data)
                payload = payload_of(data, m)
                out.append((name, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PACKET:]), len(data), hashlib.sha256(data).hexdigest(), feature(m, payload)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, types, strict=True)], names=names)

    return media.select(key, "n_bytes", "media").mapInArrow(run, f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
