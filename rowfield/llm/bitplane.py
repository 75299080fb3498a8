"""A token-id file format of bit planes.

Ids are cut into blocks of BLOCK ids. A block is transposed: plane b holds bit b of all its ids, eight to a byte, or,
in byte planes, plane b holds byte b. Planes above the block's largest id aren't stored. Each plane is compressed by
zstandard by itself. A file ends with the document table (ids and token counts, compressed), the chunk index (offset,
ids and plane sizes of each block), and a fixed-size trailer that says where they lie.

    magic | planes of block 0 | planes of block 1 | ... | documents | chunk index | trailer

A corpus is a folder of such files in ascending document order, one for each range of ids; a manifest, one row a file,
gives the ids before each.

Defined cases: null texts are empty and have the end id only; rows without an id come last; repeated rows are written as
often as they occur, those of one id in order of their texts; a text of any length is written, block by block; an empty
table gives an empty corpus; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowfield.llm import store
from rowfield.llm.common import scratch_path, slices, written

MAGIC = b"RFPLANE1"
BLOCK = 1 << 16
LEVEL = 3
#: Ids of a batch of documents that is read back; a longer document is a batch of its own.
OUT = 1 << 20
_TRAILER = struct.Struct("<QQQQ8s")  # document table, chunk index, documents, ids, magic
_CHUNK = struct.Struct("<QIB")  # offset, ids, planes; then one u32 a plane


def to_planes(ids: np.ndarray, bits: bool = True) -> np.ndarray:
    """(planes, bytes): planes of up to 32 bits or 4 bytes, as many as the largest id needs."""
    data = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()) if len(ids) else 0
    if not bits:
        return np.ascontiguousarray(data[:, : max(1, -(-top.bit_length() // 8))].T)
    width = max(1, top.bit_length())
    data = data[:, : -(-width // 8)]
    flags = np.unpackbits(np.ascontiguousarray(data), axis=1, bitorder="little")[:, :width]
    return np.packbits(np.ascontiguousarray(flags.T), axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, bits: bool = True) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if not bits:
        out[:, : len(planes)] = planes.T
    else:
        flags = np.zeros((n, -(-len(planes) // 8) * 8), np.uint8)
        flags[:, : len(planes)] = np.unpackbits(planes, axis=1, count=n, bitorder="little").T
        out[:, : flags.shape[1] // 8] = np.packbits(flags, axis=1, bitorder="little")
    return out.view("<u4").ravel()


class Written(NamedTuple):
    documents: int
    ids: int


def write(file, documents: Iterable[tuple[int | None, bytes]], block: int = BLOCK, bits: bool = True) -> Written:
    """documents: (id, its token ids as little-endian unsigned 32-bit numbers). Holds one block and one document."""
    press = zstandard.ZstdCompressor(level=LEVEL).compress
    index, at, names, counts, rest = [], len(MAGIC) + 1, [], [], np.zeros(0, "<u4")
    file.write(MAGIC + bytes([bits]))

    def put(ids: np.ndarray) -> None:
        nonlocal at
        planes = [press(p.tobytes()) for p in to_planes(ids, bits)]
        index.append(_CHUNK.pack(at, len(ids), len(planes)) + struct.pack(f"<{len(planes)}I", *map(len, planes)))
        for p in planes:
            file.write(p)
            at += len(p)

    held, size = [], 0
    for name, data in documents:
        ids = np.frombuffer(data, "<u4")
        names.append(name)
        counts.append(len(ids))
        held.append(ids)
        size += len(ids)
        if size >= block:
            rest = np.concatenate(held)
            for lo in range(0, size - block + 1, block):
                put(rest[lo : lo + block])
            held = [rest[size // block * block :]]
            size = len(held[0])
    if size:
        put(np.concatenate(held))
    missing = np.array([n is None for n in names], np.uint8)
    table = press(missing.tobytes() + np.array([n or 0 for n in names], "<i8").tobytes() + np.array(counts, "<u8").tobytes())
    total = sum(counts)
    file.write(table)
    file.write(b"".join(index))
    file.write(_TRAILER.pack(at, at + len(table), len(names), total, MAGIC))
    return Written(len(names), total)


class Reader:
    """Reads ids by range: the chunk index says which blocks, and only these are fetched."""

    def __init__(self, file) -> None:
        self.file = file
        end = file.size()
        table, index, self.documents, self.ids, magic = _TRAILER.unpack(store.read_at(file, end - _TRAILER.size, _TRAILER.size))
        if magic != MAGIC or store.read_at(file, 0, len(MAGIC)) != MAGIC:
            raise ValueError("not a bit-plane file")
        self.bits = bool(store.read_at(file, len(MAGIC), 1)[0])
        self.table = table, index - table
        raw, at, self.chunks, first = store.read_at(file, index, end - _TRAILER.size - index), 0, [], 0
        while at < len(raw):
            offset, n, planes = _CHUNK.unpack_from(raw, at)
            at += _CHUNK.size
            self.chunks.append((first, n, offset, struct.unpack_from(f"<{planes}I", raw, at)))
            at += 4 * planes
            first += n
        self.firsts = np.array([c[0] for c in self.chunks], np.int64)
        self.opened: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def names_and_counts(self) -> tuple[list[int | None], np.ndarray]:
        raw = zstandard.ZstdDecompressor().decompress(store.read_at(self.file, *self.table), max_output_size=17 * self.documents + 1)
        n = self.documents
        names = np.frombuffer(raw, "<i8", n, n).tolist()
        for i in np.flatnonzero(np.frombuffer(raw, np.uint8, n)).tolist():
            names[i] = None
        return names, np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)

    def _chunk(self, i: int) -> np.ndarray:
        if self.opened[0] != i:
            _, n, offset, sizes = self.chunks[i]
            raw = store.read_at(self.file, offset, sum(sizes))
            size = -(-n // 8) if self.bits else n
            unpress, at, planes = zstandard.ZstdDecompressor(), 0, np.empty((len(sizes), size), np.uint8)
            for k, length in enumerate(sizes):
                planes[k] = np.frombuffer(unpress.decompress(raw[at : at + length], max_output_size=size), np.uint8)
                at += length
            self.opened = i, from_planes(planes, n, self.bits)
        return self.opened[1]

    def read(self, start: int, stop: int) -> np.ndarray:
        out, i = [], int(np.searchsorted(self.firsts, start, side="right")) - 1
        while start < stop:
            first, n, *_ = self.chunks[i]
            out.append(self._chunk(i)[start - first : min(stop, first + n) - first])
            start, i = min(stop, first + n), i + 1
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def save(docs: DataFrame, encode: Callable[[pa.Array], Iterable[bytes]], folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 0, bits: bool = True) -> list[dict]:
    """Write docs in ascending order of key. Returns the manifest: file, documents, ids and start (the ids before it).

    Texts are dealt out by ranges of keys before they are encoded, so that each is encoded once and only texts move.
    """
    spark = docs.sparkSession
    folder, tail = folder or scratch_path(spark, "planes"), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def rows() -> Iterator[tuple[int | None, bytes]]:
            batch = first
            while batch is not None:
                yield from zip(batch.column(0).to_pylist(), (ids + tail for ids in encode(batch.column(1))), strict=True)
                batch = next(batches, None)

        name = store.new_file(folder, ".planes")
        with store.writing(name) as file:
            done = write(file, rows(), bits=bits)
        yield pa.RecordBatch.from_pydict({"file": [name], "first": pa.array([first.column(0)[0].as_py()], pa.int64()), "documents": [done.documents], "ids": [done.ids]})

    order = F.col(key).asc_nulls_last()
    ranged = docs.select(F.col(key).cast("long").alias(key), text).repartitionByRange(order).sortWithinPartitions(order, F.col(text).asc_nulls_first())
    made, _ = written(ranged.mapInArrow(run, "file string, first long, documents long, ids long"), "manifest")
    files = sorted((r.asDict() for r in made.collect()), key=lambda r: (r["first"] is None, r["first"] or 0))  # a row a file
    start = 0
    for row in files:
        row["start"] = start
        start += row["ids"]
    return files


def load(spark, manifest: list[dict], key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit) of every document, read
    from the files block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.reading(name) as file:
                    reader = Reader(file)
                    names, counts = reader.names_and_counts()
                    ends = np.cumsum(counts)
                    for lo, hi in slices(counts.tolist(), OUT):
                        stops = ends[lo:hi].tolist()
                        starts = (ends - counts)[lo:hi].tolist()
                        ids = reader.read(starts[0], stops[-1])
                        parts = [ids[a - starts[0] : b - starts[0]].tobytes() for a, b in zip(starts, stops, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(names[lo:hi], pa.int64()), pa.array([base + a for a in starts], pa.int64()), pa.array(counts[lo:hi], pa.int64()), pa.array(parts, pa.binary())], names=[key, "start", "n_tokens", "ids"])

    files = spark.createDataFrame([(r["file"], r["start"]) for r in manifest], "file string, start long").repartition(max(1, len(manifest)))
    return files.mapInArrow(run, f"{key} long, start long, n_tokens long, ids binary")


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
