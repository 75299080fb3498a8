"""Packing of tokenized documents into windows by best-fit decreasing.

Overlong documents are first cut into full windows. The rest, and all shorter documents, are placed from long to short,
each into the open window with the least room that still holds it; a segment tree over remaining capacities finds it.
This runs within a task, in rounds of ROUND windows, without a shuffle: a round's windows that are left with more than
`slack` room are emptied, their pieces fill windows to the brim by cuts, and the last, partial one goes into the next
round. So a window lacks at most `slack` ids, but for one a task, and a task holds one round of ids.

Defined cases: null texts are empty and have the end id only; repeated rows are packed as often as they occur; a
document of any length is cut; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 4096
ROUND = 1024
SLACK = 16
_ID = 4  # bytes an id

#: A piece: document's place in the round's list, start in the document, length.
Piece = tuple[int, int, int]


class Capacities:
    """Open windows by remaining capacity: a segment tree that finds the least capacity of at least some size."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest window with room for `need`; it is taken out."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up to the first right sibling with windows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.windows[capacity].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows as lists of places in `lengths`; no length exceeds the window."""
    out: list[list[int]] = []
    open_ = Capacities(window)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = open_.take(lengths[i])
        if found is None:
            room, at = window, len(out)
            out.append([])
        else:
            room, at = found
        out[at].append(i)
        if room > lengths[i]:
            open_.add(room - lengths[i], at)
    return out


def cut_full(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of the full windows of a document, then of its rest."""
    return [(at, min(window, n - at)) for at in range(0, n, window)]


def pack_round(pieces: list[Piece], window: int, slack: int, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows of pieces, and the pieces that are left for the next round (none in the last one)."""
    full, short = [], []
    for members in best_fit([p[2] for p in pieces], window):
        group = [pieces[i] for i in members]
        (full if sum(p[2] for p in group) >= window - slack else short).append(group)
    now: list[Piece] = []
    room = window
    for doc, start, length in (p for group in short for p in group):
        while length >= room:
            now.append((doc, start, room))
            full.append(now)
            start, length, now, room = start + room, length - room, [], window
        if length:
            now.append((doc, start, length))
            room -= length
    if now and last:
        full.append(now)
        now = []
    return full, now


def pack(docs: DataFrame, encode: Callable[[pa.Array], Iterable[bytes]], end_id: int, key: str = "doc_id", text: str = "text", window: int = WINDOW, slack: int = SLACK, rounds: int = ROUND) -> DataFrame:
    """Per piece: key, start (its document's ids before it), length, doc_tokens, sequence_id, offset (its place in the
    sequence) and ids (little-endian unsigned 32-bit). Sequence ids are a task's number and a count."""
    kind = T.StringType() if isinstance(docs.schema[key].dataType, T.StringType) else T.LongType()
    names = [key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(n, T.LongType()) for n in names[1:-1]], T.StructField("ids", T.BinaryType())])
    tail = end_id.to_bytes(_ID, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sequence = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[object, int, int, bytes]] = []  # key, start of the held ids, ids in the document, held ids
        pieces: list[Piece] = []
        waiting = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, pieces, waiting, sequence
            windows, left = pack_round(pieces, window, slack, last)
            rows: list[tuple] = []
            for group in windows:
                at = 0
                for doc, start, length in group:
                    name, first, total, ids = held[doc]
                    rows.append((name, first + start, length, total, base + sequence, at, ids[start * _ID : (start + length) * _ID]))
                    at += length
                sequence += 1
            kept = [(held[d][0], held[d][1] + s, held[d][2], held[d][3][s * _ID : (s + n) * _ID]) for d, s, n in left]
            pieces = [(i, 0, n) for i, (_, _, n) in enumerate(left)]
            held, waiting = kept, sum(n for _, _, n in left)
            types = [out.type for out in empty]
            for lo in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 4096], strict=True), types, strict=True)], names=names)

        empty = [pa.array([], pa.string() if isinstance(kind, T.StringType) else pa.int64()), *[pa.array([], pa.int64())] * 5, pa.array([], pa.binary())]
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                data = ids + tail
                n = len(data) // _ID
                pieces += [(len(held), start, length) for start, length in cut_full(n, window)]
                held.append((name, 0, n, data))
                waiting += n
                if waiting >= rounds * window:
                    yield from flush(False)
        if pieces:
            yield from flush(True)

    return docs.select(F.col(key).cast(kind).alias(key), text).mapInArrow(run, schema)
