"""Removal of repeated byte strings: maximal repeats of enhanced suffix arrays, spread over tasks by anchors.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document with a smaller id, or earlier
in its own. Strings are judged on the input.

How the suffixes are dealt out. An anchor is a position whose GRAM-byte hash is the least of some LENGTH-byte window
around it; ties are all anchors. Which positions of a window are its anchors depends on the window's bytes alone, so
equal windows have equal anchors at equal places, and everything that can be equal meets under its anchor's hash. All
windows of an anchor lie in its context: LENGTH - GRAM bytes before it and LENGTH bytes from it on.

1. Each map task hashes anchors and contexts. Of equal contexts in a batch the first goes on; for the others, all
   windows start earlier, so the whole context is marked at once. A passage that a third of all documents share thus
   leaves a batch as one row.
2. After a shuffle by anchor, in sorted order and as a stream, the same holds over all batches. Anchors with one row
   are done. The first ones of different contexts of one anchor can still share some windows: these are ambiguous.
3. Ambiguous contexts get their bytes, meet again by anchor, and an enhanced suffix array over a block of them yields,
   from its common-prefix interval tree, the maximal repeats with all occurrences; all but the first are marked.
   An anchor with more than MOST contexts isn't dealt to one task; contexts are counted by anchor first, and those of
   such anchors are spread. They are cut into PARTS ranges of windows; the bytes that all windows of a range share
   extend the anchor, so most ranges stand alone now, and equal ranges are resolved by pre-aggregated minima and joins
   that split skewed keys. What is left is resolved window by window.
4. Marks are merged by document and joined to the texts.

Defined cases: null texts are empty; texts shorter than LENGTH lose nothing; rows with a null id come after all
others; rows that share id and text are one document and get equal results, rows that share the id only are ordered
by a hash of the text; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowfield.llm.common import PART, slices, texts_of, written
from rowfield.llm.enhanced_suffixes import maximal_repeats, rolling

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1  # grams in a string of LENGTH bytes
BEFORE = LENGTH - GRAM
PIECE = 1 << 20  # bytes that are hashed at a time
BLOCK = 2048  # contexts of a suffix array, as far as whole anchors allow
MOST = 1024  # contexts of one anchor in a suffix array; an anchor with more is resolved by ranges of windows
MAX_BROADCAST = 1_000_000  # hot anchors
PARTS = 8
#: (least, greatest) bytes that the windows of a range have before the anchor.
RANGES = [(BEFORE * i // PARTS + (i > 0), BEFORE * (i + 1) // PARTS) for i in range(PARTS)]

LAST = (1 << 63) - 1


def _sliding(values: np.ndarray, size: int, best: np.ufunc, pad: int) -> np.ndarray:
    """best over values[i : i + size] for each i, by running bests within blocks from either side."""
    n = len(values) - size + 1
    blocks = np.full(-(-len(values) // size) * size, pad, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, size)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[size - 1 : size - 1 + n])


def _anchors_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors in pieces of text that end at `ends`."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = rolling(data, GRAM)
    least = _sliding(grams, WINDOW, np.minimum, (1 << 64) - 1)
    whole = np.ones(len(least), bool)
    for end in ends.tolist():  # windows that run into the next piece don't count
        whole[max(0, end - LENGTH + 1) : end] = False
    least[~whole] = 0
    around = np.zeros(len(least) + 2 * (WINDOW - 1), np.uint64)
    around[WINDOW - 1 : WINDOW - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(around, WINDOW, np.maximum, 0) == grams)
    return at, grams[at]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, gram hash) of all anchors of all texts. Long texts are hashed in overlapping pieces."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pieces: list[tuple[int, int, int, int]] = []  # text, start, and the part of it whose anchors count
    parts: list[bytes] = []

    def flush() -> None:
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        at, grams = _anchors_of(np.frombuffer(b"".join(parts), np.uint8), ends)
        piece = np.searchsorted(ends, at, side="right")
        info = np.array(pieces, np.int64).reshape(-1, 4)
        place = at - starts[piece] + info[piece, 1]
        own = (place >= info[piece, 2]) & (place < info[piece, 3])
        found.append((info[piece, 0][own], place[own], grams[own]))
        pieces.clear()
        parts.clear()

    held = 0
    for n, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for lo in range(0, len(text), PIECE):
            start, stop = max(0, lo - WINDOW + 1), min(len(text), lo + PIECE + LENGTH)
            pieces.append((n, start, lo, min(len(text), lo + PIECE)))
            parts.append(text[start:stop] if stop - start < len(text) else text)
            held += stop - start
            if held >= PIECE:
                flush()
                held = 0
    if parts:
        flush()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans, as disjoint spans that don't touch, in order."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    return lo[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]


#: Rows of the first shuffle. kind 0: a mark (c and span are its start and end; a only spreads it); kind 1: an anchor.
ROWS = "kind byte, a long, c long, doc long, sub long, span long"
#: Rows after it. kind 0: a mark (lo, hi); kind 1: an ambiguous context (a; lo is the anchor's place, hi its left and right bytes).
FOUND = "kind byte, a long, doc long, sub long, lo long, hi long"


def _batch(schema: list[tuple[str, pa.DataType]], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_L = pa.int64()
_ROWS = [("kind", pa.int8()), ("a", _L), ("c", _L), ("doc", _L), ("sub", _L), ("span", _L)]
_FOUND = [("kind", pa.int8()), ("a", _L), ("doc", _L), ("sub", _L), ("lo", _L), ("hi", _L)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1. In: doc, sub, text. Out: ROWS."""
    for batch, whole in (part for batch in batches for part in texts_of(batch, 2, 4 * PART)):  # the larger, the fewer rows go on
        texts = [t or b"" for t in whole]
        docs, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        n, pos, grams = anchors(texts)
        if not len(n):
            continue
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        left, right = np.minimum(pos, BEFORE), np.minimum(sizes[n] - pos, LENGTH)
        hashed = xxhash.xxh3_64_intdigest
        c = np.fromiter((hashed(texts[i][a:b], s) for i, a, b, s in zip(n.tolist(), (pos - left).tolist(), (pos + right).tolist(), left.tolist(), strict=True)), np.uint64, len(n))
        a, c = grams.view(np.int64), c.view(np.int64)
        order = np.lexsort((pos, subs[n], docs[n], c, a))
        a, c, n, pos, left, right = a[order], c[order], n[order], pos[order], left[order], right[order]
        again = np.zeros(len(a), bool)
        again[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
        first = ~again
        yield _batch(_ROWS, np.ones(first.sum(), np.int8), a[first], c[first], docs[n][first], subs[n][first], (pos[first] << 16) | (left[first] << 8) | right[first])
        if again.any():
            # spans of all texts on one line, so that they are merged at once
            base = np.concatenate([[0], np.cumsum(sizes + 1)])
            m = n[again]
            lo, hi = merged(base[m] + (pos - left)[again], base[m] + (pos + right)[again])
            m = np.searchsorted(base, lo, side="right") - 1
            yield _batch(_ROWS, np.zeros(len(m), np.int8), docs[m] * 0x9E3779B1 + lo, lo - base[m], docs[m], subs[m], hi - base[m])


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2. In: ROWS in sorted order. Out: FOUND. Holds one batch and one row at a time, however many rows an anchor has."""
    held: tuple | None = None  # the last first-of-its-context: its row, and whether its anchor has another context so far

    def ambiguous(rows: np.ndarray) -> pa.RecordBatch:
        return _batch(_FOUND, np.ones(len(rows), np.int8), rows[:, 0], rows[:, 2], rows[:, 3], rows[:, 4] >> 16, rows[:, 4] & 0xFFFF)

    for batch in batches:
        kind = batch.column(0).to_numpy()
        rows = np.stack([batch.column(i).to_numpy() for i in range(1, 6)], axis=1)
        if (mark := kind == 0).any():
            m = rows[mark]
            yield _batch(_FOUND, np.zeros(len(m), np.int8), m[:, 0] * 0, m[:, 2], m[:, 3], m[:, 1], m[:, 4])
            rows = rows[~mark]
        if not len(rows):
            continue
        before = np.empty_like(rows[:, :2])
        before[1:] = rows[:-1, :2]
        before[0] = held[0][:2] if held else ~rows[0, :2]
        same_a = rows[:, 0] == before[:, 0]
        again = same_a & (rows[:, 1] == before[:, 1])
        if again.any():
            m = rows[again]
            pos, left, right = m[:, 4] >> 16, (m[:, 4] >> 8) & 255, m[:, 4] & 255
            yield _batch(_FOUND, np.zeros(len(m), np.int8), m[:, 0] * 0, m[:, 2], m[:, 3], pos - left, pos + right)
        firsts, joins = rows[~again], same_a[~again]  # joins: it follows another context of its anchor
        if held:
            firsts, joins = np.concatenate([held[0][None], firsts]), np.concatenate([[held[1]], joins])
        others = joins.copy()
        others[:-1] |= joins[1:]
        if others[:-1].any():
            yield ambiguous(firsts[:-1][others[:-1]])
        held = firsts[-1], bool(joins[-1])
    if held and held[1]:
        yield ambiguous(held[0][None])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: doc, sub, text, list of (a, lo, hi, hot). Out: a, doc, sub, start, context bytes, bytes before the anchor, hot."""
    for batch, texts in (part for batch in batches for part in texts_of(batch, 2)):
        out: list[tuple] = []
        for doc, sub, text, places in zip(*(batch.column(i).to_pylist() for i in (0, 1)), texts, batch.column(3).to_pylist(), strict=True):
            out += [(p["a"], doc, sub, p["lo"] - (p["hi"] >> 8), text[p["lo"] - (p["hi"] >> 8) : p["lo"] + (p["hi"] & 255)], p["hi"] >> 8, p["hot"]) for p in places]
            if len(out) >= 20_000:
                yield _context_batch(out)
                out = []
        if out:
            yield _context_batch(out)


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (_L, _L, _L, _L, pa.binary(), _L, pa.bool_()), strict=True)], names=["a", "doc", "sub", "start", "context", "left", "hot"])


#: Rows of step 3. kind 0: a mark (lo, hi). kind 2: a range of windows of an anchor with too many contexts: its bytes
#: from lo to hi, the extended anchor's hash (x, y) and the bytes' hash (z).
RESOLVED = "kind byte, doc long, sub long, lo long, hi long, x long, y long, z long, bytes binary"
_RESOLVED = [("kind", pa.int8()), ("doc", _L), ("sub", _L), ("lo", _L), ("hi", _L), ("x", _L), ("y", _L), ("z", _L), ("bytes", pa.binary())]


def _repeats(docs: np.ndarray, subs: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> pa.RecordBatch | None:
    """Marks from the maximal repeats of a block of contexts: all occurrences but the first."""
    of, at, groups = maximal_repeats(texts, LENGTH)
    if not len(groups):
        return None
    _, rank = np.unique(np.stack([docs, subs], axis=1), axis=0, return_inverse=True)
    place = starts[of] + at
    key = (rank.ravel()[of].astype(np.int64) << 40) | place
    length, first, last = groups.T
    many = last - first + 1
    begin = np.cumsum(many) - many
    index = np.repeat(first - begin, many) + np.arange(many.sum())  # all occurrences of all groups
    keys = key[index]
    later = keys > np.repeat(np.minimum.reduceat(keys, begin), many)
    longest = np.zeros(len(of), np.int64)
    np.maximum.at(longest, index[later], np.repeat(length, many)[later])
    index = np.flatnonzero(longest)
    if not len(index):
        return None
    # one line for each document, so that its marks are merged here
    line = rank.ravel()[of[index]].astype(np.int64) << 40
    lo, hi = merged(line + place[index], line + place[index] + longest[index])
    pick = np.zeros(int(rank.max()) + 1, np.int64)
    pick[rank.ravel()] = np.arange(len(docs))
    row = pick[lo >> 40]
    low = (1 << 40) - 1
    zero = np.zeros(len(lo), np.int64)
    return _batch(_RESOLVED, zero.astype(np.int8), docs[row], subs[row], lo & low, hi & low, zero, zero, zero, [b""] * len(lo))


def _ranges(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges of windows for contexts of an anchor that has too many of them."""
    out: list[tuple] = []
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for a, doc, sub, start, text, left in rows:
        for least, greatest in RANGES:
            # a text's end may leave fewer windows
            low, high = max(least, LENGTH - (len(text) - left)), min(greatest, left)
            if low > high:
                continue
            shared = xxhash.xxh3_128_intdigest(text[left - least : left + LENGTH - greatest], least)
            lo, hi = left - high, left + LENGTH - low
            part = text[lo:hi]
            out.append((2, doc, sub, start + lo, start + hi, signed(shared >> 64) ^ a, signed(shared & ((1 << 64) - 1)), signed(xxhash.xxh3_64_intdigest(part, high)), part))
    for at in range(0, len(out), 20_000):
        yield _batch(_RESOLVED, *zip(*out[at : at + 20_000], strict=True))


def _resolver(block: int):
    """Step 3 on contexts in the order of their anchors, those of hot anchors last. Holds one block and one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []  # contexts of whole anchors, and of the current one
        spread: list[tuple] = []

        def resolved() -> Iterator[pa.RecordBatch]:
            if ready:
                _, docs, subs, starts, texts, _, _ = zip(*ready, strict=True)
                ready.clear()
                if (made := _repeats(np.array(docs), np.array(subs), np.array(starts), list(texts))) is not None:
                    yield made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[-1]:
                    spread.append(row[:-1])
                    if len(spread) >= block:
                        yield from _ranges(spread)
                        spread.clear()
                    continue
                if len(ready) >= block and ready[-1][0] != row[0]:
                    yield from resolved()
                ready.append(row)
        yield from resolved()
        yield from _ranges(spread)

    return run


def _identified(docs: DataFrame, key: str, text: str, *keep: Column) -> tuple[DataFrame, DataFrame]:
    """doc, sub, text: doc orders the rows; sub tells rows of one id apart and is 0 where ids are unique. First for all
    rows, then with repeated rows once."""
    doc = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    repeats = docs.groupBy(doc.alias("doc")).count().where("count > 1").limit(1).count() > 0
    sub = F.xxhash64(F.coalesce(text, F.lit(""))) if repeats else F.lit(0).cast("long")
    named = [doc.alias("doc"), sub.alias("sub"), F.col(text).alias("text")]
    once = docs.select(*named)
    return docs.select(*named, *keep), once.dropDuplicates(["doc", "sub"]) if repeats else once


def marks(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST, block: int = BLOCK, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (doc, sub, text and `keep`), and for each document with marks (doc, sub, spans): its spans [lo, hi) in
    any order, which may overlap."""
    rows, distinct = _identified(docs, key, text, *([] if keep is None else [keep]))
    sifted = distinct.mapInArrow(_scan, ROWS).repartition("a").sortWithinPartitions("kind", "a", "c", "doc", "sub", "span").mapInArrow(_sift, FOUND)
    found, _ = written(sifted, "found")
    hot, _ = written(found.where("kind = 1").groupBy("a").count().where(F.col("count") > most).select("a", F.lit(True).alias("hot")), "hot")
    side = F.broadcast(hot) if hot.count() <= MAX_BROADCAST else hot  # 9 bytes an anchor; else a join that splits skewed keys
    marked = found.where("kind = 1").join(side, "a", "left").select("a", "doc", "sub", "lo", "hi", F.coalesce("hot", F.lit(False)).alias("hot"))
    places = marked.groupBy("doc", "sub").agg(F.collect_list(F.struct("a", "lo", "hi", "hot")).alias("places"))
    placed = distinct.join(places.hint("shuffle_hash"), ["doc", "sub"]).select("doc", "sub", "text", "places")
    contexts = placed.mapInArrow(_contexts, "a long, doc long, sub long, start long, context binary, left long, hot boolean")
    dealt = contexts.repartition(F.when(F.col("hot"), F.xxhash64("a", "doc", "sub", "start")).otherwise(F.col("a")))
    resolved, _ = written(dealt.sortWithinPartitions("hot", "a", "doc", "sub", "start").mapInArrow(_resolver(block), RESOLVED), "resolved")
    later = _resolved_ranges(resolved.where("kind = 2"))
    spans = found.where("kind = 0").select("doc", "sub", "lo", "hi").unionByName(resolved.where("kind = 0").select("doc", "sub", "lo", "hi")).unionByName(later)
    return rows, spans.groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _resolved_ranges(rows: DataFrame) -> DataFrame:
    """doc, sub, lo, hi of all windows in ranges (kind 2) that start earlier elsewhere.

    Of ranges with equal bytes, all but the first are marked whole. The first ones share an extended anchor with others
    or are done; those that do are taken apart into windows, and all but a window's first start are marked.
    """
    ranges = rows.select("x", "y", "z", F.struct("doc", "sub", "lo").alias("place"), "hi", "bytes")
    first = ranges.groupBy("x", "y", "z").agg(F.min("place").alias("first"), F.min_by("bytes", "place").alias("bytes"))
    whole = ranges.drop("bytes").join(first.select("x", "y", "z", "first"), ["x", "y", "z"]).where("place > first").select("place.doc", "place.sub", "place.lo", "hi")
    several = first.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y")
    open_ = first.join(several, ["x", "y"], "left_semi").where(F.length("bytes") >= LENGTH)
    window = open_.select("first", "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - LENGTH)).alias("i"))
    window = window.select(F.md5(F.substring("bytes", F.col("i") + 1, F.lit(LENGTH))).alias("w"), F.struct(F.col("first.doc"), F.col("first.sub"), (F.col("first.lo") + F.col("i")).alias("lo")).alias("place"))
    least = window.groupBy("w").agg(F.min("place").alias("least"))
    each = window.join(least, "w").where("place > least").select("place.doc", "place.sub", "place.lo", (F.col("place.lo") + LENGTH).alias("hi"))
    return whole.unionByName(each)


def disjoint(spans: list[dict] | None) -> tuple[list[int], list[int]]:
    if not spans:
        return [], []
    lo, hi = merged(np.array([s["lo"] for s in spans], np.int64), np.array([s["hi"] for s in spans], np.int64))
    return lo.tolist(), hi.tolist()


def remaining(text: bytes, lo: list[int], hi: list[int]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *hi], [*lo, len(text)], strict=True))


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (the bytes that remain) and spans (the removed runs) of every row."""
    rows, spans = marks(docs, key, text, **sizes)
    joined = rows.join(spans.hint("shuffle_hash"), ["doc", "sub"], "left").select("doc", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in (part for batch in batches for part in texts_of(batch, 1)):
            out = []
            for doc, data, found in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                data = data or b""
                lo, hi = disjoint(found)
                out.append((None if doc == LAST else doc, len(data), sum(hi) - sum(lo), len(lo), remaining(data, lo, hi), lo, hi))
            types = (_L, _L, _L, _L, pa.binary(), pa.list_(_L), pa.list_(_L))
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, "n_bytes", "n_removed", "n_spans", "kept", "starts", "ends"])

    return joined.mapInArrow(cut, f"{key} long, n_bytes long, n_removed long, n_spans long, kept binary, starts array<long>, ends array<long>")


def cut_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", least_bytes: int = 1, **sizes: int) -> DataFrame:
    """The rows of docs with what remains of their texts and, where there is a column `length`, their new lengths in
    characters. Texts that lose nothing stay as they are. A cut through a character takes the whole character. A row that
    loses bytes goes if fewer than `least_bytes` are left."""
    schema, names = docs.schema, docs.columns
    rows, spans = marks(docs, key, text, keep=F.struct(*names).alias("row"), **sizes)
    joined = rows.join(spans.hint("shuffle_hash"), ["doc", "sub"], "left").select("row", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(a, b - a) for batch in batches for a, b in slices(pc.fill_null(pc.binary_length(pc.struct_field(batch.column(0), text)), 0).to_pylist())):
            table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(batch.column(0))])
            texts, kept = table[text].to_pylist(), [True] * batch.num_rows
            lengths = table[length].to_pylist() if length in names else []
            for i, found in enumerate(batch.column(1).to_pylist()):
                if not found:
                    continue
                data = remaining(texts[i].encode(), *disjoint(found))
                texts[i], kept[i] = data.decode("utf-8", "ignore"), len(data) >= least_bytes
                if lengths:
                    lengths[i] = len(texts[i])
            at = names.index(text)
            table = table.set_column(at, table.field(at), pa.array(texts, table.field(at).type))
            if lengths:
                at = names.index(length)
                table = table.set_column(at, table.field(at), pa.array(lengths, table.field(at).type))
            yield from table.filter(pa.array(kept, pa.bool_())).to_batches()

    return joined.mapInArrow(cut, schema)
