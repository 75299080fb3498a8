"""Near-duplicate texts by SimHash: one-wildcard segment variants find candidates, exact Jaccard similarity decides.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Such sets differ
in about ten of 64 bits of a SimHash over shingles, too many for segments of a useful width. One changed word changes
five shingles but only one word, so the index takes a SimHash over the distinct words, of six segments of 32 bits. Each
segment is indexed by itself and by its 32 variants with one bit wiped out; texts that differ in at most one bit of a
segment meet at a key.

Within a key, texts are in an order by a hash of the segment's place and the text. Each is paired with the first one and
with the one before it, so that a key of any number of texts gives twice as many pairs at most; the six orders, and keys
that hold different parts of a group, pair it in several ways. Each text is verified first with the partner it shares the most keys with; then, of
the other pairs, those whose texts aren't in one component yet. README.md has the measured share of groups that are
found; no pair under the similarity is linked.

Defined cases: null texts are empty; a text of fewer words than a shingle is one shingle; word-less texts are linked;
texts are told apart by a 64-bit hash, so rows that share the key only stay apart; rows without a key stay as they are;
of repeated rows one stays; texts of any length are one set; an empty table gives an empty result; other columns of any
name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowfield.llm import simhash
from rowfield.llm.common import remove, texts_of, written
from rowfield.llm.components import components

SIZE = 5
SEGMENTS = 6
#: Distinct texts to verify that are broadcast at most, 16 bytes each; more are dealt out.
MAX_BROADCAST = 200_000
#: Word hashes that a worker keeps.
WORDS = 100_000
_KNOWN: dict[bytes, bytes] = {}


def shingle_set(text: bytes | None, size: int = SIZE) -> np.ndarray:
    return np.unique(np.array(simhash.shingle_hashes(text or b"", size), dtype="<u8"))


def _word(word: bytes) -> bytes:
    """192 bits."""
    made = xxhash.xxh3_128_digest(word, simhash.SEED) + xxhash.xxh3_64_digest(word, simhash.SEED + 1)
    if len(_KNOWN) >= WORDS:
        _KNOWN.clear()
    _KNOWN[word] = made
    return made


def word_fingerprint(text: bytes) -> list[int]:
    """The segments of a SimHash over the distinct words, lower-cased in A-Z."""
    words = set(text.lower().split())
    if not words:
        return [0] * SEGMENTS
    hashes = np.frombuffer(b"".join([_KNOWN.get(w) or _word(w) for w in words]), np.uint8).reshape(-1, 4 * SEGMENTS)
    counts = np.zeros(32 * SEGMENTS, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).view(">u4").tolist()


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _tid (the text's hash), _text of the rows that have a key."""
    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tid"), F.col(text).alias("_text"))


def _fingerprints(texts: DataFrame) -> DataFrame:
    """_key, _tid and the segments of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, whole in texts_of(batch, 2):
                made = np.array([word_fingerprint(t or b"") for t in whole], np.int64).reshape(-1, SEGMENTS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c) for c in made.T.copy()]], names=["_key", "_tid", *names])

    names = [f"s{i}" for i in range(SEGMENTS)]
    fields = [T.StructField("_key", texts.schema["_key"].dataType), T.StructField("_tid", T.LongType()), *[T.StructField(n, T.LongType()) for n in names]]
    return texts.mapInArrow(run, T.StructType(fields))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: key, tid, sorted by key, then by an order that depends on both. Out: u, v: each text with its key's first one and
    with the one before it."""
    key = first = before = None
    for batch in batches:
        keys, tids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        if key is None:
            key, first, before = ~keys[0], tids[0], tids[0]
        same = np.concatenate([[keys[0] == key], keys[1:] == keys[:-1]])
        heads = np.maximum.accumulate(np.where(same, -1, np.arange(len(keys))))
        firsts = np.where(heads < 0, first, tids[heads])
        befores = np.concatenate([[before], tids[:-1]])
        u, v = np.concatenate([firsts[same], befores[same]]), np.concatenate([tids[same], tids[same]])
        key, first, before = keys[-1], firsts[-1], tids[-1]
        u, v = np.minimum(u, v)[u != v], np.maximum(u, v)[u != v]
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def candidates(fingerprints: DataFrame) -> DataFrame:
    """u, v, n: pairs of texts that stars brought together, and by how many keys. fingerprints: a row a text."""
    keys = [key for key, _ in simhash.variants([F.col(f"s{i}") for i in range(SEGMENTS)])]
    index = fingerprints.select(F.explode(F.array(*keys)).alias("key"), "_tid").repartition("key")
    segment = F.floor(F.shiftright("key", 32) / 33)
    ordered = index.withColumn("o", F.xxhash64(segment, "_tid")).sortWithinPartitions("key", "o").select("key", "_tid")
    return ordered.mapInArrow(_stars, "u long, v long").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


def _shingles(texts: DataFrame, size: int) -> DataFrame:
    """_tid and its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, whole in texts_of(batch, 1):
                sets = [shingle_set(t, size) for t in whole]
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.empty(0, "<u8")]).view("<i8")))], names=["_tid", "shingles"])

    return texts.select("_tid", "_text").mapInArrow(run, "_tid long, shingles array<long>")


def _similar(texts: DataFrame, distinct: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Of the pairs u, v those whose sets are similar. The set of a text is taken from one of its rows, in `distinct`."""
    asked, path = written(pairs.select(F.explode(F.array("u", "v")).alias("_tid")).distinct().join(distinct.select("_tid", "_key"), "_tid"), "asked")
    few = asked.count() <= MAX_BROADCAST
    chosen = texts.join(F.broadcast(asked) if few else asked, ["_key", "_tid"], "left_semi")
    sets, sets_path = written(_shingles(chosen, size).dropDuplicates(["_tid"]), "sets")
    side = lambda name: sets.select(F.col("_tid").alias(name), F.col("shingles").alias(f"{name}_set"))
    near = lambda a, b: 5 * F.least(a, b) >= 4 * F.greatest(a, b)
    sized = sets.select("_tid", F.size("shingles").alias("size"))
    of = lambda name: sized.select(F.col("_tid").alias(name), F.col("size").alias(f"{name}_size"))
    possible = pairs.select("u", "v").join(of("u"), "u").join(of("v"), "v").where(near(F.col("u_size"), F.col("v_size"))).select("u", "v")
    both = possible.join(side("u"), "u").join(side("v"), "v")
    shared = F.size(F.array_intersect("u_set", "v_set"))
    out, _ = written(both.where(9 * shared >= 4 * (F.size("u_set") + F.size("v_set"))).select("u", "v"), "similar")
    for old in (path, sets_path):
        remove(texts.sparkSession, old)
    return out


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Every text (_tid, _key: its least key, rows: how many have both), and links u, v between texts, all of the similarity."""
    texts = _texts(docs, key, text)
    made, path = written(_fingerprints(texts), "fingerprints")
    names = [f"s{i}" for i in range(SEGMENTS)]
    rows = made.groupBy("_tid", "_key").agg(F.count(F.lit(1)).alias("rows"), *[F.min(n).alias(n) for n in names])
    distinct, _ = written(rows.groupBy("_tid").agg(F.min(F.struct("_key", "rows")).alias("k"), *[F.min(n).alias(n) for n in names]).select("_tid", "k.*", *names), "texts")
    remove(docs.sparkSession, path)
    pairs, pairs_path = written(candidates(distinct), "pairs")
    both = pairs.select("u", "v", "n", F.explode(F.array("u", "v")).alias("t"))
    best = both.groupBy("t").agg(F.max_by(F.struct("u", "v"), F.struct("n", F.xxhash64("u", "v"))).alias("best")).select("best.u", "best.v").distinct()
    found = _similar(texts, distinct, best, size)
    nodes = components(found)
    at = lambda name: nodes.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    apart = pairs.join(at("u"), "u", "left").join(at("v"), "v", "left").where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")
    more = _similar(texts, distinct, apart, size)
    remove(docs.sparkSession, pairs_path)
    return distinct.select("_tid", "_key", "rows"), found.unionByName(more)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """The rows of docs that have the least key of their group, of equal keys the one with the least hash of the text; and
    the rows without a key."""
    distinct, similar = links(docs, key, text, size)
    nodes = components(similar)
    rooted = distinct.join(nodes, distinct["_tid"] == nodes["node"], "left").select("_tid", "_key", "rows", F.coalesce("root", "_tid").alias("root"))
    stay, _ = written(rooted.groupBy("root").agg(F.min(F.struct("_key", "_tid", "rows")).alias("s")).select("s.*"), "stay")
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(key).alias("_k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    on = (F.col("_k") == F.col("_key")) & (F.col("_t") == F.col("_tid"))
    alone = whole.join(stay.where("rows = 1"), on, "left_semi")
    several = whole.join(stay.where("rows > 1"), on, "left_semi").dropDuplicates(["_k", "_t"])  # one of the repeated rows
    return alone.unionByName(several).unionByName(whole.where("_k IS NULL")).select("_doc.*")
