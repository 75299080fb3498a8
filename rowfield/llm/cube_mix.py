"""Mixing sources to target weights by the cube method.

Targets. Sources in code-point order (null last) weigh 3, 1, 2, repeating. A budget of 150 % of all words is shared by
weight; a target stops at twice its source's words, and what is over is shared anew by weight among the others.

Sampling. A source's documents all get the expected number of copies f = target / words, at most 2: floor(f) copies
for sure and one more with probability p = f - floor(f). These p move by the cube method: of three documents at a time,
a vector in the null-space of the constraints (document count and word total) shifts the p until one of them is 0 or 1,
which leaves both totals exactly where they were. When fewer than three are left, the landing rounds them so that the
word total comes nearest, and makes up for what it is still off by swapping a few documents.

Scale. Flights run in blocks of documents (by a hash within a source) of bounded size; each leaves at most two open
documents and RESERVE of several lengths, and these meet again in blocks of the next level, until a source is one block. So a source that holds a
third of all rows is many blocks, and no task gets an unbounded group. All choices come from hashes: reruns agree.

Defined cases: a null text has no words; a text of any length counts whole; a null source is a source of its own, the
last; sources without words have target 0 and take nothing; rows are decided one by one, also if they repeat, and those
that agree in id, source and size are interchangeable; ties of the landing go to the combination that comes first; an
empty table gives an empty result; other columns, whatever their names, are not read and don't reach the result.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowfield.llm.common import word_count, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_COPIES = 2.0
BLOCK = 1024
#: Documents of several lengths that a block leaves open for the levels above, so that a landing has some to make up with.
RESERVE = 6
MAX_BROADCAST = 100_000
_EPS = 1e-9


def flight(p: list[float], size: list[int], draws: list[float]) -> list[float]:
    """Move probabilities of documents, in order, until at most two are neither 0 nor 1. Keeps sum(p) and sum(p * size)."""
    p = list(p)
    held: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = (size[j] for j in held)
        u = (c - b, a - c, b - a)  # orthogonal to (1, 1, 1) and to the sizes
        if not any(u):
            u = (1, -1, 0)
        moves = [(p[j], d) for j, d in zip(held, u, strict=True) if d]
        up = min((1 - x) / d if d > 0 else -x / d for x, d in moves)
        down = min(x / d if d > 0 else (x - 1) / d for x, d in moves)
        step = up if draws[i] * (up + down) < down else -down
        for j, d in zip(held, u, strict=True):
            x = p[j] + step * d
            p[j] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
        held = [j for j in held if 0 < p[j] < 1]
    return p


def land(p: list[float], size: list[int], swaps: int = 16) -> list[float]:
    """Round the few open probabilities so that the word total comes nearest to its expectation, then the count. What
    remains is made up for by swaps of a taken for another document, which leave the count as it is: each time the pair
    that brings the total nearest."""
    open_ = [j for j, x in enumerate(p) if _EPS < x < 1 - _EPS]
    off = lambda m, w: sum(w[j] * ((m >> k & 1) - p[j]) for k, j in enumerate(open_))
    one = [1] * len(p)
    best = min(range(1 << len(open_)), key=lambda m: (abs(off(m, size)), abs(off(m, one)), m))
    out = [float(round(x)) for x in p]
    for k, j in enumerate(open_):
        out[j] = float(best >> k & 1)
    over = off(best, size)
    sides = [sorted((n, j) for j, n in enumerate(size) if out[j] == taken) for taken in (0.0, 1.0)]
    for _ in range(swaps):
        free, taken = sides
        pairs = []
        for n, j in taken:
            at = bisect_left(free, (n - over, -1))
            pairs += [(abs(over - n + free[k][0]), j, free[k][1]) for k in (at - 1, at) if 0 <= k < len(free)]
        left, j, k = min(pairs, default=(abs(over), -1, -1))
        if left >= abs(over) - _EPS:
            break
        out[j], out[k] = 0.0, 1.0
        over += size[k] - size[j]
        free[bisect_left(free, (size[k], k))] = (size[j], j)
        taken[bisect_left(taken, (size[j], j))] = (size[k], k)
        free.sort()
        taken.sort()
    return out


def _draws(seeds: np.ndarray) -> list[float]:
    """Uniform numbers by place in the sorted block and the row's hash; rows that look alike are interchangeable."""
    x = (np.arange(len(seeds), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ seeds.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) / 2.0**64).tolist()


def _level(last: bool):
    def run(block: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block, sort_keys=[("size", "descending"), ("draw", "ascending")])).combine_chunks()
        size = block["size"].to_pylist()
        p, draws = block["p"].to_pylist(), _draws(block["draw"].to_numpy())
        words = sum(n > 0 for n in size)
        apart = set() if last else {words * k // (RESERVE + 1) for k in range(1, RESERVE + 1) if words > 2 * RESERVE}
        flying = [i for i in range(len(p)) if i not in apart]
        for i, x in zip(flying, flight([p[i] for i in flying], [size[i] for i in flying], [draws[i] for i in flying]), strict=True):
            p[i] = x
        p = land(p, size) if last else p
        return block.set_column(block.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return run


def ranked(by: DataFrame, key: str) -> DataFrame:
    """`by` with rank, the number of its rows before, in ascending order of key, nulls last. The rows are dealt out by ranges
    once and written, so that the ranges' sizes and the rows in them are the same ones."""
    order = F.col(key).asc_nulls_last()
    dealt, _ = written(by.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # a row a task of the range exchange, whatever the number of rows
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + place - 1).drop("_part", "_start")


def source_targets(sized: DataFrame, source: str = "source", size: str = "size", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST_COPIES) -> DataFrame:
    """_source, source_size, target, source_docs; one row a source, of which any number may be.

    A target is the least of `most` times the source's size and level times its weight. The level rises until the sources
    that it doesn't fill take what the full ones leave of the budget; each step is one aggregation.
    """
    by = sized.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    weight = F.array(*map(F.lit, map(float, weights)))[(F.col("rank") % len(weights)).cast("int")]
    of, _ = written(ranked(by, "_source").withColumn("_weight", weight), "sources")
    cap, level, full = F.col("source_size") * F.lit(float(most)), 0.0, -1
    while True:
        is_full = cap <= F.col("_weight") * F.lit(level)
        open_ = of.where("source_size > 0").agg(
            F.sum(F.when(~is_full, F.col("_weight"))).alias("weight"),
            F.coalesce(F.sum(F.when(is_full, cap)), F.lit(0.0)).alias("full"),
            F.count(F.when(is_full, 1)).alias("n"),
            F.sum("source_size").alias("all"),
        ).first()
        if open_["weight"] is None or open_["n"] == full:
            break
        level, full = (budget * open_["all"] - open_["full"]) / open_["weight"], open_["n"]
    return of.select("_source", "source_size", F.least(cap, F.col("_weight") * F.lit(level)).alias("target"), "source_docs")


def copies(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK) -> DataFrame:
    """`block` is over 2 + RESERVE. key, source, size, source_size, target, copies (0, 1 or 2) of every row of docs."""
    sized, _ = written(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sized")
    of = source_targets(sized)
    few = of.count() <= MAX_BROADCAST  # a number and a name a source
    joined = sized.join(F.broadcast(of) if few else of, sized["source"].eqNullSafe(of["_source"]), "left").drop("_source")
    f = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST_COPIES))).otherwise(0.0)
    rows = joined.withColumns({"f": f, "draw": F.xxhash64("id", "size", F.lit(17))}).select(
        "id", "source", "size", "source_size", "target", "draw",
        F.floor("f").alias("sure"),
        (F.col("f") - F.floor("f")).alias("p"),
        F.greatest(F.ceil(F.col("source_docs") / block), F.lit(1)).cast("long").alias("blocks"),
    )
    schema, level, parts = rows.schema, 0, []
    while True:
        last = (rows.agg(F.max("blocks")).first()[0] or 1) <= 1
        slot = F.pmod(F.xxhash64("draw", F.lit(level)), F.col("blocks")).alias("slot")
        flown, _ = written(rows.groupBy("source", slot).applyInArrow(_level(last), schema), "flown")
        still = (F.col("p") > 0) & (F.col("p") < 1)
        parts.append(flown if last else flown.where(~still))
        if last:
            break
        # so many of a block are open at most, so a source's next blocks follow from its blocks now
        rows = flown.where(still).withColumn("blocks", F.ceil(F.col("blocks") * (2 + RESERVE) / block).cast("long"))
        level += 1
    out = reduce(DataFrame.unionByName, parts)
    return out.select(F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target", (F.col("sure") + F.col("p")).cast("int").alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that agree in key, source and size are numbered by a
    hash of the text and share their copies in that order."""
    taken = copies(docs, key, source, text).select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.col("size").alias("_n"), F.col("copies").alias("_c"))
    left = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(key).alias("_k"), F.col(source).alias("_s"), word_count(F.col(text)).alias("_n"), F.xxhash64(text).alias("_h"))
    alike = ["_k", "_s", "_n"]
    if taken.groupBy(alike).count().where("count > 1").limit(1).count():
        taken = taken.withColumn("_i", F.row_number().over(Window.partitionBy(alike).orderBy(F.desc("_c"))))
        left = left.withColumn("_i", F.row_number().over(Window.partitionBy(alike).orderBy("_h")))
        alike = [*alike, "_i"]
    on = reduce(lambda x, y: x & y, (left[c].eqNullSafe(taken[c]) for c in alike))
    return left.join(taken.where("_c > 0").hint("shuffle_hash"), on).select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("_c")))).select("_doc.*")
