import random

import pytest
from pyspark.sql import functions as F

from rowfield.llm import cube_mix as C


def targets(sizes, weights=C.WEIGHTS):
    """The plain way: share, stop the full ones, share what they leave."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, rest = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n}, 1.5 * sum(sizes)
    while open_:
        share = {i: rest * weight[i] / sum(weight[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > 2 * sizes[i]}
        for i in over or open_:
            out[i] = 2.0 * sizes[i] if over else share[i]
        rest -= sum(2 * sizes[i] for i in over)
        open_ = open_ - over if over else set()
    return out


def test_targets(spark):
    r = random.Random(6)
    for sizes in ([], [0, 0], [100, 100, 100], [0, 10], [5, 1000, 30, 400], [int(r.paretovariate(0.5)) for _ in range(700)]):
        names = sorted(f"s{r.random()}é" for _ in sizes)
        if len(names) > 2:
            names[-1] = None  # the last
        rows = [(n, s) for n, s in zip(names, sizes, strict=True)]
        r.shuffle(rows)
        got = {x["_source"]: x["target"] for x in C.source_targets(spark.createDataFrame(rows, "source string, size long").repartition(5)).collect()}
        assert [got[n] for n in names] == pytest.approx(targets(sizes))
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes))


def test_ranks_are_whole(spark):
    df = spark.range(20_000).select((F.col("id") % 9_000 * 7).alias("k")).distinct().unionByName(spark.createDataFrame([(None,)], "k long"))
    got = {r["k"]: r["rank"] for r in C.ranked(df.repartition(6), "k").collect()}
    assert got == {7 * i: i for i in range(9_000)} | {None: 9_000}


def test_a_long_text_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "w " * 300_000, "a", 1, 2), (2, "w", "a", 3, 4)], "doc_id long, text string, source string, size int, target int")
    assert {r["doc_id"]: (r["size"], r["source_size"], r["target"]) for r in C.copies(df).collect()} == {1: (300_000, 300_001, 450_001.5), 2: (1, 300_001, 450_001.5)}


def test_flights_keep_both_totals():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 50, 400):
        size = sorted((r.randint(0, 3000) for _ in range(n)), reverse=True)
        p = [r.choice([0.0, 1.0, r.random()]) for _ in range(n)]
        q = C.flight(p, size, [r.random() for _ in range(n)])
        assert sum(p) == pytest.approx(sum(q)) and sum(a * b for a, b in zip(p, size, strict=True)) == pytest.approx(sum(a * b for a, b in zip(q, size, strict=True)))
        assert sum(0 < x < 1 for x in q) <= 2
        landed = C.land(q, size)
        assert set(landed) <= {0.0, 1.0}
        if n > 100:
            assert abs(sum(a * b for a, b in zip(landed, size, strict=True)) - sum(a * b for a, b in zip(p, size, strict=True))) <= 60


def table(spark, n=3000):
    r = random.Random(3)
    sources = ["b", "a", None, "é", "hot"]
    rows = [(i, " ".join(["w"] * min(400, int(r.paretovariate(0.7)) * 3)), r.choice(sources + ["hot"] * 4)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), rows


def test_takes_come_near_targets_and_reruns_agree(spark):
    df, rows = table(spark)
    out = C.copies(df, block=64).collect()
    again = C.copies(df.repartition(7), block=64).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sorted(r["doc_id"] for r in out) == list(range(len(rows)))
    by = {}
    for r in out:
        assert r["copies"] in (0, 1, 2) and r["size"] == len(rows[r["doc_id"]][1].split())
        x = by.setdefault(r["source"], [0, r["target"], r["source_size"], 0, 0])
        x[0] += r["size"] * r["copies"]
        x[3] += r["copies"]
        x[4] += 1
    for taken, target, size, n, docs in by.values():
        assert abs(taken - target) <= 0.005 * target + 3  # the shortest documents have three words
        assert abs(n - docs * target / size) <= 2
    order = sorted(by, key=lambda s: (s is None, s or ""))
    assert [by[s][1] for s in order] == pytest.approx(targets([by[s][2] for s in order]))


def test_mix_repeats_rows(spark):
    df = spark.createDataFrame([(1, "a b", "s", 5), (1, "a b", "s", 5), (1, "c d", "s", 6), (None, "x", None, 7), (2, None, "s", 8)], "doc_id long, text string, source string, copies int")
    copies = C.copies(df)
    want = sum(r["copies"] for r in copies.collect())
    mixed = C.mix(df)
    assert mixed.columns == df.columns and mixed.count() == want
    assert C.copies(df.limit(0)).count() == 0 and C.mix(df.limit(0)).count() == 0


def test_mix_equals_copies(spark):
    df, _ = table(spark, 500)
    want = {r["doc_id"]: r["copies"] for r in C.copies(df).collect() if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in C.mix(df).groupBy("doc_id").count().collect()}
    assert got == want
