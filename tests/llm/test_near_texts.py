"""The near-duplicate stage against brute force: Jaccard similarity of five-word shingles, 0.8 or more."""

import random

import corpus_pipeline
from rowfield.llm import near_texts
from rowfield.llm.common import table
from tests.llm.test_simhash import brute_fp


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in ids})


def held(df, rows):
    """Whether the first of every group stays, nothing goes that is in no group, and few of those that can go stay."""
    want, got = brute(rows), kept(df)
    assert set(want) <= set(got) <= {i for i, _ in rows}
    assert len(got) - len(want) <= 0.1 * (len({i for i, _ in rows}) - len(want))
    return want


def kept(df):
    return sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(df.sparkSession, df, "").collect())


def test_one_changed_word_in_a_hundred(spark):
    words = [f"w{i}" for i in range(112)]
    other = next(x for x in ([*words[:50], f"other{k}", *words[51:]] for k in range(999)) if (brute_fp(" ".join(x)) ^ brute_fp(" ".join(words))).bit_count() > 3)
    rows = [(783, " ".join(words)), (3006, " ".join(other)), (4000, " ".join(words[::-1]))]
    assert kept(spark.createDataFrame(rows, "doc_id long, text string")) == [783, 4000]


def test_copies_of_all_kinds_against_brute_force(spark):
    r = random.Random(11)
    word = lambda: f"v{r.randrange(400)}"
    rows, line = [], "this very line is in a lot of the documents of this table"
    for _ in range(60):
        w = [word() for _ in range(r.choice((3, 8, 30, 60, 120, 200)))] + line.split() * r.randint(0, 1)
        for _ in range(r.randint(1, 5)):
            rows.append((len(rows), " ".join(w)))
            w = list(w)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
    base = [word() for _ in range(60)]  # many copies, each near the original, few near each other
    rows.append((len(rows), " ".join(base)))
    for i in range(40):
        rows.append((len(rows), " ".join([*base[:i], f"x{i}", *base[i + 1 :]])))
    rows += [(1000, None), (1001, ""), (1002, "One"), (1003, "oNE")]
    r.shuffle(rows)
    assert len(held(spark.createDataFrame(rows, "doc_id long, text string"), rows)) < len(rows) - 60


def test_documents_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    held(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_rows_without_a_key_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (3, "x y z w")], "doc_id long, text string")
    out = near_texts.deduplicate(df)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["3", "7", "None"]
    assert near_texts.deduplicate(df.limit(0)).count() == 0


def test_rows_that_share_a_key_only_are_told_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    df = spark.createDataFrame([(1, a, 1), (1, b, 2), (2, a + " more", 3), (2, a + " more", 3), (1, a, 4)], "doc_id long, text string, rows int").withColumnRenamed("rows", "_tid")
    assert sorted((r["doc_id"], r["text"]) for r in near_texts.deduplicate(df).collect()) == [(1, a), (1, b)]


def test_a_star_pairs_every_text_of_a_key_across_batches():
    import numpy as np
    import pyarrow as pa

    keys, tids = np.array([1, 1, 1, 2, 3, 3, 3, 3]), np.arange(8)
    whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(tids)], names=["key", "t"])
    want = {(0, 1), (0, 2), (1, 2), (4, 5), (4, 6), (5, 6), (4, 7), (6, 7)}
    for cut in range(9):
        out = near_texts._stars(iter([whole.slice(0, cut), whole.slice(cut)]))
        assert {p for b in out for p in zip(*(c.to_pylist() for c in b.columns), strict=True)} == want
