"""Each stage against a brute-force version on its own input, over a small whole table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowfield.llm import cube_mix
from rowfield.llm.common import table
from rowfield.llm.queries import WORD_BPE
from tests.llm.test_near_texts import brute as brute_groups
from tests.llm.test_suffix_dedup import brute as brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The output of every stage, read again from Parquet as the next one's input."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, SF, "documents"), []
    out.append(docs)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        out.append(docs)
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "mixing", "packing"]
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_rules_keep_good_documents_and_drop_junk(spark, stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    texts = {r["doc_id"]: r["text"] for r in stages[0].collect()}
    for r in table(spark, SF, "labels").collect():
        if not r["quality"]:
            assert r["doc_id"] not in kept
        elif len(texts[r["doc_id"]].split()) >= 50:
            assert r["doc_id"] in kept
    assert {r["doc_id"]: r["text"] for r in stages[1].collect()} == {k: texts[k] for k in kept}


def test_one_document_of_a_group_stays(stages):
    rows = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    first, kept = brute_groups(list(rows.items())), {r["doc_id"]: r["text"] for r in stages[2].collect()}
    assert set(first) <= set(kept) and kept == {k: rows[k] for k in kept}
    assert len(kept) - len(first) <= 0.1 * (len(rows) - len(first))
    assert len(set(kept.values())) == len(kept)  # no exact copy stays


def test_repeated_passages_go(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    gone = brute_repeats(rows)
    want = {}
    for doc, text in rows:
        data = text.encode()
        left = bytes(b for i, b in enumerate(data) if i not in gone[doc])
        if left or not gone[doc]:
            want[doc] = left.decode("utf-8", "ignore") if gone[doc] else text
    got = {r["doc_id"]: r for r in stages[3].collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert any(gone.values()) and all(r["n_chars"] == len(r["text"]) for k, r in got.items() if gone[k])


def test_the_mix_repeats_documents(spark, stages):
    want = {r["doc_id"]: r["copies"] for r in cube_mix.copies(stages[3]).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()} == want


def test_every_id_is_packed(stages):
    texts = [r["text"] for r in stages[4].select("text").collect()]
    tokens = sum(len(x) // 4 + 1 for x in WORD_BPE(texts))
    out = stages[5].agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top"), F.countDistinct("sequence_id").alias("windows")).first()
    assert out["n"] == tokens and out["top"] <= 4096 and out["windows"] * 4096 <= 1.1 * tokens + 8 * 4096


def test_run_is_the_stages_in_order(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == stages[5].count()


def test_empty_and_odd_tables(spark):
    empty = table(spark, SF, "documents").limit(0)
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 60, None, None, 120), (3, " ".join(f"w{i}" for i in range(70)), "en", "s", 270)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts = []
    for docs in (empty, odd):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            counts.append(docs.count())
    assert counts[:5] == [0] * 5 and counts[5:8] == [1, 1, 1] and counts[8] in (1, 2) and counts[9] >= counts[8]
